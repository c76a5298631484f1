"""Katz backoff language models of any order, kept as partitioned tables.

``train`` writes, under one folder, the n-grams of each order with their counts and discounted probabilities (partitioned by
order and bucket of the history), the backoff weight of each history, and the totals.  ``evaluate`` scores any documents
against such tables, the corpus or new text: each token asks the highest order first; where its n-gram isn't there, the
history's weight counts and the next lower order is asked, down to single words.

    P(w | h) = d_r r / (c(h) + 1)          the n-gram (h, w) is in the training text r > 0 times
             = alpha(h) P(w | h')          else, h' without h's first word; alpha is 1 for a history that never occurred
    P(w)     = (c(w) + 1) / (N + V + 1)    V kinds of tokens, and one for all unknown ones

d_r are Good-Turing discounts of the order for r <= 5; alpha makes each history's sum exactly 1.  Counts are combined in tasks
before they are shuffled, and all steps are joins and aggregates over the tables, so no n-gram table of any size is in a task.
Tables go up as the text and the order do: this is the form for models that are kept.  ``language_model.score_corpus``
scores a corpus by its own pairs with far less on disk.

Null text counts as empty: one end token.  Rows are texts of their own, whatever their ids.  Ties don't arise.  Texts are taken
whole, some at a time.  No columns but the id and the text are read.  Empty training text gives a model in which every
token is unknown; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pepspark.llm.common import by_row, map_arrow, ngram_hashes, staged, text_bytes, word_chunks
from pepspark.llm.language_model import DISCOUNTED, discounts

START, END = 1, 2  # no word's hash, but for one in 2^63
BUCKETS = 64


def _grams(hashes: np.ndarray, lengths: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(text, word, histories) of each token and each text's end; ``histories[k]`` is the hash of the k words before, starts
    included (k from 0, where it is 0)."""
    m = order - 1
    stops = np.cumsum(lengths + m + 1)
    padded = np.full(int(stops[-1]) if len(stops) else 0, START, np.uint64)
    begins = stops - lengths - 1
    where = np.repeat(begins - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())
    padded[where] = hashes
    padded[stops - 1] = END
    text = np.repeat(np.arange(len(lengths)), lengths + 1)
    at = np.repeat(begins - (np.cumsum(lengths + 1) - lengths - 1), lengths + 1) + np.arange((lengths + 1).sum())
    histories = [np.zeros(len(at), np.uint64)]
    for k in range(1, order):
        histories.append(ngram_hashes(padded, k, seed=k)[at - k] if len(at) else np.empty(0, np.uint64))
    return text, padded[at], histories


def _counted(rows: DataFrame, order: int) -> DataFrame:
    """``n, h, shorter, w, c``: the n-grams of all orders, with the hash of their history and of it without its first word."""
    source = rows.select("doc", text_bytes(F.col("text")).alias("text"))

    def run(batch):
        for _, hashes, lengths in word_chunks(batch, lower=True):
            _, w, histories = _grams(hashes, lengths, order)
            for n in range(1, order + 1):
                h, shorter = histories[n - 1], histories[max(0, n - 2)]
                by = np.lexsort((w, h))
                first = np.flatnonzero(np.r_[True, (h[by][1:] != h[by][:-1]) | (w[by][1:] != w[by][:-1])]) if len(by) else np.empty(0, np.int64)
                times = np.diff(np.r_[first, len(by)])
                own = by[first]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), n, np.int32)), *(pa.array(x[own].view(np.int64)) for x in (h, shorter, w)), pa.array(times.astype(np.int64))], names=["n", "h", "shorter", "w", "c"])

    counts = map_arrow(source, run, "n int, h long, shorter long, w long, c long")
    return counts.groupBy("n", "h", "shorter", "w").agg(F.sum("c").alias("c"))


def _bucket(h: str):
    return F.pmod(F.xxhash64(h), F.lit(BUCKETS)).cast("int")


def train(docs: DataFrame, folder: str, order: int = 3, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes the model of all rows of ``docs``: ``ngrams`` (n, bucket; h, w, c, p), ``histories`` (n, bucket; h, alpha) and
    ``totals``."""
    rows, _ = by_row(docs, id_col, text_col)
    counts = staged(_counted(rows, order), "counts")
    total = counts.where("n = 1").agg(F.coalesce(F.sum("c"), F.lit(0)).alias("tokens"), F.count(F.lit(1)).alias("kinds")).first()
    unit = total["tokens"] + total["kinds"] + 1
    docs.sparkSession.createDataFrame([(order, total["tokens"], total["kinds"])], "n int, tokens long, kinds long").write.mode("overwrite").parquet(f"{folder}/totals")
    sizes = {(r["n"], r["r"]): r["k"] for r in counts.where("n > 1").groupBy("n", F.least("c", F.lit(DISCOUNTED + 2)).alias("r")).agg(F.count(F.lit(1)).alias("k")).collect()}
    for n in range(1, order + 1):
        own = counts.where(F.col("n") == n)
        if n == 1:
            grams = own.select("h", "shorter", "w", "c", ((F.col("c") + 1) / F.lit(float(unit))).alias("p"))
        else:
            d = discounts(np.array([sizes.get((n, r), 0) for r in range(DISCOUNTED + 3)], float))
            kept = F.element_at(F.array(*(F.lit(float(d[r])) for r in range(1, DISCOUNTED + 1))), F.least("c", F.lit(DISCOUNTED)).cast("int"))
            mass = F.when(F.col("c") <= DISCOUNTED, F.col("c") * kept).otherwise(F.col("c").cast("double"))
            seen = staged(own.groupBy("h").agg(F.sum("c").alias("_all")), "seen")
            grams = own.join(seen, "h").select("h", "shorter", "w", "c", (mass / (F.col("_all") + 1)).alias("p"))
        grams = staged(grams, "grams")
        place = lambda df: df.withColumns({"n": F.lit(n), "bucket": _bucket("h")})  # noqa: E731, B023
        mode = "overwrite" if n == 1 else "append"
        place(grams.drop("shorter")).repartition("bucket").sortWithinPartitions("bucket", "h", "w").write.mode(mode).partitionBy("n", "bucket").parquet(f"{folder}/ngrams")
        if n > 1:
            lower = grams.select("h", F.col("shorter").alias("_h"), "w", "p").join(below, ["_h", "w"])
            weights = lower.groupBy("h").agg(((1 - F.sum("p")) / F.greatest(1 - F.sum("_p"), F.lit(1e-12))).alias("alpha"))
            place(weights).repartition("bucket").write.mode("overwrite" if n == 2 else "append").partitionBy("n", "bucket").parquet(f"{folder}/histories")
        below = grams.select(F.col("h").alias("_h"), "w", F.col("p").alias("_p"))


def evaluate(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_tokens, score`` for every row: the model's log10 probability of the text and its end."""
    spark: SparkSession = docs.sparkSession
    totals = spark.read.parquet(f"{folder}/totals").first()
    order, unknown = totals["n"], float(-np.log10(totals["tokens"] + totals["kinds"] + 1))
    rows, ids = by_row(docs, id_col, text_col)
    source = rows.select("doc", text_bytes(F.col("text")).alias("text"))
    kind = source.schema["doc"].dataType.simpleString()
    names = [f"h{k}" for k in range(order)]

    def run(batch):
        for numbers, hashes, lengths in word_chunks(batch, lower=True):
            text, w, histories = _grams(hashes, lengths, order)
            docs_of = batch.column(0).take(pa.array(np.array(numbers)[text]))
            yield pa.RecordBatch.from_arrays([docs_of, pa.array(w.view(np.int64)), *(pa.array(h.view(np.int64)) for h in histories)], names=["doc", "w", *names])

    tokens = map_arrow(source, run, ", ".join([f"doc {kind}", "w long", *(f"{c} long" for c in names)]))
    open_ = staged(tokens.groupBy("doc", "w", *names).agg(F.count(F.lit(1)).alias("times")), "asked").withColumn("log", F.lit(0.0))
    grams, done = spark.read.parquet(f"{folder}/ngrams"), None
    for n in range(order, 0, -1):
        own = grams.where(F.col("n") == n).select(F.col("h").alias(f"h{n - 1}"), "w", "p")
        met = open_.join(own, [f"h{n - 1}", "w"], "left")
        if n > 1:
            weights = spark.read.parquet(f"{folder}/histories").where(F.col("n") == n).select(F.col("h").alias(f"h{n - 1}"), "alpha")
            met = met.join(weights, f"h{n - 1}", "left")
        met = staged(met, f"order{n}")
        here = met.where("p is not null").select("doc", "times", (F.col("log") + F.log10("p")).alias("log"))
        done = here if done is None else done.unionByName(here)
        rest = met.where("p is null")
        if n > 1:
            open_ = rest.select("doc", "w", *names, "times", (F.col("log") + F.log10(F.coalesce("alpha", F.lit(1.0)))).alias("log"))
        else:
            done = done.unionByName(rest.select("doc", "times", (F.col("log") + unknown).alias("log")))
    scores = done.groupBy("doc").agg(F.sum("times").alias("n_tokens"), F.sum(F.col("log") * F.col("times")).alias("score"))
    found = scores.withColumn("id", F.col("doc")) if ids is None else scores.join(ids, "doc")
    return found.select(F.col("id").alias(id_col), "n_tokens", "score")
