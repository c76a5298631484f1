"""Toxicity by maximum-scoring segments over token log-odds.

Fit: on a bounded sample of labelled rows (``MAX_LABELLED``, the documented bound), document counts of tokens by class
give log-odds with an informative Dirichlet prior; tokens whose odds stand out are the lexicon, every other token pays
``DRIFT``.  The linear-time scan of a text's token scores finds all its maximal scoring segments; their scores, put on
the extreme-value scale that the clean part of the sample fits, are a logistic model's inputs, fitted on rows that did
not shape the lexicon.  The model (lexicon of at most ``MAX_TERMS`` terms) is small by these bounds and goes to all tasks.

Score: every whole text, row by row, without a shuffle.  Null and empty texts get the score of a text without tokens.
Labels that are null count as missing, repeated labels of an id as toxic if one is.  Without labels of both
classes the score is the share of toxic rows (0 if there are none).  Rows are scored one by one, whatever their ids; texts
of any length are read once.  Where segments tie, the earlier one counts.  ``score`` keeps all columns and replaces ones that
are called ``score`` or ``passages``.  An empty table gives no rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pepspark.llm.common import bounded_batches, map_arrow, staged, table, text_bytes

MAX_LABELLED = 16_384
MAX_TERMS = 4_096
LEAST_DOCUMENTS = 4
LEAST_Z = 4.0
PRIOR = 50.0
DRIFT = 0.15
SIGNIFICANT = 0.05

_ASCII = bytes(c | 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def tokens(data: bytes) -> list[bytes]:
    """Lower-cased runs of letters, digits and bytes beyond ASCII."""
    return data.translate(_ASCII).split()


#: Lengths in bytes of the word beginnings that are terms too, so that inflected forms count with their stems.
STEMS = (4, 5, 6, 7, 8)
KNOWN_WORDS = 200_000


def terms_of(word: bytes) -> list[bytes]:
    """The word, and its beginnings, marked."""
    return [word, *(word[:k] + b"*" for k in STEMS if len(word) > k)]


@dataclass
class Model:
    terms: dict[bytes, float] = field(default_factory=dict)
    drift: float = DRIFT
    rate: float = 1.0
    log_k: float = 0.0
    weights: tuple[float, ...] = ()
    share: float = 0.0
    known: dict[bytes, float] = field(default_factory=dict, repr=False)

    def of(self, word: bytes) -> float:
        """The best score of the word's terms, 0 if none is in the lexicon; remembered for frequent words."""
        value = self.known.get(word)
        if value is None:
            if len(self.known) > KNOWN_WORDS:
                self.known.clear()
            value = self.known[word] = max((self.terms.get(x, 0.0) for x in terms_of(word)), default=0.0)
        return value


def segments(hits: list[tuple[int, float]], drift: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score) of a sequence with positive ``hits`` (position, score) and
    ``-drift`` elsewhere; the linear-time list method: each candidate keeps the sums before and after it."""
    found: list[list] = []  # start, end, sum before, sum after
    total, at = 0.0, 0
    for position, score in hits:
        total -= drift * (position - at)
        left, total, at = total, total + score, position + 1
        start = position
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= left:
                j = found[j][4]
            if j < 0 or found[j][3] >= total:
                found.append([start, at, left, total, j])
                break
            start, left = found[j][0], found[j][2]
            del found[j:]
    return [(a, b, after - before) for a, b, before, after, _ in found]


def passages(data: bytes, model: Model) -> tuple[int, list[tuple[int, int, float]]]:
    """Number of tokens, and the maximal segments with their log expected number by chance (lower: rarer)."""
    words = tokens(data)
    get, of = model.known.get, model.of
    hits = [(i, s) for i, w in enumerate(words) if (s := v if (v := get(w)) is not None else of(w))]
    spread = math.log(max(1, len(words)))
    return len(words), [(a, b, spread + model.log_k - model.rate * s) for a, b, s in segments(hits, model.drift)]


def features(length: int, found: list[tuple[int, int, float]]) -> list[float]:
    """What the logistic model sees: rarity of the best segment, of all significant ones together, their share."""
    best = min((e for _, _, e in found), default=5.0)
    strong = [(a, b, e) for a, b, e in found if e < math.log(SIGNIFICANT)]
    total = sum(-e for _, _, e in strong)
    return [1.0, min(10.0, max(-5.0, -best)), math.log1p(total), math.log1p(len(strong)), sum(b - a for a, b, _ in strong) / max(1, length), math.log1p(length) / 10]


def probability(weights, x) -> float:
    z = sum(a * b for a, b in zip(weights, x, strict=True))
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def held_out(id_col: Column, modulus: int = 5) -> Column:
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % modulus == 0


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, bound: int = MAX_LABELLED) -> DataFrame:
    """``_id, _text, _toxic, _part``: at most ``bound`` labelled documents, those with the smallest hashes of ids."""
    rows = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_toxic")).where("_id is not null and _toxic is not null")
    rows = rows.where(~held_out(F.col("_id"))).groupBy("_id").agg(F.max("_toxic").alias("_toxic"))
    chosen = rows.orderBy(F.xxhash64("_id"), "_id").limit(bound)
    texts = docs.select(F.col(id_col).alias("_id"), text_bytes(F.col(text_col)).alias("_text"))
    found = texts.join(F.broadcast(chosen), "_id")  # at most `bound` rows of two numbers
    return staged(found.withColumn("_part", F.pmod(F.xxhash64("_text"), F.lit(4))), "labelled")


def term_scores(counts: list[tuple[bytes, int, int]], toxic: int, clean: int) -> dict[bytes, float]:
    """Log-odds with a Dirichlet prior that follows the terms' shares in both classes, where they stand out."""
    out = []
    size = toxic + clean
    for term, a, b in counts:
        prior = PRIOR * (a + b) / size
        odds = math.log((a + prior) / (toxic + PRIOR - a - prior)) - math.log((b + prior) / (clean + PRIOR - b - prior))
        z = odds / math.sqrt(1 / (a + prior) + 1 / (b + prior))
        if z >= LEAST_Z and odds > 0:
            out.append((z, term, odds))
    out.sort(key=lambda x: (-x[0], x[1]))
    return {term: odds for _, term, odds in out[:MAX_TERMS]}


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    sample = labelled_sample(docs, labels, id_col, text_col, label_col)
    sizes = {(r["_toxic"], r["_shapes"]): r["n"] for r in sample.groupBy("_toxic", (F.col("_part") > 0).alias("_shapes")).agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, clean, all_rows = sizes.get((1, True), 0), sizes.get((0, True), 0), sum(sizes.values())
    share = sum(n for (y, _), n in sizes.items() if y == 1) / all_rows if all_rows else 0.0
    if not (toxic and clean and sizes.get((1, False)) and sizes.get((0, False))):
        return Model(share=share)

    def count(batch):
        seen: dict[bytes, list[int]] = {}
        for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for term in {x for w in set(tokens(text)) for x in terms_of(w)}:
                seen.setdefault(term, [0, 0])[0 if y else 1] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array([x[0] for x in seen.values()], pa.int64()), pa.array([x[1] for x in seen.values()], pa.int64())], names=["term", "a", "b"])

    shaping = sample.where("_part > 0").dropDuplicates(["_text"])
    counts = map_arrow(shaping.select("_text", "_toxic"), count, "term binary, a long, b long").groupBy("term").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    # of the terms that a toxic row in more than its share has, the most frequent ones
    likely = counts.where((F.col("a") + F.col("b") >= LEAST_DOCUMENTS) & (F.col("a") * clean > F.col("b") * toxic))
    odd = (F.col("a") / toxic - F.col("b") / clean) / F.sqrt(F.col("a") + F.col("b"))
    rows = likely.orderBy(odd.desc(), "term").limit(4 * MAX_TERMS).collect()
    model = Model(term_scores([(bytes(r["term"]), r["a"], r["b"]) for r in rows], toxic, clean), share=share)

    def scan(batch):
        rows = []
        for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            length, found = passages(text, model)
            rows.append((y, length, [-e + math.log(max(1, length)) for _, _, e in found]))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.list_(pa.float64())), strict=True)], names=["y", "length", "scores"])

    rest = map_arrow(sample.where("_part = 0").select("_text", "_toxic"), scan, "y int, length long, scores array<double>").collect()
    # extreme values of the clean rows: the best score less log length has a Gumbel law of this rate and place
    best = np.array([max(r["scores"]) - math.log(max(1, r["length"])) for r in rest if not r["y"] and r["scores"]])
    if len(best) >= 10 and best.std() > 0:
        model.rate = min(2.0, max(0.25, math.pi / (best.std() * math.sqrt(6))))
        model.log_k = model.rate * best.mean() - 0.5772156649015329
    inputs, wanted = [], []
    for r in rest:
        spread = math.log(max(1, r["length"]))
        inputs.append(features(r["length"], [(0, 1, spread + model.log_k - model.rate * s) for s in r["scores"]]))
        wanted.append(r["y"])
    model.weights = logistic(np.array(inputs), np.array(wanted, dtype=float))
    return model


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 30) -> tuple[float, ...]:
    """Ridge logistic regression by Newton's method."""
    w = np.zeros(x.shape[1])
    penalty = ridge * np.eye(x.shape[1])
    penalty[0, 0] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + penalty, x.T @ (p - y) + penalty @ w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(w.tolist())


PASSAGES = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("log_expected", T.DoubleType())]))


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with ``score double`` and ``passages``: the significant segments as token spans."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most MAX_TERMS terms
    limit = math.log(SIGNIFICANT)
    bounded_batches(docs.sparkSession)

    @F.pandas_udf(T.StructType([T.StructField("score", T.DoubleType()), T.StructField("passages", PASSAGES)]))
    def run(texts):
        import pandas as pd

        model, rows = shared.value, []
        for text in texts:
            length, found = passages(bytes(text), model)
            value = probability(model.weights, features(length, found)) if model.weights else model.share
            rows.append((value, [{"start": a, "end": b, "log_expected": e} for a, b, e in found if e < limit]))
        return pd.DataFrame(rows, columns=["score", "passages"])

    name = "_toxicity"
    return docs.withColumn(name, run(text_bytes(F.col(text_col)))).withColumns({"score": F.col(f"{name}.score"), "passages": F.col(f"{name}.passages")}).drop(name)


def op8_toxicity(spark, sf_dir: str) -> DataFrame:
    """Every document's score, with the model fitted on the labelled rows that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"), F.size("passages").cast("long").alias("n_passages"))
