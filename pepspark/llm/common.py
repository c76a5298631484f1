"""Helpers the training-data operators share: tables, staged files, words, hashes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pepspark.storage import drop_staged, free_shuffles, shared_dir, staged  # noqa: F401  for the operators

#: ASCII white space, as ``bytes.split()`` without arguments sees it.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def by_row(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame | None]:
    """``doc, text`` with a key that no other row has, and ``doc, id`` if that key isn't the id.

    Ids that are unique serve as they are.  Where one repeats or is null, rows are numbered in a staged table, so that
    every row is a document of its own.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    if rows.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or id is null").isEmpty():
        return rows.withColumnRenamed("id", "doc"), None
    kept = staged(rows.select(F.monotonically_increasing_id().alias("doc"), "id", "text"), "rows")
    return kept.select("doc", "text"), kept.select("doc", "id")


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case; every other character as it is."""
    return F.translate(text, UPPER, LOWER)


def text_bytes(text: Column) -> Column:
    return F.coalesce(text.cast("binary"), F.lit(b"").cast("binary"))


#: Texts are long rows: no more of them go to Python at once, unless the session names fewer.
BATCH_ROWS = 2_000


def bounded_batches(spark: SparkSession) -> None:
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """mapInArrow with batches of a bounded number of rows."""
    bounded_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


def map_arrow(df: DataFrame, rows: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``map_batches`` over ``rows(batch)``, which yields the batches made from one input batch."""

    def run(batches):
        for batch in batches:
            yield from rows(batch)

    return map_batches(df, run, schema)


class WordHashes(dict):
    """64-bit hashes by word; frequent words are hashed once."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


KNOWN_WORDS = 200_000


def hash_words(words: list[bytes], known: WordHashes) -> np.ndarray:
    if len(known) > KNOWN_WORDS:
        known.clear()
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


_MULT = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def mix(values: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    values = (values ^ (values >> np.uint64(30))) * _MIX
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def word_chunks(batch: pa.RecordBatch, lower: bool = False, size: int = 100_000) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """Texts (second column, bytes) of a batch as (row numbers, word hashes one text after another, lengths), in
    chunks of about ``size`` words, so that memory follows the chunk and one text, not the batch."""
    known = WordHashes()
    rows, hashes, count = [], [], 0
    for row, data in enumerate(batch.column(1)):
        data = data.as_py() or b""
        rows.append(row)
        hashes.append(hash_words((data.translate(_LOWER) if lower else data).split(), known))
        count += len(hashes[-1])
        if count >= size:
            yield rows, np.concatenate(hashes), np.array([len(h) for h in hashes])
            rows, hashes, count = [], [], 0
    if rows:
        yield rows, np.concatenate(hashes), np.array([len(h) for h in hashes])


_LOWER = bytes(c | 32 if 65 <= c <= 90 else c for c in range(256))


def ngram_hashes(hashes: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """Hash of every run of n consecutive words, from the words' hashes."""
    count = len(hashes) - n + 1
    if count <= 0:
        return np.empty(0, dtype=np.uint64)
    out = np.full(count, seed * 2 + 1, dtype=np.uint64)
    for k in range(n):
        out = mix(out * _MULT + hashes[k : k + count])
    return out
