"""The corpus pipeline: five stages, each written as Parquet and read again before the next.

toxicity        documents that the model rejects go
jaccard_join    one document of each group of near copies (80 % of shingles of 5 words) stays, the one with the smallest id
decontaminate   documents that share a window of 10 words with a benchmark item go
secrets         strong and linked secret spans are replaced by ``[kind]``
sentencepiece   the last: what is left, encoded to piece ids, with the text decoded again

Each stage works on all that its predecessor kept.  All but the last return the columns of ``documents``.

Every row is a document of its own: ids may repeat or be null, and what a stage decides of one row leaves others with its
id alone.  Rows with null or empty texts are clean, in no group, and stay, with null or empty text and no pieces.  Texts are
taken whole.  An empty table comes out empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pepspark.llm.common import shared_dir, staged, table
from pepspark.llm.decontaminate import decontaminate
from pepspark.llm.jaccard_join import near_components
from pepspark.llm.pieces import encode
from pepspark.llm.secrets import redact_secrets
from pepspark.llm.toxicity import fit, score


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = docs.select(F.struct(*docs.columns).alias("_row"), "text")
    return score(rows, fit(docs, table(spark, sf_dir, "labels"))).where("score < 0.5").select("_row.*")


def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` and a column that no two rows share: the id, or where ids repeat or are null, numbers in a staged table."""
    if docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or doc_id is null").isEmpty():
        return docs, "doc_id"
    return staged(docs.withColumn("_row", F.monotonically_increasing_id()), "numbered"), "_row"


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group the row with the least id stays (null ids last; of rows that share it, the least text)."""
    rows, key = _numbered(docs)
    found = near_components(rows.select(key, "text"), key)
    if key == "doc_id":
        gone = found.where("doc <> component").select(F.col("doc").alias(key))
    else:
        found = staged(rows.join(found.withColumnRenamed("doc", key), key).select(key, "component", F.struct(F.col("doc_id").isNull(), "doc_id", "text", key).alias("order")), "found")
        first = staged(found.groupBy("component").agg(F.min("order").alias("least")), "first")
        gone = found.join(first, "component").where(~F.col("order").eqNullSafe(F.col("least"))).select(key)
    return rows.join(gone, key, "left_anti").select(docs.columns)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows, key = _numbered(docs)
    hit = decontaminate(rows.select(key, "text"), table(spark, sf_dir, "benchmark"), key).where("n_hit > 0").select(key)
    return rows.join(hit, key, "left_anti").select(docs.columns)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return redact_secrets(docs).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    done = encode(docs, decoded=True)
    same = F.col("decoded") == F.translate(F.coalesce("text", F.lit("")), "▁", " ")
    return done.select("doc_id", "text", "ids", F.size("ids").cast("long").alias("n_pieces"), same.alias("round_trip"))


STAGES = [
    ("toxicity", toxicity),
    ("jaccard_join", jaccard_join),
    ("decontaminate", benchmark),
    ("secrets", secrets),
    ("sentencepiece", sentencepiece),
]

#: No SQL expresses the fitted toxicity model; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    shared_dir(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name)
    return docs
