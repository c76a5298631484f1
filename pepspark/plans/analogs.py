"""The fixture tables seen as tables of the domain, for Spark and, as SQL, for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def capitals(text):
    """a-z in upper case; other letters, which engines treat differently, as they are."""
    return F.translate(text, "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def matches(spark, sf_dir) -> DataFrame:
    """Peptide-spectrum matches: lines of orders; runs are shipping years modulo 4."""
    return table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey * 10 + l_linenumber AS pmsm_index",
        "CAST(year(l_shipdate) % 4 AS INT) AS run_index",
        "l_orderkey AS cluster",
        "l_partkey AS precursor_index",
        "l_partkey div 2 AS peptidoform_index",
        "l_suppkey AS protein",
        "l_extendedprice AS score",
        "l_partkey % 3 = 0 AS is_decoy",
        "CAST(datediff(l_shipdate, DATE'1992-01-01') AS DOUBLE) AS observed_rt",
        "l_quantity AS ab",
    )


MATCHES = """pmsm AS (SELECT l_orderkey * 10 + l_linenumber AS pmsm_index, CAST(year(l_shipdate) % 4 AS INT) AS run_index, l_orderkey AS cluster,
  l_partkey AS precursor_index, l_partkey // 2 AS peptidoform_index, l_suppkey AS protein, l_extendedprice AS score, l_partkey % 3 = 0 AS is_decoy,
  CAST(date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) AS DOUBLE) AS observed_rt, l_quantity AS ab FROM lineitem)"""


def proteins(spark, sf_dir) -> DataFrame:
    """Protein sequences: the residue letters of the documents' texts."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("protein_index"), F.regexp_replace(capitals(F.coalesce("text", F.lit(""))), "[^ARNDCEQGHILKMFPSTWYV]", "").alias("sequence"))


PROTEINS = "prot AS (SELECT doc_id AS protein_index, regexp_replace(translate(coalesce(text, ''), 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ'), '[^ARNDCEQGHILKMFPSTWYV]', '', 'g') AS sequence FROM documents)"


def peaks(spark, sf_dir) -> DataFrame:
    """Peaks: events; m/z is the value, frames are hours, runs are event types."""
    return table(spark, sf_dir, "events").selectExpr("event_id", "event_type AS run", "value AS mz", "CAST(user_id AS DOUBLE) AS ab", "CAST(floor(unix_micros(CAST(ts AS TIMESTAMP)) / 3600000000) AS BIGINT) AS frame_num", "unix_micros(CAST(ts AS TIMESTAMP)) / 1000000.0D AS time")


PEAKS = """peaks AS (SELECT event_id, event_type AS run, value AS mz, CAST(user_id AS DOUBLE) AS ab,
  CAST(floor(epoch_us(ts) / 3600000000) AS BIGINT) AS frame_num, CAST(epoch_us(ts) AS DOUBLE) / 1000000.0 AS time FROM events)"""


def theoretical(spark, sf_dir) -> DataFrame:
    """Theoretical m/z: ten times the part sizes."""
    return table(spark, sf_dir, "part").select((F.col("p_size") * F.lit(10.0)).alias("theo_mz")).distinct()


THEORETICAL = "theo AS (SELECT DISTINCT p_size * CAST(10.0 AS DOUBLE) AS theo_mz FROM part)"


def abundances(spark, sf_dir) -> DataFrame:
    """Protein, peptide, run and abundance: brands, parts, years and median prices."""
    return table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("p_brand").alias("protein"), F.col("p_partkey").alias("peptide"), F.year("l_shipdate").alias("run")).agg(F.median("l_extendedprice").alias("abundance"))


ABUNDANCES = """abd AS (SELECT p_brand AS protein, p_partkey AS peptide, CAST(year(l_shipdate) AS INT) AS run, median(l_extendedprice) AS abundance
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)"""


def vectors(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"), "label")
