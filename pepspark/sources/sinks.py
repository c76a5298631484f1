"""Sinks: library tables, appended run results, reports and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pepspark.functions import columns as K


def write_library(tables: dict[str, DataFrame], folder: str, overwrite: bool = False) -> None:
    """Each table as ``folder/name``; without ``overwrite`` nothing is written if one is there."""
    spark = next(iter(tables.values())).sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    if not overwrite:
        for name in tables:
            path = jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
            if path.getFileSystem(conf).exists(path):
                raise FileExistsError(f"{folder}/{name}")
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")


def append_results(df: DataFrame, folder: str, keys: tuple[str, ...] = ("run_index",)) -> None:
    df.write.mode("append").partitionBy(*keys).parquet(folder)


def write_attributes(spark, folder: str, run_name: str, **values: float) -> None:
    """One row of a run's attributes, such as its cycle time; a later row of the run takes the place of an earlier one."""
    row = spark.createDataFrame([(run_name, {k: float(v) for k, v in values.items()})], "run_name string, attributes map<string,double>")
    row.withColumn("written", F.current_timestamp()).write.mode("append").parquet(folder)


def read_attributes(spark, folder: str) -> DataFrame:
    """``run_name, name, value``: each attribute of each run as last written."""
    each = spark.read.parquet(folder).select("run_name", "written", F.explode("attributes").alias("name", "value"))
    return each.groupBy("run_name", "name").agg(F.max_by("value", "written").alias("value"))


def read_columns(spark, path: str, columns: list[str]) -> DataFrame:
    """The columns that a result table has of those asked for; others are left out.  Only these are scanned."""
    found = spark.read.parquet(path)
    return found.select(*[c for c in columns if c in found.columns])


def write_training(df: DataFrame, folder: str, length: str = "sequence_length") -> None:
    """Training examples in one folder for each sequence length, so that a batch of equal lengths is one scan."""
    df.write.mode("overwrite").partitionBy(length).parquet(folder)


def training_statistics(df: DataFrame, length: str = "sequence_length", charge: str = "precursor_charge", energy: str = "collision_energy") -> DataFrame:
    """``kind, value, n``: examples in all and by length, charge and collision energy, in one pass."""
    sets = [[], [F.col(length)], [F.col(charge)], [F.col(energy)]]
    kind = F.when(F.grouping(length) == 0, length).when(F.grouping(charge) == 0, charge).when(F.grouping(energy) == 0, energy).otherwise("total")
    value = F.coalesce(F.col(length).cast("double"), F.col(charge).cast("double"), F.col(energy).cast("double"))
    counted = df.groupingSets(sets, F.col(length), F.col(charge), F.col(energy)).agg(F.count(F.lit(1)).alias("n"), kind.alias("kind"))
    return counted.select("kind", value.alias("value"), "n")


def flat(df: DataFrame) -> DataFrame:
    """Array columns as text with semicolons, for text formats."""
    return df.select(*[K.list_text(F.col(f"`{c}`")).alias(c) if t.startswith("array") else F.col(f"`{c}`") for c, t in df.dtypes])


def summary_text(summary: DataFrame) -> str:
    """The identification summary (a row for each run and one for all) as aligned lines for a log."""
    rows = [summary.columns] + [["all runs" if x is None else str(x) for x in r] for r in summary.orderBy(F.col(summary.columns[0]).asc_nulls_last()).collect()]
    widths = [max(len(r[i]) for r in rows) for i in range(len(rows[0]))]
    return "\n".join("  ".join(x.rjust(w) if i else x.ljust(w) for i, (x, w) in enumerate(zip(r, widths, strict=True))) for r in rows)


def write_report(df: DataFrame, path: str, kind: str = "tsv") -> None:
    if kind == "tsv":
        flat(df).write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)
    elif kind == "parquet":
        df.write.mode("overwrite").parquet(path)
    else:
        raise ValueError(f"report format {kind}")
