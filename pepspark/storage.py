"""Tables written once and read again in the folder that driver and executors share."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PLACE_BITS = 33  # of a row's place in its partition, as monotonically_increasing_id has it


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it.

    Where none is set, a local session gets a temporary one; on a cluster no folder of one machine would do.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(f"{tempfile.gettempdir()}/pepspark-shared")
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


def staged(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again: cuts lineage, outlives executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/pepspark-{uuid.uuid4().hex}/{name}"
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where.getParent())
    return spark.read.schema(df.schema).parquet(path)


def drop_staged(df: DataFrame) -> None:
    """Deletes a staged table and lets Spark drop the shuffle files of plans that nothing refers to any more."""
    jvm, conf = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)
    free_shuffles(df.sparkSession)


def free_shuffles(spark: SparkSession) -> None:
    """Spark's cleaner removes the shuffle files of a plan once the driver has collected its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def ranged(df: DataFrame, *order: Column | str) -> DataFrame:
    """``df`` in a total order over range partitions, written once, with ``_p`` and ``_i``: a row's partition and its
    place there.  Both are stored, so whatever is derived from them agrees."""
    at = F.monotonically_increasing_id()
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_i", at)
    kept = staged(rows, "ranged")
    return kept.withColumn("_p", F.shiftright("_i", PLACE_BITS)).withColumn("_i", F.col("_i").bitwiseAND(F.lit((1 << PLACE_BITS) - 1)))
