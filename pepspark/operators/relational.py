"""Relational operators that Spark has no name for: whole-row extremes, dense ids, interval and nearest joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pepspark.storage import ranged


def best_row(df: DataFrame, keys: list[str], score: Column | str, ties: list[str], ascending: bool = False) -> DataFrame:
    """The whole row with the largest (smallest) score of each group; ties go to the least ``ties``.  A row without a
    score (null, NaN) wins only where no row of its group has one.

    An aggregate with partial combination: the shuffle carries one row for each group and task, whatever a group's size.
    """
    value = F.col(score) if isinstance(score, str) else score
    order = F.struct(value.isNull().alias("_none"), (-value if not ascending else value).alias("_s"), *ties)
    row = F.min_by(F.struct(*df.columns), order)
    return df.groupBy(*keys).agg(row.alias("_row")).select("_row.*")


def top_k(df: DataFrame, keys: list[str], k: int, *order: Column) -> DataFrame:
    """The first k rows of each group; Spark limits groups before the shuffle."""
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_rank") <= k).drop("_rank")


def keep_one(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each group by a total order, whatever the order of rows in the table."""
    return top_k(df, keys, 1, *order)


def distinct_with_null(value: Column | str) -> Column:
    """Number of distinct values, null being one."""
    value = F.col(value) if isinstance(value, str) else value
    return F.count_distinct(value) + F.max(value.isNull().cast("int"))


def dense_id(df: DataFrame, order: list[Column | str], name: str) -> DataFrame:
    """``name``: 0, 1, 2, ... in a total order, without a single-task window.

    Rows are range-partitioned and written once; a row's number is its place in its partition after the sizes of those
    before, one number for each partition.
    """
    placed = ranged(df, *order)
    sizes = placed.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    offsets = sizes.select("_p", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return placed.join(F.broadcast(offsets), "_p").withColumn(name, F.col("_before") + F.col("_i")).drop("_p", "_i", "_before")


def batches(df: DataFrame, keys: list[str], size: int, order: list[str], name: str = "batch") -> DataFrame:
    """Rows of a key in slices of ``size``, in order."""
    return df.withColumn(name, F.floor((F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1) / size).cast("long"))


def interval_join(left: DataFrame, right: DataFrame, low: str, high: str, value: str, width: Column | float, keys: list[str] = ()) -> DataFrame:
    """Inner join on ``left.low <= right.value <= left.high`` and equal ``keys``.

    Both sides meet on bins of ``width``: an interval goes to each bin that it touches, a value to its own, and the exact
    bounds decide.  An equi-join, which Spark shuffles, broadcasts or splits by itself; choose ``width`` near the
    intervals' length.
    """
    width = F.lit(float(width)) if not isinstance(width, Column) else width
    a = left.withColumn("_bin", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))))
    b = right.withColumn("_bin", F.floor(F.col(value) / width))
    return a.join(b, [*keys, "_bin"]).where(F.col(value).between(F.col(low), F.col(high))).drop("_bin")


def ppm_join(theoretical: DataFrame, peaks: DataFrame, mz: str, peak_mz: str, ppm: float, keys: list[str] = ()) -> DataFrame:
    """Inner join of peaks within ``ppm`` of a theoretical m/z, bounds included.

    Bins are logarithmic, of the tolerance's own width, so an interval touches three or so at any m/z.
    """
    step = F.log1p(F.lit(2 * ppm * 1e-6))
    low, high = F.col(mz) * (1 - ppm * 1e-6), F.col(mz) * (1 + ppm * 1e-6)
    a = theoretical.where(F.col(mz) > 0).withColumns({"_low": F.col(mz) - F.col(mz) * ppm * 1e-6, "_high": F.col(mz) + F.col(mz) * ppm * 1e-6})
    a = a.withColumn("_bin", F.explode(F.sequence(F.floor(F.log(low) / step).cast("long") - 1, F.floor(F.log(high) / step).cast("long") + 1)))
    b = peaks.where(F.col(peak_mz) > 0).withColumn("_bin", F.floor(F.log(F.col(peak_mz)) / step).cast("long"))
    return a.join(b, [*keys, "_bin"]).where(F.col(peak_mz).between(F.col("_low"), F.col("_high"))).drop("_bin", "_low", "_high")


def nearest_join(left: DataFrame, right: DataFrame, time: str, right_time: str, right_id: str, keys: list[str] = (), name: str = "nearest") -> DataFrame:
    """``left`` with ``name``: the id of the right row nearest in time, the earlier one of two as near, the least id of
    equal times.  Rows with a null time, or without any right row of their keys, get null.
    """
    found = neighbours(left, right, time, right_time, right_id, keys)
    nearest = F.when(F.col("_t").isNull(), None).when(F.col("_a").isNull() | (F.col("_t") - F.col("_b.t") <= F.col("_a.t") - F.col("_t")), F.col("_b.id")).otherwise(F.col("_a.id"))
    return found.select("_row.*", nearest.alias(name))


def neighbours(left: DataFrame, right: DataFrame, time: str, right_time: str, right_id: str, keys: list[str] = ()) -> DataFrame:
    """``_row`` (of ``left``), ``_t`` (its time), ``_b`` and ``_a`` (``t``, ``id``): the last right row of the same keys that
    is not after it, and the first that is not before it; of equal times the least id.

    Both tables are ranged by time together.  Running windows in each partition give the last right row before and the
    first one after; each partition's outermost right rows are carried to its neighbours.  So the work is linear and
    neither a time nor a key of any frequency makes a hot task.
    """
    kind = left.select(F.struct(*left.columns)).schema[0].dataType
    own = left.select(*keys, F.col(time).cast("double").alias("_t"), F.struct(*left.columns).alias("_row"), F.lit(None).cast(right.schema[right_id].dataType).alias("_id"), F.xxhash64(*left.columns).alias("_h"))
    other = right.where(F.col(right_time).isNotNull()).groupBy(*keys, F.col(right_time).cast("double").alias("_t")).agg(F.min(right_id).alias("_id"))
    other = other.select(*keys, "_t", F.lit(None).cast(kind).alias("_row"), "_id", F.lit(0).cast("long").alias("_h"))
    both = own.unionByName(other).withColumn("_side", F.col("_row").isNotNull())
    placed = ranged(both, *keys, "_t", "_side", "_h")
    point = F.when(~F.col("_side"), F.struct(F.col("_t").alias("t"), F.col("_id").alias("id")))
    ends = placed.where("not _side").groupBy(*keys, "_p").agg(F.max(point).alias("_last"), F.min(point).alias("_first"))
    parts = placed.select(*keys, "_p").distinct().join(ends, [*keys, "_p"], "left")
    tidy = Window.partitionBy(*keys)
    carried = parts.select(
        *keys,
        "_p",
        F.max("_last").over(tidy.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)).alias("_earlier"),
        F.min("_first").over(tidy.orderBy(F.desc("_p")).rowsBetween(Window.unboundedPreceding, -1)).alias("_later"),
    )
    within = Window.partitionBy(*keys, "_p")
    found = placed.withColumns(
        {
            "_b": F.last(point, True).over(within.orderBy("_i").rowsBetween(Window.unboundedPreceding, 0)),
            "_a": F.last(point, True).over(within.orderBy(F.desc("_i")).rowsBetween(Window.unboundedPreceding, 0)),
        }
    ).where("_side")
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in [*keys, "_p"]]
    return found.alias("l").join((F.broadcast(carried) if not keys else carried).alias("r"), same).select("l._t", "_row", F.coalesce("_b", "_earlier").alias("_b"), F.coalesce("_a", "_later").alias("_a"))


def normalised(df: DataFrame, keys: list[str], value: str, name: str, by: str = "sum") -> DataFrame:
    """``name``: the value's share of its group's sum or largest value."""
    total = getattr(F, by)(value).over(Window.partitionBy(*keys))
    return df.withColumn(name, F.when(total != 0, F.col(value) / total))


def star_join(facts: DataFrame, *dimensions: tuple[DataFrame, str]) -> DataFrame:
    """``facts`` left-joined with each (dimension, key); Spark broadcasts the dimensions that are small enough."""
    for dimension, key in dimensions:
        facts = facts.join(dimension, key, "left")
    return facts
