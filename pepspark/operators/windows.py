"""Window operators: target-decoy q-values, local maxima, gap clusters, sliding sums and offsets."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pepspark.storage import ranged, staged


def q_values(df: DataFrame, score: str, decoy: str, ties: list[str], keys: list[str] = (), ratio: float = 1.0, pi0: float = 1.0, name: str = "q_value") -> DataFrame:
    """Target-decoy q-values: decoys so far * ratio * pi0 / targets so far, then the least of a row and all below.

    One ranking of the whole table, or one for each of ``keys`` (runs).  Rows are range-partitioned by rank and written
    once; windows run inside partitions, and each partition's counts before it and least rate after it (two numbers for
    each partition and key) make them whole.  So a ranking of any length is many tasks, and each window is one pass.
    """
    keys, single = list(keys), len(list(keys)) == 0
    placed = ranged(df, *keys, F.col(score).desc(), *(F.col(t).asc() for t in ties))
    is_decoy, is_target = F.col(decoy).cast("long"), (~F.col(decoy)).cast("long")
    part, near = [*keys, "_p"], Window.partitionBy(*keys, "_p")
    tidy = Window.partitionBy(*keys)
    sizes = placed.groupBy(*part).agg(F.sum(is_decoy).alias("_d"), F.sum(is_target).alias("_t"))
    before = tidy.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*part, F.coalesce(F.sum("_d").over(before), F.lit(0)).alias("_d0"), F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_t0"))
    so_far = near.orderBy("_i").rowsBetween(Window.unboundedPreceding, 0)
    decoys, targets = F.col("_d0") + F.sum(is_decoy).over(so_far), F.col("_t0") + F.sum(is_target).over(so_far)
    rate = F.when(targets > 0, decoys * F.lit(float(ratio * pi0)) / F.when(targets > 0, targets)).otherwise(F.lit(float("inf")))
    upwards = near.orderBy(F.desc("_i")).rowsBetween(Window.unboundedPreceding, 0)
    rated = _met(placed, offsets, part, single).withColumn("_rate", rate).withColumn("_own", F.min("_rate").over(upwards)).drop("_rate", "_d0", "_t0")
    rated = staged(rated, "rated")
    lows = rated.groupBy(*part).agg(F.min("_own").alias("_low"))
    after = tidy.orderBy(F.desc("_p")).rowsBetween(Window.unboundedPreceding, -1)
    rest = lows.select(*part, F.coalesce(F.min("_low").over(after), F.lit(float("inf"))).alias("_after"))
    return _met(rated, rest, part, single).withColumn(name, F.least("_own", "_after")).drop("_p", "_i", "_own", "_after")


def _met(rows: DataFrame, parts: DataFrame, on: list[str], single: bool) -> DataFrame:
    """``rows`` with the columns of their partition (and key; null keys are equal).  Without keys, one row for each
    partition is broadcast."""
    parts = parts.withColumnsRenamed({c: f"_on_{c}" for c in on})
    met = rows.join(F.broadcast(parts) if single else parts, reduce(and_, (F.col(c).eqNullSafe(F.col(f"_on_{c}")) for c in on)))
    return met.drop(*(f"_on_{c}" for c in on))


def grouped_q_values(df: DataFrame, group: list[str], score: str, decoy: str, ties: list[str], keys: list[str] = (), ratio: float = 1.0, name: str = "q_value") -> DataFrame:
    """q-values of groups by their best row, given to all rows; rows with a null in ``group`` stay with a null."""
    best = df.dropna(subset=group).groupBy(*keys, *group).agg(F.max(F.struct(score, decoy)).alias("_b"))
    best = best.select(*keys, *group, f"_b.{score}", *([] if decoy in group else [f"_b.{decoy}"]))
    ranked = q_values(best, score, decoy, list(group), keys, ratio, name=name)
    on = [*keys, *group]
    return df.join(ranked.select(*on, name), on, "left")


def running_total(df: DataFrame, order: list[str], value: str, name: str = "total") -> DataFrame:
    """``name``: the sum of a row's value and of all before it in a total order, in range partitions."""
    placed = ranged(df, *order)
    sums = placed.groupBy("_p").agg(F.sum(value).alias("_s"))
    offsets = sums.select("_p", F.coalesce(F.sum("_s").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = F.sum(value).over(Window.partitionBy("_p").orderBy("_i").rowsBetween(Window.unboundedPreceding, 0))
    return placed.join(F.broadcast(offsets), "_p").withColumn(name, F.col("_before") + inside).drop("_p", "_i", "_before")


def clip_positions(df: DataFrame, keys: list[str], position: str, low: Column | int, high: Column | int) -> DataFrame:
    """The distinct positions inside the bounds; all below count as the lower bound, all above as the upper."""
    low, high = (x if isinstance(x, Column) else F.lit(x) for x in (low, high))
    return df.select(*keys, F.greatest(low, F.least(high, F.col(position))).alias(position)).distinct()


def signal_to_noise(df: DataFrame, keys: list[str], value: str, name: str = "snr") -> DataFrame:
    """Largest value over the mean of the lowest fifth (rounded down); null for groups of fewer than five."""
    w = Window.partitionBy(*keys)
    ranked = df.select(*keys, value).withColumns({"_r": F.row_number().over(w.orderBy(value)), "_n": F.count(F.lit(1)).over(w)})
    low = F.avg(F.when(F.col("_r") <= F.floor(F.col("_n") * 0.2), F.col(value)))
    return ranked.groupBy(*keys).agg((F.max(value) / (low + 1e-9)).alias(name))


def weighted_median(df: DataFrame, keys: list[str], value: str, weight: str, name: str = "median") -> DataFrame:
    """The least value at which the weights of it and of all smaller ones make half of the group's."""
    sums = df.groupBy(*keys, value).agg(F.sum(weight).alias("_w"))
    w = Window.partitionBy(*keys)
    so_far = F.sum("_w").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    half = sums.withColumns({"_c": so_far, "_half": F.sum("_w").over(w) / 2})
    return half.groupBy(*keys).agg(F.coalesce(F.min(F.when(F.col("_c") >= F.col("_half"), F.col(value))), F.max(value)).alias(name))


def local_maxima(df: DataFrame, keys: list[str], position: str, value: str) -> DataFrame:
    """``keys, position``: middles (rounded down) of plateaus that are higher than both neighbours.

    The first and the last sample of a group never count.  Equal neighbours form an island; islands are compared.
    """
    w = Window.partitionBy(*keys).orderBy(position)
    changed = F.when(F.lag(value).over(w) == F.col(value), 0).otherwise(1)
    islands = df.withColumn("_c", changed).withColumn("_island", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    flat = islands.groupBy(*keys, "_island").agg(F.min(position).alias("_a"), F.max(position).alias("_b"), F.max(value).alias("_v"))
    v = Window.partitionBy(*keys).orderBy("_island")
    tops = flat.withColumns({"_before": F.lag("_v").over(v), "_after": F.lead("_v").over(v)}).where("_v > _before and _v > _after")
    return tops.select(*keys, F.floor((F.col("_a") + F.col("_b")) / 2).cast("long").alias(position), F.col("_v").alias(value))


def gap_clusters(df: DataFrame, keys: list[str], position: str, gap: int, name: str = "cluster") -> DataFrame:
    """``name``: 1, 2, ... by runs of positions with no gap above ``gap``."""
    w = Window.partitionBy(*keys).orderBy(position)
    far = (F.col(position) - F.lag(position).over(w) > gap).cast("int")
    return df.withColumn("_far", F.coalesce(far, F.lit(1))).withColumn(name, F.sum("_far").over(w.rangeBetween(Window.unboundedPreceding, 0)).cast("long")).drop("_far")


def cluster_peaks(df: DataFrame, keys: list[str], position: str, weight: str, gap: int = 2) -> DataFrame:
    """The heaviest position of each gap cluster, the first of equals."""
    from pepspark.operators.relational import best_row

    return best_row(gap_clusters(df, keys, position, gap), [*keys, "cluster"], weight, [position])


def dense_axis(df: DataFrame, keys: list[str], position: str, value: str, pad: int = 0) -> DataFrame:
    """Every position from a group's first to last, and ``pad`` beyond, with 0 where there is no row."""
    axis = df.groupBy(*keys).agg(F.min(position).alias("_a"), F.max(position).alias("_b")).select(*keys, F.explode(F.sequence(F.col("_a") - pad, F.col("_b") + pad)).alias(position))
    return axis.join(df.groupBy(*keys, position).agg(F.max(value).alias(value)), [*keys, position], "left").fillna(0, [value])


def sliding_sum(df: DataFrame, keys: list[str], position: str, value: str, radius: int, name: str) -> DataFrame:
    """Sum over positions within ``radius``, missing positions counting 0."""
    return df.withColumn(name, F.sum(value).over(Window.partitionBy(*keys).orderBy(position).rangeBetween(-radius, radius)))


def smoothed(df: DataFrame, keys: list[str], position: str, value: str, name: str) -> DataFrame:
    """Weights 1/4, 1/2, 1/4 over neighbours in order; beyond the ends counts 0."""
    w = Window.partitionBy(*keys).orderBy(position)
    return df.withColumn(name, F.col(value) / 2 + (F.coalesce(F.lag(value).over(w), F.lit(0)) + F.coalesce(F.lead(value).over(w), F.lit(0))) / 4)


def running_offsets(df: DataFrame, keys: list[str], order: list[str], size: str, start: str = "start", stop: str = "stop") -> DataFrame:
    """Where each row's items begin and end when all rows' items stand in one list."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(stop, F.sum(size).over(w)).withColumn(start, F.col(stop) - F.col(size))


def trapezoid_area(df: DataFrame, keys: list[str], x: str, y: str, name: str = "area") -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(x)
    part = (F.col(y) + F.lag(y).over(w)) / 2 * (F.col(x) - F.lag(x).over(w))
    return df.withColumn("_part", part).groupBy(*keys).agg(F.coalesce(F.sum("_part"), F.lit(0.0)).alias(name))


def monotone_bases(df: DataFrame, keys: list[str], position: str, value: str, apex: str) -> DataFrame:
    """``left, right``: how far values fall steadily on both sides of the apex position of each group."""
    w = Window.partitionBy(*keys).orderBy(position)
    near = df.withColumns({"_up": F.when(F.col(position) <= F.col(apex), F.col(value) <= F.lead(value).over(w)), "_down": F.when(F.col(position) >= F.col(apex), F.col(value) <= F.lag(value).over(w))})
    stop_left = F.max(F.when((F.col(position) < F.col(apex)) & ~F.col("_up"), F.col(position) + 1))
    stop_right = F.min(F.when((F.col(position) > F.col(apex)) & ~F.col("_down"), F.col(position) - 1))
    return near.groupBy(*keys, apex).agg(F.coalesce(stop_left, F.min(position)).alias("left"), F.coalesce(stop_right, F.max(position)).alias("right"))


def quantile_scores(df: DataFrame, keys: list[str], value: str, name: str = "z_score") -> DataFrame:
    """(x - median) / (upper - lower quartile) of the group, 0 where the quartiles meet."""
    quartiles = df.groupBy(*keys).agg(F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("_q"))
    spread = F.col("_q")[2] - F.col("_q")[0]
    return df.join(quartiles, keys).withColumn(name, F.when(spread == 0, F.lit(0.0)).otherwise((F.col(value) - F.col("_q")[1]) / F.when(spread != 0, spread))).drop("_q")


def when_column(pairs: list[tuple[Column, object]], other) -> Column:
    out = None
    for condition, value in pairs:
        out = F.when(condition, value) if out is None else out.when(condition, value)
    return out.otherwise(other)
