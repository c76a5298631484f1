"""Label-free quantification: areas, fragment selection and MaxLFQ."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pepspark.operators.relational import top_k
from pepspark.operators.windows import trapezoid_area


def ms1_area(points: DataFrame, keys: list[str], time: str, ab: str, axis: DataFrame | None = None, rt: str = "rt", first: int = 1, last: int = 7) -> DataFrame:
    """Area under the summed precursor intensities of time steps first..last, steps without a point being 0; null for groups
    without any point there.

    ``axis`` (``keys, time, rt``) has the steps' times, for data-independent runs; without it steps are one apart, as
    data-dependent runs take them.
    """
    inside = F.col(time).between(first, last)
    if axis is None:
        ends = F.when(F.col(time).isin(first, last), 0.5).otherwise(1.0)
        return points.groupBy(*keys).agg(F.sum(F.when(inside, F.col(ab) * ends)).alias("ms1_area"))
    w = Window.partitionBy(*keys).orderBy(time)
    step = (F.coalesce(F.lead(rt).over(w), F.col(rt)) - F.coalesce(F.lag(rt).over(w), F.col(rt))) / 2
    weights = axis.where(inside).select(*keys, time, step.alias("_w"))
    return points.join(weights, [*keys, time], "left").groupBy(*keys).agg(F.sum(F.when(inside, F.col(ab) * F.coalesce("_w", F.lit(0.0)))).alias("ms1_area"))


def apex_median(points: DataFrame, keys: list[str], time: str, ab: str) -> DataFrame:
    """Median of the positive intensities of the middle steps 3..5, 0 without any."""
    inside = F.col(time).between(3, 5) & (F.col(ab) > 0)
    return points.groupBy(*keys).agg(F.coalesce(F.median(F.when(inside, F.col(ab))), F.lit(0.0)).alias("apex_median_intensity"))


def fragment_scores(points: DataFrame, group: list[str], fragment: str, time: str, ab: str) -> DataFrame:
    """``r3, intensity``: cubed correlation of each fragment's chromatogram with the group's mean one, each scaled by its
    95th percentile; and the sum of steps 2..4 over the median positive one of the group.  Fragments without intensity there
    have a null r3."""
    scale = points.groupBy(*group, fragment).agg(F.percentile(ab, F.lit(0.95)).alias("_s"))
    scaled = points.join(scale, [*group, fragment]).withColumn("_v", F.when(F.col("_s") > 0, F.col(ab) / F.when(F.col("_s") > 0, F.col("_s"))).otherwise(0.0))
    mean = scaled.withColumn("_ref", F.avg("_v").over(Window.partitionBy(*group, time)))
    r = F.corr("_v", "_ref")
    r = F.coalesce(F.when(F.isnan(r), 0.0).otherwise(r), F.lit(0.0))
    each = mean.groupBy(*group, fragment).agg(F.pow(r, 3).alias("r3"), F.coalesce(F.sum(F.when(F.col(time).between(2, 4), F.col(ab).cast("double"))), F.lit(0.0)).alias("_sum"))
    middle = each.where("_sum > 0").groupBy(*group).agg(F.greatest(F.median("_sum"), F.lit(1e-9)).alias("_middle"))
    found = each.join(middle, group, "left")
    return found.select(*group, fragment, F.when(F.col("_sum") > 0, F.col("r3")).alias("r3"), F.coalesce(F.col("_sum") / F.col("_middle"), F.lit(0.0)).alias("intensity"))


def median_deviation(df: DataFrame, keys: list[str], value: str, name: str = "mad") -> DataFrame:
    """Median absolute deviation of the positive values' logarithms."""
    logs = df.where(F.col(value) > 0).withColumn("_l", F.log(value))
    middle = logs.groupBy(*keys).agg(F.median("_l").alias("_m"))
    return logs.join(middle, keys).groupBy(*keys).agg(F.median(F.abs(F.col("_l") - F.col("_m"))).alias(name))


def select_fragments(scores: DataFrame, precursor: list[str], fragment: str, k: int = 6, beta: float = 0.0) -> DataFrame:
    """The k fragments of each precursor that score best over runs: median r3, times exp(-beta * MAD of log intensity)."""
    merit = scores.groupBy(*precursor, fragment).agg(F.median("r3").alias("merit")).where("merit is not null")
    if beta:
        spread = median_deviation(scores, [*precursor, fragment], "intensity")
        merit = merit.join(spread, [*precursor, fragment], "left").withColumn("merit", F.col("merit") * F.exp(-beta * F.coalesce("mad", F.lit(0.0)))).drop("mad")
    return top_k(merit.withColumn("merit", F.round("merit", 6)), precursor, k, F.col("merit").desc(), F.col(fragment))


def ms2_area(points: DataFrame, selected: DataFrame, group: list[str], precursor: list[str], fragment: str, time: str, rt: str, ab: str) -> DataFrame:
    """Area under the mean chromatogram of the selected fragments, weighted by merit; 0 where the weights vanish."""
    chosen = points.join(selected, [*precursor, fragment])
    each = chosen.groupBy(*group, time).agg(F.sum(F.col(ab) * F.col("merit")).alias("_s"), F.sum("merit").alias("_w"), F.min(rt).alias(rt))
    curve = each.withColumn("_y", F.when(F.col("_w") < 1e-9, 0.0).otherwise(F.col("_s") / F.when(F.col("_w") >= 1e-9, F.col("_w"))))
    return trapezoid_area(curve, group, rt, "_y", "ms2_area")


def log_ratio_pairs(df: DataFrame, protein: str, peptide: str, run: str, abundance: str) -> DataFrame:
    """``protein, run_a, run_b, ratio, n``: median log ratio of each pair of runs over shared peptides.

    Pairs are of one peptide's runs: their number is bounded by the number of runs, not by a group's size.
    """
    logs = df.where(F.col(abundance) > 0).select(protein, peptide, run, F.log(abundance).alias("_l"))
    a = logs.select(protein, peptide, F.col(run).alias("run_a"), F.col("_l").alias("_a"))
    b = logs.select(protein, peptide, F.col(run).alias("run_b"), F.col("_l").alias("_b"))
    return a.join(b, [protein, peptide]).where("run_a < run_b").groupBy(protein, "run_a", "run_b").agg(F.median(F.col("_b") - F.col("_a")).alias("ratio"), F.count(F.lit(1)).alias("n"))


def max_lfq(df: DataFrame, protein: str, peptide: str, run: str, abundance: str, least_peptides: int = 1) -> DataFrame:
    """``protein, run, abundance``: MaxLFQ (Cox 2014) profiles, centred on the global median of the log abundances.

    Pair medians are Spark aggregates; only a protein's runs-by-runs system is solved in an Arrow kernel.
    """
    kept = df.where(F.col(abundance) > 0)
    enough = kept.groupBy(protein).agg(F.count_distinct(peptide).alias("_n")).where(F.col("_n") >= least_peptides).select(protein)
    kept = kept.join(enough, protein, "left_semi")
    pairs = log_ratio_pairs(kept, protein, peptide, run, abundance)
    runs = kept.select(protein, run).distinct()
    rows = runs.select(protein, F.col(run).alias("run_a"), F.lit(None).cast(kept.schema[run].dataType).alias("run_b"), F.lit(0.0).alias("ratio"), F.lit(0).cast("long").alias("n")).unionByName(pairs)

    def solve(g: pd.DataFrame) -> pd.DataFrame:
        names = sorted(g.loc[g["run_b"].isna(), "run_a"])
        place = {r: i for i, r in enumerate(names)}
        size = len(names)
        a, b = np.zeros((size, size)), np.zeros(size)
        for r in g[g["run_b"].notna()].itertuples():
            i, j = place[r.run_a], place[r.run_b]
            a[i, i] += r.n
            a[j, j] += r.n
            a[i, j] -= r.n
            a[j, i] -= r.n
            b[i] -= r.n * r.ratio
            b[j] += r.n * r.ratio
        x = np.linalg.lstsq(a, b, rcond=None)[0]
        return pd.DataFrame({protein: [g[protein].iloc[0]] * size, run: names, "_x": x - x.mean()})

    types = kept.schema
    solved = rows.groupBy(protein).applyInPandas(solve, f"{protein} {types[protein].dataType.simpleString()}, {run} {types[run].dataType.simpleString()}, _x double")
    level = kept.agg(F.median(F.log(abundance)).alias("_level"))
    return solved.crossJoin(F.broadcast(level)).select(protein, run, F.exp(F.col("_x") + F.col("_level")).alias("abundance"))  # one row
