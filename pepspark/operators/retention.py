"""Retention time: projection, polynomial calibration with bounds, alignment of runs, representative times."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pepspark.operators.relational import best_row
from pepspark.storage import staged


def project(df: DataFrame, reference: str, low: float, high: float, gradient: tuple[float, float], tolerance: float = 1 / 3) -> DataFrame:
    """Reference time in [low, high] on the run's gradient, with bounds of a fixed share of it."""
    a, b = gradient
    rt = a + (F.col(reference) - low) / (high - low) * (b - a)
    width = tolerance * (b - a)
    return df.withColumns({"predicted_rt": rt, "rt_low": F.greatest(F.lit(float(a)), rt - width), "rt_high": F.least(F.lit(float(b)), rt + width)})


def moments(df: DataFrame, keys: list[str], x: str, y: str, degree: int) -> DataFrame:
    """The sums of a least-squares polynomial, one row a group: one pass, combined before the shuffle."""
    powers = [F.sum(F.pow(F.col(x), F.lit(k))).alias(f"s{k}") for k in range(2 * degree + 1)]
    return df.groupBy(*keys).agg(*powers, *[F.sum(F.pow(F.col(x), F.lit(k)) * F.col(y)).alias(f"t{k}") for k in range(degree + 1)])


def fit_polynomials(df: DataFrame, keys: list[str], x: str, y: str, degree: int) -> DataFrame:
    """``keys, coefficients array<double>`` (constant first) of each group's fit; x is centred and scaled for the sums."""
    stats = df.groupBy(*keys).agg(F.avg(x).alias("_m"), F.coalesce(F.stddev_pop(x), F.lit(0.0)).alias("_s")).withColumn("_s", F.when(F.col("_s") > 0, F.col("_s")).otherwise(1.0))
    scaled = df.join(stats, keys) if keys else df.crossJoin(F.broadcast(stats))
    sums = moments(scaled.withColumn("_x", (F.col(x) - F.col("_m")) / F.col("_s")), [*keys, "_m", "_s"], "_x", y, degree)
    names = sums.columns

    def solve(batches):
        for rows in batches:
            out = []
            for r in rows.to_dict("records"):
                a = np.array([[r[f"s{i + j}"] for j in range(degree + 1)] for i in range(degree + 1)])
                c = np.linalg.lstsq(a, np.array([r[f"t{i}"] for i in range(degree + 1)]), rcond=None)[0]
                poly = np.polynomial.Polynomial([0.0])
                for k in range(degree, -1, -1):
                    poly = poly * np.polynomial.Polynomial([-r["_m"] / r["_s"], 1 / r["_s"]]) + c[k]
                out.append({**{k: r[k] for k in keys}, "coefficients": np.pad(poly.coef, (0, max(0, degree + 1 - len(poly.coef))))[: degree + 1].tolist()})
            yield pd.DataFrame(out, columns=[*keys, "coefficients"])

    fields = "".join(f"{k} {sums.schema[k].dataType.simpleString()}, " for k in keys)
    return sums.select(*names).mapInPandas(solve, f"{fields}coefficients array<double>")


def polynomial(coefficients, x):
    """The polynomial's value by Horner's rule."""
    return F.aggregate(F.reverse(coefficients), F.lit(0.0), lambda a, c: a * x + c)


def calibrate(train: DataFrame, keys: list[str], x: str, y: str, degree: int = 2, sigmas: float = 8.0, least: float = 0.15, most: float = 0.25, rows: DataFrame | None = None, gradient: DataFrame | None = None) -> DataFrame:
    """``rows`` (or the training rows) with ``predicted_rt, rt_low, rt_high``: a fitted time with bounds of its own.

    Residuals above and below the fit are fitted apart, as polynomials of the predicted time, so the bounds follow how far
    off times are there: ``sigmas`` times that, in the given shares of the run's ``gradient`` (``keys, first, last``; the
    training times' range where not given), and inside it.
    """
    fits = staged(fit_polynomials(train, keys, x, y, degree).withColumnRenamed("coefficients", "_fit"), "fits")
    value = polynomial(F.col("_fit"), F.col(x))
    off = train.join(F.broadcast(fits), keys).select(*keys, value.alias("_predicted"), (F.col(y) - value).alias("_off"))
    off = staged(off, "residuals")
    above = fit_polynomials(off.where("_off > 0"), keys, "_predicted", "_off", degree).withColumnRenamed("coefficients", "_above")
    below = fit_polynomials(off.where("_off < 0").withColumn("_off", -F.col("_off")), keys, "_predicted", "_off", degree).withColumnRenamed("coefficients", "_below")
    span = gradient if gradient is not None else train.groupBy(*keys).agg(F.min(y).alias("first"), F.max(y).alias("last"))
    model = fits.join(above, keys, "left").join(below, keys, "left").join(span.select(*keys, F.col("first").alias("_a"), F.col("last").alias("_b")), keys)
    placed = (train if rows is None else rows).join(F.broadcast(model), keys).withColumn("predicted_rt", value)  # a few numbers for each run
    size = F.col("_b") - F.col("_a")

    def width(c):
        return F.greatest(least * size, F.least(most * size, sigmas * F.coalesce(polynomial(F.col(c), F.col("predicted_rt")), F.lit(0.0))))

    low, high = F.col("predicted_rt") - width("_below"), F.col("predicted_rt") + width("_above")
    inside = lambda c: F.greatest(F.col("_a"), F.least(F.col("_b"), c))
    return placed.withColumns({"rt_low": inside(low), "rt_high": inside(high)}).drop("_fit", "_above", "_below", "_a", "_b")


def calibrate_run(matches: DataFrame, keys: list[str], reference: str, observed: str, q: str = "q_value", decoy: str = "is_decoy", quick: bool = True, second: bool = False, rows: DataFrame | None = None, gradient: DataFrame | None = None) -> DataFrame:
    """Calibration by confident targets: those of the quick search as they come, or of a full search within 1 %; of degree 5
    in the first search and 2 in the second."""
    train = matches.where(~F.col(decoy)) if quick else matches.where(~F.col(decoy) & (F.col(q) <= 0.01))
    return calibrate(train, keys, reference, observed, 2 if second else 5, rows=rows, gradient=gradient)


def align_runs(matches: DataFrame, run: str, precursor: str, rt: str, score: str, ident: str, degree: int = 2) -> DataFrame:
    """``aligned_rt``: every run's times on those of the run with the least index, by fits on shared precursors."""
    best = best_row(matches, [run, precursor], score, [ident])
    first = matches.agg(F.min(run).alias("_first"))
    reference = best.join(F.broadcast(first), F.col(run) == F.col("_first")).select(precursor, F.col(rt).alias("_ref"))
    shared = best.join(reference, precursor).select(run, precursor, rt, "_ref")
    fits = fit_polynomials(shared, [run], rt, "_ref", degree)
    moved = matches.join(F.broadcast(fits), run, "left").crossJoin(F.broadcast(first))  # one row a run
    return moved.withColumn("aligned_rt", F.when((F.col(run) == F.col("_first")) | F.col("coefficients").isNull(), F.col(rt)).otherwise(polynomial(F.col("coefficients"), F.col(rt)))).drop("coefficients", "_first")


def density_mode(df: DataFrame, keys: list[str], value: str, weight: str, bandwidth: float, name: str = "mode", pad: float = 2.0) -> DataFrame:
    """The grid point of highest weighted Gaussian density; one value is its own mode, of two the heavier wins.

    Grid points are half a bandwidth apart; a point meets only the grid within six bandwidths, so groups aren't crossed.
    """
    step, reach = bandwidth / 2, 6 * bandwidth
    w = Window.partitionBy(*keys)
    rows = df.withColumns({"_n": F.count(F.lit(1)).over(w), "_min": F.min(value).over(w), "_max": F.max(value).over(w)})
    few = best_row(rows.where("_n <= 2"), keys, weight, [value]).select(*keys, F.col(value).cast("double").alias(name))
    many = rows.where("_n > 2").withColumn("_g0", F.col("_min") - pad * bandwidth)
    last = F.ceil((F.col("_max") + pad * bandwidth - F.col("_g0")) / step)
    near_low, near_high = F.greatest(F.lit(0), F.ceil((F.col(value) - reach - F.col("_g0")) / step)), F.least(last, F.floor((F.col(value) + reach - F.col("_g0")) / step))
    points = many.withColumn("_k", F.explode(F.sequence(near_low.cast("long"), near_high.cast("long")))).withColumn("_x", F.col("_g0") + F.col("_k") * step)
    z = (F.col("_x") - F.col(value)) / bandwidth
    dense = points.groupBy(*keys, "_k", "_x").agg(F.sum(F.col(weight) * F.exp(-0.5 * z * z)).alias("_d"))
    modes = best_row(dense, keys, F.round("_d", 9), ["_k"]).select(*keys, F.col("_x").alias(name))
    return few.unionByName(modes)


def representative_times(matches: DataFrame, run: str, precursor: str, rt: str, score: str, bandwidth: float) -> DataFrame:
    """Representative time of each precursor: the density mode of its matches, weighted by their share of the run's score."""
    total = F.sum(score).over(Window.partitionBy(run, precursor))
    weighted = matches.withColumn("_w", F.when(total != 0, F.col(score) / F.when(total != 0, total)).otherwise(0.0))
    return density_mode(weighted, [precursor], rt, "_w", bandwidth, "representative_rt")
