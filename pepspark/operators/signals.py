"""Smoothing and peak widths of long chromatograms."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def savitzky_golay(y: np.ndarray, window: int = 11, order: int = 3) -> np.ndarray:
    """Least-squares polynomials in a sliding window; the ends take the values of the first and the last whole window's."""
    half, n = window // 2, len(y)
    if n < window:
        return y.astype(float)
    basis = np.vander(np.arange(-half, half + 1), order + 1, increasing=True)
    fits = np.linalg.pinv(basis)  # coefficients from a window's values
    out = np.convolve(y, fits[0][::-1], "same")
    out[:half] = basis[:half] @ (fits @ y[:window])
    out[n - half :] = basis[half + 1 :] @ (fits @ y[n - window :])
    return out


def peak_widths(y: np.ndarray, height: float, prominence: float, width: float, rel_height: float = 0.5) -> list[tuple[int, float, float]]:
    """(apex, left, right) of the local maxima that are high, prominent and wide enough; left and right are where the signal
    falls by ``rel_height`` of the prominence, between samples by straight lines.  A plateau's apex is its middle."""
    out, i, n = [], 1, len(y)
    while i < n - 1:
        if y[i - 1] < y[i]:
            j = i + 1
            while j < n - 1 and y[j] == y[i]:
                j += 1
            if y[j] < y[i]:
                found = _width_at(y, (i + j - 1) // 2, prominence, rel_height)
                if y[i] >= height and found is not None and found[1] - found[0] >= width:
                    out.append(((i + j - 1) // 2, *found))
                i = j
        i += 1
    return out


def _width_at(y: np.ndarray, apex: int, prominence: float, rel_height: float) -> tuple[float, float] | None:
    top = y[apex]
    higher = np.flatnonzero(y[:apex] > top)
    first = higher[-1] + 1 if len(higher) else 0
    higher = np.flatnonzero(y[apex + 1 :] > top)
    last = apex + higher[0] if len(higher) else len(y) - 1
    rise = top - max(y[first : apex + 1].min(), y[apex : last + 1].min())
    if rise < prominence:
        return None
    level = top - rel_height * rise
    below = np.flatnonzero(y[first : apex + 1] <= level)
    left = float(first + below[-1]) if len(below) else float(first)
    if len(below) and y[int(left)] < level:
        left += (level - y[int(left)]) / (y[int(left) + 1] - y[int(left)])
    below = np.flatnonzero(y[apex : last + 1] <= level)
    right = float(apex + below[0]) if len(below) else float(last)
    if len(below) and y[int(right)] < level:
        right -= (level - y[int(right)]) / (y[int(right) - 1] - y[int(right)])
    return left, right


def chromatographic_width(peaks: DataFrame, frames: DataFrame, mz: str = "mz", ab: str = "ab", frame: str = "frame_num", time: str = "time_in_seconds", low: float = 400.0, high: float = 800.0, least: int = 33) -> DataFrame:
    """``run_name, lc_peak_width, n_peaks``: median width at half height of the peaks of first-level chromatograms.

    Peaks are summed by whole m/z and frame before they leave their tasks; each m/z with ``least`` peaks or more is one
    smoothed trace over the run's frames, the unit that an Arrow kernel holds.
    """
    axis = frames.groupBy("run_name").agg(F.array_sort(F.collect_list(F.struct(F.col(frame).cast("long").alias("frame"), F.col(time).cast("double").alias("time")))).alias("axis"))
    cells = peaks.where(F.col(mz).between(low, high)).groupBy("run_name", F.floor(mz).alias("bin"), F.col(frame).cast("long").alias("frame")).agg(F.sum(ab).cast("double").alias("ab"), F.count(F.lit(1)).alias("n"))
    traces = cells.groupBy("run_name", "bin").agg(F.sum("n").alias("n"), F.collect_list(F.struct("frame", "ab")).alias("cells")).where(F.col("n") >= least).join(axis, "run_name")

    def run(batches):
        for batch in batches:
            names, widths = [], []
            for name, cells, axis in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                where, times = axis.values.field("frame").to_numpy(), axis.values.field("time").to_numpy()
                own = cells.values.field("ab").to_numpy()
                y = np.zeros(len(where))
                y[np.searchsorted(where, cells.values.field("frame").to_numpy())] = own
                for _, left, right in peak_widths(savitzky_golay(y), float(np.median(own)) * 1.4, 0.01, 5):
                    names.append(name.as_py())
                    widths.append(float(times[int(right)] - times[int(left)]))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(widths, pa.float64())], names=["run_name", "width"])

    found = traces.select("run_name", "cells", "axis").mapInArrow(run, "run_name string, width double")
    return found.groupBy("run_name").agg(F.median("width").alias("lc_peak_width"), F.count(F.lit(1)).alias("n_peaks"))
