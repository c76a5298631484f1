"""Queries that SQL can't express, against NumPy and plain loops, and the kernels that they use."""

import hashlib
import itertools
import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from pepspark.functions import columns as K
from pepspark.operators import inference as I
from pepspark.operators import quantify as Q
from pepspark.operators import retention as T
from pepspark.operators import signals, spectra
from pepspark.plans import analogs as A
from pepspark.plans import registry
from pepspark.sources import sinks, tables

FOLDER = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the driver's tables")


def test_isotope_patterns(spark):
    rows = {(r["mass"], r["isotope_index"]): r for r in registry.QUERIES["src14_isotope_patterns"](spark, FOLDER).collect()}
    assert len(rows) == 68 * 3
    for mass in (300, 1500, 4000):
        shares = np.zeros(40)
        shares[0] = 1
        for element, n in tables.AVERAGE_RESIDUE.items():
            for _ in range(round(n * mass / tables.AVERAGE_MASS)):  # one atom after another
                shares = sum(np.r_[np.zeros(k), shares[: 40 - k]] * p for k, p in enumerate(tables.ISOTOPES[element]))
        for i in range(3):
            assert rows[mass, i]["predicted_intensity"] == pytest.approx(shares[i] / shares[:3].max(), rel=1e-6)
            assert rows[mass, i]["rank"] == 1 + sum(shares > shares[i] * (1 + 1e-12))


@needs_tables
def test_match_clusters(spark):
    got = {(r["g"], r["l_orderkey"]): r["cluster"] for r in registry.QUERIES["dom14_match_clusters"](spark, FOLDER).collect()}
    lines = spark.read.parquet(f"{FOLDER}/lineitem.parquet").select("l_orderkey", "l_suppkey", F.expr("datediff(l_shipdate, DATE'1992-01-01')").alias("day")).toPandas()
    groups = {}
    for order, own in lines.groupby("l_orderkey"):
        groups.setdefault(own["l_suppkey"].min(), []).append((own["day"].min(), order, set(own["l_suppkey"])))
    for g, rows in groups.items():
        leaders = []
        for day, order, peaks in sorted(rows, key=lambda x: x[:2]):
            fits = [c for c, (d, other) in enumerate(leaders) if day - d <= 30 and len(peaks & other) >= 0.6 * len(peaks | other)]
            if not fits:
                leaders.append((day, peaks))
            assert got[g, order] == (fits[-1] if fits else len(leaders) - 1)
    assert len(got) == lines["l_orderkey"].nunique()


@needs_tables
def test_protein_inference(spark):
    got = {r["precursor_index"]: (r["protein_group"], r["master_protein"]) for r in registry.QUERIES["dom19_protein_inference"](spark, FOLDER).collect()}
    edges = {tuple(r) for r in spark.read.parquet(f"{FOLDER}/lineitem.parquet").select("l_orderkey", "l_suppkey").collect()}
    members = {}
    for order, supplier in edges:
        members.setdefault(supplier, set()).add(order)
    open_, chosen = {o for o, _ in edges}, []
    while open_:  # the protein that covers most of what is left, over the whole table
        best = min(members, key=lambda p: (-len(members[p] & open_), p))
        chosen.append(best)
        open_ -= members[best]
    for order in {o for o, _ in edges}:
        group = sorted(p for p in chosen if order in members[p])
        assert got[order] == (";".join(map(str, group)), max(group, key=lambda p: (len(members[p]), -p)))


@needs_tables
def test_logistic_scorer(spark):
    """The scores are those of the penalised optimum, found here by Newton's method on the training half."""
    got = registry.QUERIES["dom20_logistic_scorer"](spark, FOLDER).toPandas().set_index("peptide_index")
    table = spark.read.parquet(f"{FOLDER}/embeddings.parquet").select("vec_id", "embedding", "label").toPandas()
    x, decoy = np.array(table["embedding"].tolist(), float), (table["label"] < 5).to_numpy()
    train = ~decoy | np.array([int(hashlib.md5(f"928:{i}".encode()).hexdigest()[:8], 16) % 100 < 50 for i in table["vec_id"]])
    scale = x[train].std(0, ddof=1)
    z = np.c_[np.ones(len(x)), x / scale]
    y, w, penalty = (~decoy[train]).astype(float), np.zeros(z.shape[1]), 0.01 * np.diag([0.0] + [1.0] * x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-z[train] @ w))
        w -= np.linalg.solve((z[train].T * (p * (1 - p))) @ z[train] / len(y) + penalty, z[train].T @ (p - y) / len(y) + penalty @ w)
    np.testing.assert_allclose(got.loc[table["vec_id"], "score"], z @ w, atol=0.02)
    assert list(got.loc[table["vec_id"], "is_decoy"]) == list(decoy)


def fitted(x, y, degree):
    return np.polynomial.Polynomial.fit(x, y, degree)


@needs_tables
def test_calibration_bounds(spark):
    out = T.calibrate(A.matches(spark, FOLDER), ["run_index"], "score", "observed_rt", 2).toPandas()
    assert len(out) == registry.QUERIES["dom21b_calibration_bounds"](spark, FOLDER).count() == A.matches(spark, FOLDER).count()
    for _, own in out.groupby("run_index"):
        x, y = own["score"].to_numpy(float), own["observed_rt"].to_numpy()
        p = fitted(x, y, 2)(x)
        off, size = y - p, y.max() - y.min()
        above, below = fitted(p[off > 0], off[off > 0], 2)(p), fitted(p[off < 0], -off[off < 0], 2)(p)
        width = lambda w: np.clip(8 * w, 0.15 * size, 0.25 * size)  # noqa: E731, B023
        np.testing.assert_allclose(own["predicted_rt"], p, atol=0.01)
        np.testing.assert_allclose(own["rt_low"], np.clip(p - width(below), y.min(), y.max()), atol=0.05)
        np.testing.assert_allclose(own["rt_high"], np.clip(p + width(above), y.min(), y.max()), atol=0.05)


def test_bounds_follow_the_residuals(spark):
    """Where times scatter little, bounds are at their least; where they scatter much, at their most."""
    rng = np.random.default_rng(5)
    rows = [(1, float(x), 10.0 * x + float(rng.normal()) * (0.1 if x < 500 else 400.0)) for x in range(1000)]
    out = T.calibrate(spark.createDataFrame(rows, "run int, x double, y double"), ["run"], "x", "y", 2).toPandas()
    size = out["y"].max() - out["y"].min()
    width = ((out["rt_high"] - out["predicted_rt"]) / size).to_numpy()
    assert width[300] == pytest.approx(0.15, abs=0.01) and width[700] > 0.17


@needs_tables
def test_alignment(spark):
    m = T.align_runs(A.matches(spark, FOLDER), "run_index", "precursor_index", "observed_rt", "score", "pmsm_index").toPandas()
    assert len(m) == registry.QUERIES["dom22_alignment"](spark, FOLDER).count()
    best = m.sort_values(["score", "pmsm_index"], ascending=[False, True]).drop_duplicates(["run_index", "precursor_index"])
    first = best[best["run_index"] == m["run_index"].min()].set_index("precursor_index")["observed_rt"]
    for run, own in m.groupby("run_index"):
        want = own["observed_rt"].to_numpy()
        if run != m["run_index"].min():
            shared = best[(best["run_index"] == run) & best["precursor_index"].isin(first.index)]
            want = fitted(shared["observed_rt"].to_numpy(), first[shared["precursor_index"]].to_numpy(), 2)(want)
        np.testing.assert_allclose(own["aligned_rt"], want, atol=0.01)


@needs_tables
def test_max_lfq_of_table(spark):
    got = {(r["protein"], r["run"]): r["abundance"] for r in registry.QUERIES["dom28_max_lfq"](spark, FOLDER).collect()}
    table = A.abundances(spark, FOLDER).toPandas()
    table = table[table["abundance"] > 0]
    level = np.median(np.log(table["abundance"]))
    assert len(got) == len(table[["protein", "run"]].drop_duplicates())
    for protein, own in table.groupby("protein"):
        wide = np.log(own.pivot(index="peptide", columns="run", values="abundance"))
        runs, rows, values = list(wide.columns), [], []
        for i, j in itertools.combinations(range(len(runs)), 2):
            both = (wide[runs[j]] - wide[runs[i]]).dropna()
            if len(both):
                weight = np.sqrt(len(both))
                rows.append([weight * ((k == j) - (k == i)) for k in range(len(runs))])
                values.append(weight * np.median(both))
        x = np.linalg.lstsq(np.array(rows), np.array(values), rcond=None)[0] if rows else np.zeros(len(runs))
        np.testing.assert_allclose([got[protein, r] for r in runs], np.exp(x - x.mean() + level), rtol=1e-5, atol=2e-3)


def test_savitzky_golay():
    rng = np.random.default_rng(2)
    y = rng.random(60)
    want = [np.polynomial.Polynomial.fit(np.arange(11), y[a : a + 11], 3)(i - a) for i in range(60) for a in [min(max(i - 5, 0), 49)]]
    np.testing.assert_allclose(signals.savitzky_golay(y), want)
    cubic = np.arange(40.0) ** 3 - 7 * np.arange(40.0)
    np.testing.assert_allclose(signals.savitzky_golay(cubic), cubic, atol=1e-9)


def test_peak_widths():
    x = np.arange(200.0)
    y = 100 * np.exp(-0.5 * ((x - 60) / 8) ** 2) + 40 * np.exp(-0.5 * ((x - 140) / 4) ** 2) + 5 * np.exp(-0.5 * ((x - 20) / 1.0) ** 2)
    found = signals.peak_widths(y, 10, 0.01, 5)
    assert [a for a, _, _ in found] == [60, 140]
    assert [r - a for _, a, r in found] == pytest.approx([2.3548 * 8, 2.3548 * 4], rel=0.02)
    assert signals.peak_widths(np.array([0, 1, 3, 3, 3, 1, 0.0]), 1, 0.1, 1) == [(3, 1.25, 4.75)]
    assert signals.peak_widths(np.zeros(5), 0, 0, 0) == []


def test_chromatographic_width(spark):
    times = 2.0 * np.arange(300)
    rows = [("r", i + 1, mz + 0.2, float(1000 * np.exp(-0.5 * ((times[i] - centre) / 20) ** 2) + 1)) for mz, centre in ((450, 200), (500, 300), (900, 300)) for i in range(300)]
    peaks = spark.createDataFrame(rows, "run_name string, frame_num int, mz double, ab double")
    frames = spark.createDataFrame([("r", i + 1, float(t)) for i, t in enumerate(times)], "run_name string, frame_num int, time_in_seconds double")
    out = signals.chromatographic_width(peaks, frames).collect()
    assert len(out) == 1 and out[0]["n_peaks"] == 2 and out[0]["lc_peak_width"] == pytest.approx(2.3548 * 20, abs=4)


def test_schemes_that_are_refused(spark):
    good = [(i * 10 + k, 400.0 + 20 * k, 420.0 + 20 * k) for i in range(3) for k in range(5)]
    frame = lambda rows: spark.createDataFrame(rows, "frame_num int, isolation_min_mz double, isolation_max_mz double")
    assert {r["kind"] for r in spectra.checked_scheme(frame(good)).collect()} == {"regular"}
    with pytest.raises(ValueError, match="overlap"):
        spectra.checked_scheme(frame([*good, (99, 410.0, 412.0)]))
    with pytest.raises(ValueError, match="varies"):
        spectra.checked_scheme(frame([(100 * k + i, 400.0 + 20 * k, 420.0 + 20 * k) for k in range(7) for i in range(k + 1)]))


def test_global_analysis_with_proteins(spark):
    rows = [(i, i, i // 2, 10.0 - i, i in (5, 7, 9), [i % 3] if i < 5 else [i % 3, 7]) for i in range(10)]
    matches = spark.createDataFrame(rows, "pmsm_index int, precursor_index int, peptidoform_index int, score double, is_decoy boolean, protein_index array<int>")
    found = I.global_analysis(matches, proteins="protein_index", cutoff=0.5)
    out = {r["precursor_index"]: r for r in I.with_global(matches, found).collect()}
    assert len(out) == 10 and out[0]["protein_group"] is not None and out[0]["global_protein_group_q_value"] == 0.0
    assert {r["is_decoy"] for r in out.values() if r["global_precursor_q_value"] > 0.5 and r["protein_group"] is not None} == set()


def test_ms1_area_by_acquisition(spark):
    points = spark.createDataFrame([(1, 2, 4.0), (1, 2, 6.0), (1, 4, 10.0), (2, 8, 5.0)], "g int, t int, ab double")
    axis = spark.createDataFrame([(g, t, float(t * t)) for g in (1, 2) for t in range(1, 8)], "g int, t int, rt double")
    y, x = np.array([0, 10, 0, 10, 0, 0, 0.0]), np.arange(1, 8.0) ** 2
    assert {r["g"]: r["ms1_area"] for r in Q.ms1_area(points, ["g"], "t", "ab", axis).collect()} == {1: pytest.approx(np.trapezoid(y, x)), 2: None}
    assert {r["g"]: r["ms1_area"] for r in Q.ms1_area(points, ["g"], "t", "ab").collect()} == {1: pytest.approx(np.trapezoid(y)), 2: None}


def test_halves_are_rounded_by_their_binary_product(spark):
    """1.005 * 100 is below 100.5; areas of half prices are such halves."""
    values = [1.005, -1.005, 2.675, 50082.785, 0.125, -0.125, 1e300, float("inf"), None]
    want = [x if x is None or abs(x) > 1e15 else math.copysign(math.floor(abs(x) * 100 + 0.5) / 100, x) for x in values]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(values)], "i int, x double")
    assert [r["y"] for r in rows.select("i", K.rounded("x", 2).alias("y")).orderBy("i").collect()] == want


def test_run_attributes_and_training_tables(spark, tmp_path):
    sinks.write_attributes(spark, f"{tmp_path}/a", "r1", cycle_time=1.5, gradient=3000)
    sinks.write_attributes(spark, f"{tmp_path}/a", "r2", cycle_time=2)
    sinks.write_attributes(spark, f"{tmp_path}/a", "r1", cycle_time=1.25)
    assert {(r["run_name"], r["name"]): r["value"] for r in sinks.read_attributes(spark, f"{tmp_path}/a").collect()} == {("r1", "cycle_time"): 1.25, ("r1", "gradient"): 3000.0, ("r2", "cycle_time"): 2.0}
    sinks.write_training(spark.range(10).selectExpr("id", "id % 3 AS sequence_length"), f"{tmp_path}/t")
    assert sorted(os.listdir(tmp_path / "t"))[-3:] == [f"sequence_length={k}" for k in range(3)]
    assert sinks.read_columns(spark, f"{tmp_path}/t", ["id", "missing"]).columns == ["id"]
    text = sinks.summary_text(spark.createDataFrame([(None, 3), (0, 2)], "run int, n int"))
    assert [x.split() for x in text.splitlines()] == [["run", "n"], ["0", "2"], ["all", "runs", "3"]]
