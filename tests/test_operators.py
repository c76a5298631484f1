"""Hand-computed cases of the analytics operators."""

import base64
import gzip
import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pepspark import config
from pepspark.functions import columns as K
from pepspark.functions import constants as C
from pepspark.operators import digest as D
from pepspark.operators import inference as I
from pepspark.operators import quantify as Q
from pepspark.operators import relational as R
from pepspark.operators import retention as T
from pepspark.operators import spectra
from pepspark.operators import windows as W
from pepspark.sources import readers, sinks, tables


def one(spark, expression):
    return spark.range(1).select(expression.alias("x")).first()["x"]


def test_q_values(spark):
    rows = spark.createDataFrame([(6 - i, 6.0 - i, bool(d)) for i, d in enumerate((0, 0, 1, 0, 1, 1))], "id int, score double, is_decoy boolean")
    want = [0, 0, 1 / 3, 1 / 3, 2 / 3, 1]
    assert [r["q_value"] for r in W.q_values(rows, "score", "is_decoy", ["id"]).orderBy(F.desc("score")).collect()] == pytest.approx(want)


@pytest.mark.parametrize(("adaptive", "partitions"), [("true", 4), ("true", 37), ("false", 5)])
def test_wide_tables_keep_all_rows(spark, adaptive, partitions):
    """Ids and q-values of tables with more columns than the ranking needs, one key holding half of the rows."""
    n = 100_000
    shared = spark.conf.get("spark.sql.adaptive.enabled"), spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.enabled", adaptive), spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        rows = spark.range(n).select(
            "id", F.pmod(F.xxhash64("id"), F.lit(5000)).cast("double").alias("score"), (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(3)) == 0).alias("is_decoy"),
            F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id") % 7).cast("int").alias("run"), F.sha2(F.col("id").cast("string"), 256).alias("wide"), F.array("id", "id").alias("list"),
        )
        table = rows.toPandas().sort_values(["score", "id"], ascending=[False, True])
        numbered = R.dense_id(rows, ["wide", "id"], "n").select("id", "n", "list").toPandas()
        assert sorted(numbered["n"]) == list(range(n))
        assert list(numbered.sort_values("n")["id"]) == list(table.sort_values("wide")["id"])
        for keys in ([], ["run"]):
            got = W.q_values(rows, "score", "is_decoy", ["id"], keys).select("id", "q_value", "wide", "list").toPandas().set_index("id")["q_value"]
            assert len(got) == n
            for _, own in table.groupby(keys) if keys else [(None, table)]:
                decoys = own["is_decoy"].to_numpy()
                rate = np.cumsum(decoys) / np.maximum(np.cumsum(~decoys), 1)
                rate[np.cumsum(~decoys) == 0] = np.inf
                np.testing.assert_allclose(got[own["id"]], np.minimum.accumulate(rate[::-1])[::-1])
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", shared[0]), spark.conf.set("spark.sql.shuffle.partitions", shared[1])


def test_best_row_without_score(spark):
    rows = spark.createDataFrame([(1, 1, 5.0), (1, 2, None), (1, 3, float("nan")), (2, 4, None), (2, 5, None)], "g int, id int, score double")
    for ascending in (False, True):
        assert {r["g"]: r["id"] for r in R.best_row(rows, ["g"], "score", ["id"], ascending).collect()} == {1: 1, 2: 4}


def test_nearest_join_against_brute_force(spark):
    rng = np.random.default_rng(3)
    left = [(i, int(rng.integers(0, 3)), float(rng.integers(0, 400)) / 4) for i in range(3000)] + [(9000, 0, None), (9001, 9, 1.0)]
    right = [(i, int(rng.integers(0, 3)), float(rng.integers(0, 400)) / 2) for i in range(150)]
    a = spark.createDataFrame(left, "id int, g int, t double").repartition(7)
    b = spark.createDataFrame(right, "rid int, g int, rt double")
    got = {r["id"]: r["nearest"] for r in R.nearest_join(a, b, "t", "rt", "rid", ["g"]).collect()}
    assert len(got) == len(left)
    for i, g, t in left:
        near = sorted((abs(rt - t), rt, rid) for rid, h, rt in right if h == g) if t is not None else []
        assert got[i] == (near[0][2] if near else None)


def test_match_clusters_against_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = [(int(rng.integers(0, 2)), int(rng.integers(0, 40)), i, sorted({int(x) for x in rng.integers(0, 8, 4)} | {-1})) for i in range(300)]
    df = spark.createDataFrame(rows, "g int, frame int, id int, peaks array<int>")
    got = {(r["g"], r["id"]): r["cluster"] for r in I.cluster_matches(df, ["g"], "frame", "id", "peaks", 3, 0.5).collect()}
    for g in (0, 1):
        leaders = []
        for _, frame, i, peaks in sorted((x for x in rows if x[0] == g), key=lambda x: (x[1], x[2])):
            own = set(peaks) - {-1}
            fits = [c for c, (f, other) in enumerate(leaders) if frame - f <= 3 and len(own & other) >= 0.5 * len(own | other)]
            if not fits:
                leaders.append((frame, own))
            assert got[g, i] == (fits[-1] if fits else len(leaders) - 1)


def test_digest(spark):
    df = D.digest(spark.createDataFrame([(1, "MAKRPEPK"), (2, "")], "protein_index int, sequence string"), min_len=1)
    assert {r["peptide"] for r in df.collect()} == {"<MAK.", "_R.", "_PEPK>", "<MAKR.", "_RPEPK>", "<AK.", "<AKR."}


def test_time_bins(spark):
    """The nearest frame of each bin by brute force, with ties and keys; no frame of a bin but its middle's neighbours is met."""
    centres = [(k, i, t) for k in ("a", "b", None) for i, t in enumerate((0.0, 3.5, 10.0, 10.0))]
    frames = [(k, n, t) for k in ("a", None) for n, t in ((9, 0.0), (8, 0.0), (7, 1.0), (1, 3.0), (6, 4.0), (5, 10.5), (4, 9.5), (3, 20.0))]
    left = spark.createDataFrame([*centres, centres[0]], "k string, c int, t double")
    right = spark.createDataFrame(frames, "k string, f int, at double")
    for keys in ([], ["k"]):
        pairs = [(c, f) for c in centres for f in frames if not keys or c[0] == f[0] is not None]
        want = set()
        for c in centres:
            for b in range(-4, 5):
                mid = c[2] + b * 2.0
                own = [(abs(f[2] - mid), f[1], f[2]) for x, f in pairs if x == c and mid - 1 <= f[2] <= mid + 1]
                want |= {(*c, b, min(own)[2], min(own)[1])} if own else set()
        rows = left if keys else left.withColumnRenamed("k", "own")
        got = spectra.time_bins(rows, right if keys else right.drop("k"), keys, "t", "at", "f", 2.0)
        found = [tuple(r) for r in got.collect()]
        assert len(found) == len(want) and set(found) == want
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "_bin" not in plan  # no join of all frames of a bin


@pytest.mark.parametrize("kind", ["long", "string"])
def test_cover_of_large_components(spark, kind):
    """Greedy choices one by one, for ids of any type and in one component of many proteins."""
    name = (lambda p: p) if kind == "long" else (lambda p: f"P{p}")
    spread = np.random.default_rng(5).integers(0, 40, (300, 4))
    pairs = {(i, name(int(p))) for i, row in enumerate(spread) for p in row}
    members = {p: {i for i, q in pairs if q == p} for _, p in pairs}
    open_, chosen = set(range(300)), set()
    while open_:
        best = min(members, key=lambda p: (-len(members[p] & open_), p))
        chosen.add(best)
        open_ -= members[best]
    got = I.infer_proteins(spark.createDataFrame(sorted(pairs), f"precursor_index long, protein {kind}")).collect()
    assert len(got) == 300
    for r in got:
        own = sorted(p for i, p in pairs if i == r["precursor_index"] and p in chosen)
        assert r["protein_group"] == ";".join(map(str, own))
        assert r["master_protein"] == min(own, key=lambda p: (-len(members[p]), p))


def test_ions_without_rows_of_their_own(spark):
    """Summaries and libraries made where the peptide stands are those of the table of ions, which no sort or join touches."""
    texts = ["_PEPTIDEK.", "_AAAAAAAAAAAAAAAAAAAAAAAAAAAAAA.", "<MK>", "_G.", "", None, "_PEBZÄTIDE.", "_" + "ACDEFGHIKLMNPQRSTVWY" * 3 + "."]
    peptides = spark.createDataFrame(list(enumerate(texts)), "precursor_index int, peptide string")
    for phospho in (False, True):
        ions = D.fragments(peptides, phospho=phospho)
        want = ions.groupBy("precursor_index").agg(F.count(F.lit(1)), F.sum("cleavage_index"), F.min("mz"), F.max("mz"), F.sum("mz")).collect()
        got = {r[0]: r[1:] for r in D.fragment_summary(peptides, phospho=phospho).collect()}
        assert got.keys() == {r[0] for r in want}
        for r in want:
            assert got[r[0]] == pytest.approx(r[1:])
    ions = D.fragments(peptides).withColumn("predicted_intensity", F.round(F.exp(-F.abs(F.col("mz") - 600) / 300), 1))  # many ties
    columns = ["precursor_index", "cleavage_index", "is_prefix", "charge", "rank"]
    for size, least in ((16, 1e-4), (5, 0.25), (1000, 0.0)):
        want = sorted(tuple(r) for r in D.spectral_library(ions, size=size, least=least).select(*columns, F.round("predicted_intensity", 6)).collect())
        library = D.predicted_library(peptides, lambda mz: np.floor(np.exp(-np.abs(mz - 600) / 300) * 10 + 0.5) / 10, size=size, least=least)
        assert sorted(tuple(r) for r in library.select(*columns, F.round("predicted_intensity", 6)).collect()) == want
    plan = library._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan


def test_decoys(spark):
    assert one(spark, K.decoy_by_map(F.lit("_PEPTIDEK."))) == "_PDPTIDDK."
    assert one(spark, K.decoy_reversed(F.lit("_PEPTIDEK."))) == "_EDITPEPK."


def test_modification_numbers(spark):
    assert one(spark, K.mod_id(F.lit(4), F.lit(0), F.lit("C"), F.lit(True))) == 266433
    assert one(spark, K.mod_id(F.lit(35), F.lit(0), F.lit("M"), F.lit(False))) == 2298688
    assert one(spark, K.mod_id(F.lit(1), F.lit(3), F.lit("*"), F.lit(False))) == 92800
    text = K.modified_sequence(F.lit("_AGDQTLSSCVSHK."), F.array(F.lit(266433)), F.array(F.lit(9)))
    assert one(spark, text) == "_AGDQTLSSC(UniMod:4)VSHK."
    assert one(spark, K.parsed_sequence(text)["sites"]) == [9]


def test_modify(spark):
    forms = D.modify(spark.createDataFrame([("<MCM.",)], "peptide string"), [("Carbamidomethyl", "C", "anywhere", True), ("Oxidation", "M", "anywhere", False), ("Acetyl", "*", "protein_n_term", False)], 2)
    assert sorted(r["mod_sites"] for r in forms.collect()) == [[2], [2, 0], [2, 1], [2, 1, 0], [2, 1, 3], [2, 3], [2, 3, 0]]


def test_masses(spark):
    assert one(spark, K.precursor_mz(D.peptide_mass(F.lit("_PEPTIDE.")), F.lit(2))) == pytest.approx(400.6873, abs=1e-4)
    assert one(spark, K.composition(F.lit("C(2) H3O"))) == {"C": 2, "H": 3, "O": 1}
    assert one(spark, K.normal_cdf(F.lit(1.0))) == pytest.approx(0.841345, abs=1e-6)


def test_maxima_and_clusters(spark):
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate([0, 1, 1, 0, 2, 0])], "g int, p int, v int")
    assert sorted(r["p"] for r in W.local_maxima(df, ["g"], "p", "v").collect()) == [1, 4]
    df = spark.createDataFrame([(1, p, w) for p, w in zip((3, 4, 6, 10, 11), (1, 5, 5, 2, 2))], "g int, p int, w int")
    assert sorted(r["p"] for r in W.cluster_peaks(df, ["g"], "p", "w", 2).collect()) == [4, 10]


def test_z_scores_and_jaccard(spark):
    df = W.quantile_scores(spark.createDataFrame([(1, float(i)) for i in range(1, 6)], "g int, x double"), ["g"], "x")
    assert [r["z_score"] for r in df.orderBy("x").collect()] == [-1, -0.5, 0, 0.5, 1]
    assert one(spark, K.jaccard(F.array(*map(F.lit, (1, 2, 3, -1))), F.array(*map(F.lit, (2, 3, 4, -1))))) == 0.5


def test_cover(spark):
    edges = spark.createDataFrame([(1, 0), (2, 0), (3, 0), (3, 1), (4, 1), (4, 2)], "precursor_index int, protein int")
    assert {r["precursor_index"]: r["protein_group"] for r in I.infer_proteins(edges).collect()} == {1: "0", 2: "0", 3: "0;1", 4: "1"}


def test_max_lfq(spark):
    df = spark.createDataFrame([("P", "A", 1, 100.0), ("P", "A", 2, 200.0), ("P", "B", 1, 50.0), ("P", "B", 2, 200.0)], "protein string, peptide string, run int, abundance double")
    assert [r["abundance"] for r in Q.max_lfq(df, "protein", "peptide", "run", "abundance").orderBy("run").collect()] == pytest.approx([84.0896, 237.8414], abs=1e-3)


def test_calibration(spark):
    df = spark.createDataFrame([(1, i, 10.0 * i, 100.0 * i) for i in range(1, 11)], "run int, id int, x double, y double")
    out = T.calibrate(df, ["run"], "x", "y", 2).orderBy("id").collect()
    assert [r["predicted_rt"] for r in out] == pytest.approx([100.0 * i for i in range(1, 11)])
    assert all(r["rt_low"] <= r["y"] <= r["rt_high"] for r in out)


def test_nearest_and_interval_joins(spark):
    left = spark.createDataFrame([(1, 1.0), (2, 2.4), (3, 9.0)], "id int, t double")
    right = spark.createDataFrame([(10, 0.0), (11, 2.0), (12, 3.0)], "rid int, rt double")
    assert {r["id"]: r["nearest"] for r in R.nearest_join(left, right, "t", "rt", "rid").collect()} == {1: 10, 2: 11, 3: 12}
    spans = spark.createDataFrame([(1, 0.0, 2.0), (2, 2.5, 3.0)], "id int, low double, high double")
    assert sorted((r["id"], r["rid"]) for r in R.interval_join(spans, right, "low", "high", "rt", 1.0).collect()) == [(1, 10), (1, 11), (2, 12)]


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "id int, score double, is_decoy boolean")
    assert W.q_values(empty, "score", "is_decoy", ["id"]).count() == 0
    assert R.dense_id(empty, ["id"], "n").count() == 0
    assert R.best_row(empty, ["id"], "score", ["id"]).count() == 0


def test_fasta(spark, tmp_path):
    (tmp_path / "a.fasta").write_text(">sp|P1|A first protein\nMKR\nPEX\n>P2\nAAA\n")
    rows = {r["fasta_id"]: (r["description"], r["sequence"]) for r in readers.read_fasta(spark, str(tmp_path / "a.fasta")).collect()}
    assert rows == {"sp|P1|A": ("first protein", "MKRPE"), "P2": ("", "AAA")}


def test_mzml(spark, tmp_path):
    code = lambda x, kind, z: base64.b64encode(zlib.compress(np.array(x, kind).tobytes()) if z else np.array(x, kind).tobytes()).decode()
    param = lambda a, v="", u="": f'<cvParam cvRef="MS" accession="{a}" name="x" value="{v}" unitName="{u}"/>'
    arrays = lambda mz, ab: f'<binaryDataArrayList count="2"><binaryDataArray>{param("MS:1000514")}{param("MS:1000523")}{param("MS:1000574")}<binary>{code(mz, "<f8", True)}</binary></binaryDataArray><binaryDataArray>{param("MS:1000515")}{param("MS:1000521")}<binary>{code(ab, "<f4", False)}</binary></binaryDataArray></binaryDataArrayList>'
    window = f'<precursorList count="1"><precursor><isolationWindow>{param("MS:1000827", 400)}{param("MS:1000828", 2)}{param("MS:1000829", 3)}</isolationWindow></precursor></precursorList>'
    spectrum = lambda i, level, extra, mz, ab: f'<spectrum index="{i}" id="scan={i}">{param("MS:1000511", level)}<scanList count="1"><scan>{param("MS:1000016", 0.5, "minute")}</scan></scanList>{extra}{arrays(mz, ab)}</spectrum>'
    body = spectrum(0, 1, "", [100.0, 200.0], [1.0, 0.0]) + spectrum(1, 2, window, [150.5], [7.0])
    (tmp_path / "run1.mzML").write_text(f'<?xml version="1.0"?><mzML xmlns="http://psi.hupo.org/ms/mzml"><run><spectrumList count="2">{body}</spectrumList></run></mzML>')
    frames = readers.read_run(spark, str(tmp_path / "run1.mzML")).orderBy("frame_num").collect()
    assert [(r["run_name"], r["frame_num"], r["ms_level"], r["time_in_seconds"]) for r in frames] == [("run1", 1, 1, 30.0), ("run1", 2, 2, 30.0)]
    assert (frames[1]["isolation_min_mz"], frames[1]["isolation_max_mz"], frames[1]["mz"], frames[1]["ab"]) == (398.0, 403.0, [150.5], [7.0])
    assert [(r["mz"], r["ab"]) for r in readers.peaks_of(readers.read_run(spark, str(tmp_path / "run1.mzML"))).orderBy("mz").collect()] == [(100.0, 1.0), (150.5, 7.0)]


def test_gzip_mzml(spark, tmp_path):
    body = "".join(f'<spectrum index="{i}" id="s{i}"><cvParam accession="MS:1000511" value="1"/><scanList><scan><cvParam accession="MS:1000016" value="{i}" unitName="second"/></scan></scanList></spectrum>' for i in range(5))
    with gzip.open(tmp_path / "run2.mzML.gz", "wt") as f:
        f.write(f'<?xml version="1.0"?><mzML><run><spectrumList>{body}</spectrumList></run></mzML>')
    rows = readers.read_run(spark, str(tmp_path / "run2.mzML.gz")).orderBy("frame_num").collect()
    assert [(r["run_name"], r["frame_num"], r["time_in_seconds"], r["mz"]) for r in rows] == [("run2", i + 1, float(i), []) for i in range(5)]


def test_modification_tables(spark, tmp_path):
    (tmp_path / "u.xml").write_text('<umod:unimod xmlns:umod="u"><umod:modifications><umod:mod title="Methyl" record_id="34"><umod:delta mono_mass="14.01565" composition="H(2) C"/></umod:mod></umod:modifications></umod:unimod>')
    table = tables.read_modifications(spark, str(tmp_path / "u.xml"))
    assert [(r["unimod_id"], r["name"], r["composition"]) for r in table.collect()] == [(34, "Methyl", {"H": 2, "C": 1})]
    peptides = spark.createDataFrame([("_AK.",)], "peptide string")
    with pytest.raises(ValueError, match="Methyl"):
        D.modify(peptides, [("Methyl", "K", "anywhere", True)], 1)
    tables.register_modifications(table, ["Methyl"])
    try:
        mass = D.modify(peptides, [("Methyl", "K", "anywhere", True)], 1).select(D.modification_mass("mod_ids").alias("m")).first()["m"]
        assert mass == pytest.approx(14.01565, abs=1e-5)
    finally:
        del C.MODIFICATIONS["Methyl"]


def test_appended_results(spark, tmp_path):
    for run in (0, 1, 1):
        sinks.append_results(spark.range(2).withColumn("run_index", F.lit(run)), str(tmp_path / "r"))
    assert {r["run_index"]: r["n"] for r in spark.read.parquet(str(tmp_path / "r")).groupBy("run_index").agg(F.count("*").alias("n")).collect()} == {0: 2, 1: 4}


def test_input_folder(spark, tmp_path):
    for name in ("b.mzML", "a.mzML.gz", "x.txt"):
        (tmp_path / name).write_text("")
    names = lambda found: [p.rpartition("/")[2] for p in found]
    assert names(config.input_files({"input_dir": str(tmp_path)})) == names(config.input_files({"input_dir": str(tmp_path)}, spark)) == ["a.mzML.gz", "b.mzML"]


def test_isotopes_and_sinks(spark, tmp_path):
    rows = tables.isotope_patterns(spark).where("mass = 1000").orderBy("isotope_index").collect()
    assert rows[0]["predicted_intensity"] == 1.0 and rows[1]["predicted_intensity"] == pytest.approx(0.57, abs=0.05)
    lib = {"t": spark.range(3).withColumn("l", F.array("id", "id"))}
    sinks.write_library(lib, str(tmp_path / "lib"))
    with pytest.raises(FileExistsError):
        sinks.write_library(lib, str(tmp_path / "lib"))
    sinks.write_report(lib["t"], str(tmp_path / "r"))
    assert spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "r")).where("l = '2;2'").count() == 1


def test_config():
    good = config.check({"fasta_file": "a", "output_directory": "b", "input_files": ["x"], "digest": {"enzyme": "lys-c"}})
    assert good["digest"]["enzyme"] == "lys-c" and good["digest"]["max_len"] == 30
    assert config.differences(good, good | {"q_value_cutoff": 0.05, "digest": good["digest"] | {"max_len": 20}}) == {"digest.max_len": (30, 20), "q_value_cutoff": (0.01, 0.05)}
    with pytest.raises(ValueError):
        config.check({"fasta_file": "a", "output_directory": "b"})


def test_representative_time(spark):
    df = spark.createDataFrame([(0, 1, 10.0, 1.0), (1, 1, 10.5, 1.0), (2, 1, 30.0, 1.0), (0, 2, 5.0, 1.0)], "run int, precursor int, rt double, score double")
    got = {r["precursor"]: r["representative_rt"] for r in T.representative_times(df, "run", "precursor", "rt", "score", 1.0).collect()}
    assert got[2] == 5.0 and math.isclose(got[1], 10.25, abs_tol=0.5)
