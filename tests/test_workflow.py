"""The workflow on a small FASTA file and made-up runs that hold spectra of some of its peptides."""

import base64

import numpy as np
import pytest

yaml = pytest.importorskip("yaml")

from pepspark import config  # noqa: E402
from pepspark.operators.scoring import LogisticScorer  # noqa: E402
from pepspark.plans import workflow  # noqa: E402

PROTEINS = {
    "P1": "MKTAYIAKQRQISFVKSHFSRQLEERLGLIEVQAPILSR", "P2": "GDGTQDNLSGAEKAVQVKVKALPDAQFEVVHSLAK", "P3": "WNTLYDERMAGGHICQPFKSEVLNTTDWRGYPAMIEQLK",
    "P4": "DVHQLESYRTFGAANIWKLLPESMDGTRCVIYNEHFQAKQQDWSPLTVEMR", "P5": "AEGLTPNDIWVYKHFSSTMLQERGGIVDEALPNYKTTWCHDLQFSIR",
}


def write_run(path, frames):
    """``frames``: (level, seconds, isolation bounds or None, mz, ab)."""
    code = lambda x: base64.b64encode(np.array(x, "<f8").tobytes()).decode()
    param = lambda a, v="", u="": f'<cvParam accession="{a}" value="{v}" unitName="{u}"/>'
    body = ""
    for i, (level, seconds, bounds, mz, ab) in enumerate(frames):
        order = np.argsort(mz)
        mz, ab = np.array(mz)[order], np.array(ab)[order]
        centre, half = ((bounds[0] + bounds[1]) / 2, (bounds[1] - bounds[0]) / 2) if bounds else (0, 0)
        window = f'<precursorList><precursor><isolationWindow>{param("MS:1000827", centre)}{param("MS:1000828", half)}{param("MS:1000829", half)}</isolationWindow></precursor></precursorList>' if bounds else ""
        arrays = "".join(f'<binaryDataArray>{param(kind)}{param("MS:1000523")}<binary>{code(x)}</binary></binaryDataArray>' for kind, x in (("MS:1000514", mz), ("MS:1000515", ab)))
        body += f'<spectrum index="{i}" id="s{i}">{param("MS:1000511", level)}<scanList><scan>{param("MS:1000016", seconds, "second")}</scan></scanList>{window}<binaryDataArrayList>{arrays}</binaryDataArrayList></spectrum>'
    path.write_text(f'<?xml version="1.0"?><mzML><run><spectrumList>{body}</spectrumList></run></mzML>')


def prepared(spark, tmp_path, method):
    (tmp_path / "p.fasta").write_text("".join(f">{k} x\n{v}\n" for k, v in PROTEINS.items()))
    given = {
        "fasta_file": str(tmp_path / "p.fasta"), "output_directory": str(tmp_path / "out"), "input_files": [str(tmp_path / f"r{k}.mzML") for k in (1, 2)], "q_value_cutoff": 0.5, "acquisition_method": method,
        "modification": {"max_mods": 1, "mod_param_set": [{"mod_name": "Oxidation", "residue": "M", "location": "anywhere", "fixed": False}]},
    }
    (tmp_path / "c.yaml").write_text(yaml.safe_dump(given))
    library = workflow.build_library(spark, config.check(given))
    wanted = library["precursor"].where("not is_decoy and precursor_charge = 2 and sequence_length >= 9 and size(mod_ids) = 0").collect()
    ions = {}
    for r in library["fragment"].orderBy("predicted_intensity", ascending=False).collect():
        ions.setdefault(r["precursor_index"], []).append((r["mz"], r["predicted_intensity"], r["charge"]))
    return wanted, ions


def check(out, wanted, ratio):
    assert out["state"] is workflow.State.DONE
    found = {(r["run_name"], r["precursor_index"]) for r in out["matches"].where("not is_decoy").collect()}
    assert {(f"r{k}", r["precursor_index"]) for k in (1, 2) for r in wanted} <= found
    amounts = {(r["protein_group"], r["run_name"]): r["abundance"] for r in out["quantities"].collect()}
    assert amounts and all(amounts[g, "r2"] / amounts[g, "r1"] == pytest.approx(ratio, rel=0.02) for g, _ in amounts)
    assert out["summary"].where("run_name is null").first()["precursors"] >= len(wanted)


def test_data_dependent(spark, tmp_path):
    """Amounts come from the precursors' own peaks in first-level frames, not from fragments."""
    wanted, ions = prepared(spark, tmp_path, "DDA")
    for k in (1, 2):
        frames = []
        for i, r in enumerate(wanted):
            mz = [m for m, _, z in ions[r["precursor_index"]] if z == 1]
            for step in range(7):
                shape = [0, 1, 2, 3, 2, 1, 0][step]
                frames.append((1, 10.0 * i + step, None, [r["precursor_mz"], 250.0], [100.0 * k * shape + 1e-9, 5.0]))
                if step == 3:
                    frames.append((2, 10.0 * i + 3.2, (r["precursor_mz"] - 2, r["precursor_mz"] + 2), [*mz, r["precursor_mz"]], [70.0] * len(mz) + [9999.0]))
        write_run(tmp_path / f"r{k}.mzML", frames)
    check(workflow.run_search(spark, str(tmp_path / "c.yaml")), wanted, 2)


def test_data_independent(spark, tmp_path):
    """Elution profiles in the frames of regular isolation windows: found at their apex, times calibrated, MS2 areas."""
    wanted, ions = prepared(spark, tmp_path, "DIA")
    rng = np.random.default_rng(1)
    low, high = min(r["ref_rt"] for r in wanted), max(r["ref_rt"] for r in wanted)
    windows = [(300.0 + 100 * w, 400.0 + 100 * w) for w in range(12)]
    cycles, apex = 60, {r["precursor_index"]: 8 + int(44 * (r["ref_rt"] - low) / (high - low)) for r in wanted}
    for k in (1, 2):
        frames = []
        for c in range(cycles):
            frames.append((1, 10.0 * c, None, [500.0], [1.0]))
            for w, bounds in enumerate(windows):
                mz, ab = [float(x) for x in rng.uniform(200, 1800, 30)], [float(x) for x in rng.uniform(0.5, 2, 30)]
                for r in wanted:
                    shape = np.exp(-0.5 * ((c - apex[r["precursor_index"]]) / 1.5) ** 2)
                    if bounds[0] <= r["precursor_mz"] < bounds[1] and shape > 0.01:
                        top = ions[r["precursor_index"]][:16]
                        mz += [m for m, _, _ in top]
                        ab += [1000.0 * k * shape * x for _, x, _ in top]
                frames.append((2, 10.0 * c + 0.5 + w / 2, bounds, mz, ab))
        write_run(tmp_path / f"r{k}.mzML", frames)
    out = workflow.run_search(spark, str(tmp_path / "c.yaml"))
    check(out, wanted, 2)
    for r in out["matches"].where("not is_decoy").collect():
        if r["precursor_index"] in apex:
            assert abs(r["observed_rt"] / 10 - apex[r["precursor_index"]]) < 2
    rows = spark.read.parquet(f"{tmp_path}/out/candidates")
    assert rows.where("predicted_rt is not null").count() == rows.count()
    names = {r["run_name"] for r in spark.read.parquet(f"{tmp_path}/out/run_attributes").collect()}
    assert names == {"r1", "r2"} and spark.read.parquet(f"{tmp_path}/out/matches_unfiltered").count() >= out["matches"].count()
    learned = LogisticScorer().fit(rows).score(rows)  # the plug-in over the same candidates
    assert learned.where("score is null").count() == 0 and set(learned.columns) == set(rows.columns)
