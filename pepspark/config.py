"""Search configuration: loading, checking and comparing."""

from __future__ import annotations

import copy
import glob
import os

#: The defaults of the workflow.
DEFAULTS = {
    "acquisition_method": "DIA",
    "q_value_cutoff": 0.01,
    "ms1_mass_tol_in_ppm": 10,
    "ms2_mass_tol_in_ppm": 10,
    "report_format": "tsv",
    "decoy": "map",
    "least_peaks": 16,
    "digest": {"enzyme": "trypsin", "min_len": 7, "max_len": 30, "max_missed_cleavages": 1, "n_term_methionine_excision": True},
    "modification": {"max_mods": 2, "mod_param_set": []},
    "precursor": {"min_charge": 1, "max_charge": 4, "min_mz": 300, "max_mz": 1800},
    "fragment": {"min_charge": 1, "max_charge": 2, "min_mz": 200, "max_mz": 1800},
}
REQUIRED = ("fasta_file", "output_directory")
EXTENSIONS = (".mzml", ".mzml.gz", ".parquet")


def load(path: str) -> dict:
    import yaml

    with open(path) as f:
        return check(yaml.safe_load(f) or {})


def check(given: dict) -> dict:
    """The configuration with defaults; raises ValueError for what is missing or out of range."""
    out = copy.deepcopy(DEFAULTS)
    for key, value in given.items():
        if isinstance(value, dict) and isinstance(out.get(key), dict):
            out[key] |= value
        else:
            out[key] = value
    missing = [k for k in REQUIRED if not out.get(k)]
    if missing:
        raise ValueError(f"missing: {', '.join(missing)}")
    if not out.get("input_files") and not out.get("input_dir"):
        raise ValueError("missing: input_files or input_dir")
    out["acquisition_method"] = str(out["acquisition_method"]).upper()
    if out["acquisition_method"] not in ("DIA", "DDA"):
        raise ValueError("acquisition_method is DIA or DDA")
    if not 0 < float(out["q_value_cutoff"]) <= 1:
        raise ValueError("q_value_cutoff is above 0 and at most 1")
    for part in ("precursor", "fragment"):
        if out[part]["min_mz"] > out[part]["max_mz"] or out[part]["min_charge"] > out[part]["max_charge"]:
            raise ValueError(f"{part}: bounds are the wrong way round")
    return out


def input_files(config: dict, spark=None) -> list[str]:
    """The named files, or those in the folder with a known extension; with a session, of any file system it reads."""
    if config.get("input_files"):
        return list(config["input_files"])
    if spark is None:
        found = glob.glob(os.path.join(config["input_dir"], "*"))
    else:
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        folder = jvm.org.apache.hadoop.fs.Path(config["input_dir"])
        found = [s.getPath().toString() for s in folder.getFileSystem(conf).listStatus(folder)]
    return sorted(p for p in found if p.lower().endswith(EXTENSIONS))


def differences(a: dict, b: dict, prefix: str = "") -> dict[str, tuple]:
    """Keys that both have with unlike values."""
    out = {}
    for key in sorted(a.keys() & b.keys()):
        if isinstance(a[key], dict) and isinstance(b[key], dict):
            out |= differences(a[key], b[key], f"{prefix}{key}.")
        elif a[key] != b[key]:
            out[f"{prefix}{key}"] = (a[key], b[key])
    return out
