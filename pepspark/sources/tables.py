"""Reference tables made from fixed values: atoms, modifications, ion types and isotope patterns."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pepspark.functions import columns as K
from pepspark.functions import constants as C

#: Shares of the isotopes of each element by added neutrons, and the average residue (Senko 1995) of 111.1254 Da.
ISOTOPES = {"C": [0.9893, 0.0107], "H": [0.999885, 0.000115], "N": [0.99636, 0.00364], "O": [0.99757, 0.00038, 0.00205], "S": [0.9499, 0.0075, 0.0425, 0.0, 0.0001]}
AVERAGE_RESIDUE = {"C": 4.9384, "H": 7.7583, "N": 1.3577, "O": 1.4773, "S": 0.0417}
AVERAGE_MASS = 111.1254


def envelope(counts: dict[str, int], size: int = 16) -> np.ndarray:
    """Shares of the isotope peaks of a composition: the product of its atoms' isotope polynomials."""
    out = np.ones(1)
    for element, n in counts.items():
        power = np.array(ISOTOPES[element])
        while n:
            if n & 1:
                out = np.convolve(out, power)[:size]
            power, n = np.convolve(power, power)[:size], n >> 1
    return np.pad(out, (0, size - len(out)))


def modifications(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(n, name, C.composition_mass(parts)) for name, (n, parts) in C.MODIFICATIONS.items()], "unimod_id int, name string, mass double")


def read_modifications(spark: SparkSession, path: str) -> DataFrame:
    """``unimod_id, name, mass, composition map<string,int>`` of a UniMod XML file, one row for each of its modifications."""
    schema = "_record_id int, _title string, `umod:delta` struct<_mono_mass:double,_composition:string>"
    rows = spark.read.format("xml").option("rowTag", "umod:mod").schema(schema).load(path)
    delta = F.col("`umod:delta`")
    return rows.select(F.col("_record_id").alias("unimod_id"), F.col("_title").alias("name"), delta["_mono_mass"].alias("mass"), K.composition(delta["_composition"]).alias("composition"))


def register_modifications(table: DataFrame, names: list[str]) -> None:
    """Makes the named modifications of such a table known to the library builder."""
    found = {r["name"]: r for r in table.where(F.col("name").isin(names)).collect()}  # the configuration's names
    for name in names:
        if name not in found:
            raise ValueError(f"modification {name} is not in the table")
        C.register_modification(name, found[name]["unimod_id"], found[name]["composition"])


def atoms(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(C.ATOM_MASSES.items()), "code string, mono_mass double")


def ion_types(spark: SparkSession, max_charge: int = 2) -> DataFrame:
    rows = [(base, loss, z, prefix, offset - drop) for base, prefix, offset in (("b", True, 0.0), ("y", False, C.WATER_MASS)) for loss, drop in (("", 0.0), ("-H3O4P", C.PHOSPHORIC_ACID_MASS)) for z in range(1, max_charge + 1)]
    return spark.createDataFrame(rows, "base_ion_type string, neutral_loss string, charge int, is_prefix boolean, offset_mass double")


def isotope_patterns(spark: SparkSession, low: int = 300, high: int = 7000, step: int = 100, isotopes: int = 3) -> DataFrame:
    """``mass, isotope_index, offset_mass, predicted_intensity, rank`` by nominal mass: the envelope of an average peptide of that
    mass.  Intensities are scaled to the greatest kept one, ranks are of the whole envelope.  The table is fixed and small."""
    rows = []
    for mass in range(low, high + 1, step):
        shares = envelope({e: round(n * mass / AVERAGE_MASS) for e, n in AVERAGE_RESIDUE.items()})
        rank = np.argsort(np.argsort(-shares, kind="stable"), kind="stable") + 1
        kept = shares[:isotopes]
        rows += [(mass, i, i * C.C13_C12_DIFFERENCE, float(kept[i] / kept.max()), int(rank[i])) for i in range(isotopes)]
    return spark.createDataFrame(rows, "mass int, isotope_index int, offset_mass double, predicted_intensity double, rank int")
