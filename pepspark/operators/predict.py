"""What a spectral library needs that chemistry alone doesn't say: predicted times and intensities, as a plug-in.

``Predictor`` is the interface; ``RuleBased`` is a baseline without trained weights: times from hydrophobicity, intensities
from the kind and place of an ion.  Models in their own runtimes implement the same two methods over DataFrames.
"""

from __future__ import annotations

from functools import reduce
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pepspark.functions import columns as K

#: The hydropathy of each residue (Kyte and Doolittle 1982).
HYDROPATHY = {"A": 1.8, "R": -4.5, "N": -3.5, "D": -3.5, "C": 2.5, "E": -3.5, "Q": -3.5, "G": -0.4, "H": -3.2, "I": 4.5, "L": 3.8, "K": -3.9, "M": 1.9, "F": 2.8, "P": -1.6, "S": -0.8, "T": -0.7, "W": -0.9, "Y": -1.3, "V": 4.2}


class Predictor(Protocol):
    def times(self, precursors: DataFrame) -> DataFrame:
        """``precursors`` with ``ref_rt double``, in any unit that grows with the retention time."""

    def intensities(self, ions: DataFrame) -> DataFrame:
        """``ions`` with ``predicted_intensity double``."""


class RuleBased:
    def times(self, precursors: DataFrame) -> DataFrame:
        plain = K.plain("peptide")
        terms = [(F.length(plain) - F.length(F.replace(plain, F.lit(r)))) * F.lit(h) for r, h in HYDROPATHY.items()]
        return precursors.withColumn("ref_rt", reduce(lambda a, b: a + b, terms) + F.log(F.greatest(F.length(plain), F.lit(1))) * 10)

    def intensities(self, ions: DataFrame) -> DataFrame:
        kind = F.when(F.col("is_prefix"), 0.4).otherwise(1.0)
        return ions.withColumn("predicted_intensity", F.round(kind / F.col("charge") * F.exp(-F.abs(F.col("mz") - 650) / 500), 6))
