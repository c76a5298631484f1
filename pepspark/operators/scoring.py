"""Scorers of candidate matches: a plug-in interface and a logistic baseline on feature vectors."""

from __future__ import annotations

from typing import Protocol

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pepspark.operators.sampling import split_decoys


class Scorer(Protocol):
    def score(self, candidates: DataFrame) -> DataFrame:
        """``candidates`` with a ``score double`` column."""


class LogisticScorer:
    """Targets against decoys by logistic regression; the score is the log-odds."""

    def __init__(self, features: str = "features", decoy: str = "is_decoy", ident: str = "peptide_index", ridge: float = 0.01):
        self.features, self.decoy, self.ident, self.ridge, self.model = features, decoy, ident, ridge, None

    def _vectors(self, df: DataFrame) -> DataFrame:
        return df.withColumn("_v", array_to_vector(F.col(self.features).cast("array<double>")))

    def fit(self, df: DataFrame) -> LogisticScorer:
        train, _ = split_decoys(df, self.ident, self.decoy)
        labelled = self._vectors(train).withColumn("_y", (~F.col(self.decoy)).cast("double"))
        self.model = LogisticRegression(featuresCol="_v", labelCol="_y", regParam=self.ridge, maxIter=50).fit(labelled)
        return self

    def score(self, candidates: DataFrame) -> DataFrame:
        scored = self.model.setRawPredictionCol("_raw").transform(self._vectors(candidates))
        return scored.withColumn("score", vector_to_array("_raw")[1]).select(*(c for c in candidates.columns if c != "score"), "score")
