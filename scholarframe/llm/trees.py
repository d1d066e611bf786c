"""Gradient-boosted trees over numeric columns, with isotonic calibration; for a bounded sample of rows."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sample_share(rows: int, bound: int) -> int:
    """Of a million hash values, how many to keep so that about `bound` of `rows` rows remain."""
    return 1_000_000 if rows <= bound else max(1, 1_000_000 * bound // rows)


def sampled(key: Column, share: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit("sample")), F.lit(1_000_000)) < share


class BoostedTrees:
    """fit() on a sample with features and a 0/1 label, then score() of any rows."""

    def __init__(self, features: list[str], rounds: int = 20, depth: int = 3, calibrate: bool = True):
        self.features, self.rounds, self.depth, self.calibrate = features, rounds, depth, calibrate
        self.trees: GBTClassificationModel | None = None
        self.curve: IsotonicRegressionModel | None = None
        self.constant = 0.0

    def _assembled(self, rows: DataFrame) -> DataFrame:
        return VectorAssembler(inputCols=self.features, outputCol="features").transform(rows)

    def fit(self, rows: DataFrame, label: str, fold: Column, weight: str | None = None) -> BoostedTrees:
        """fold: true for the fifth or so of the rows that calibrates; weight: a column with what each row stands for, else 1.
        With rows of one class only, or none, every score is that class."""
        weighs = F.col(weight).cast("double") if weight else F.lit(1.0)
        known = rows.select(*self.features, F.col(label).cast("double").alias("label"), fold.alias("fold"), weighs.alias("weight")).where("label is not null")
        counts = {(r.fold, r.label): r.n for r in known.groupBy("fold", "label").agg(F.count("*").alias("n")).collect()}
        if not all(counts.get((False, x)) for x in (0.0, 1.0)):
            total = sum(counts.values())
            self.constant = float(sum(n for (_, x), n in counts.items() if x == 1.0) * 2 > total) if total else 0.0
            return self
        ready = self._assembled(known)
        weighed = {"weightCol": "weight"} if weight else {}
        self.trees = GBTClassifier(featuresCol="features", labelCol="label", maxIter=self.rounds, maxDepth=self.depth, maxBins=64, stepSize=0.3, minInstancesPerNode=3, seed=1, **weighed).fit(ready.where("not fold"))
        if self.calibrate and all(counts.get((True, x)) for x in (0.0, 1.0)):
            # Rows of one score, to a thousandth, are one weighted point, so the curve's sort is small and even.
            points = self._raw(ready.where("fold")).groupBy(F.round("raw", 3).alias("raw")).agg((F.sum(F.col("label") * F.col("weight")) / F.sum("weight")).alias("label"), F.sum("weight").alias("weight"))
            self.curve = IsotonicRegression(featuresCol="raw", labelCol="label", weightCol="weight").fit(points)
        return self

    def _raw(self, ready: DataFrame) -> DataFrame:
        return self.trees.transform(ready).withColumn("raw", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")

    def score(self, rows: DataFrame, carried: str) -> DataFrame:
        """(carried, score) for each row; score is from 0 to 1.  All that a caller keeps is in the one column `carried`,
        so that no name of its table can meet a name of the trees'."""
        if self.trees is None:
            return rows.select(carried, F.lit(self.constant).alias("score"))
        out = self._raw(self._assembled(rows.select(carried, *self.features)))
        if self.curve is None:
            return out.select(carried, F.col("raw").alias("score"))
        # The curve is flat in places; a hundredth of the trees' own score keeps their order there.
        level = self.curve.setPredictionCol("level").transform(out)
        return level.select(carried, F.least(F.lit(1.0), F.greatest(F.lit(0.0), 0.99 * F.col("level") + 0.01 * F.col("raw"))).alias("score"))
