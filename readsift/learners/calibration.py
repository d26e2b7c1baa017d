"""Probability calibration, one calibrator per fold, averaged."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from readsift.config import FeatureSpec
from readsift.learners.base import Fitted, Learner, fit_encoded, labelled
from readsift.learners.isotonic import IsotonicSteps, isotonic_blocks
from readsift.operators.encode import Categories, Encoding, fit_encodings
from readsift.operators.folds import INDEX, Fold, folds_of_column, stratified_fold_column
from readsift.session import in_threads, stage


@dataclass(frozen=True)
class _Sigmoid:
    fitted: object

    def apply(self, df: DataFrame) -> DataFrame:
        vector = VectorAssembler(inputCols=["score"], outputCol="_score")
        out = self.fitted.transform(vector.transform(df))
        return out.withColumn("_cal", F.get(vector_to_array("_prob"), F.lit(1))).drop("_score", "_raw", "_prob", "_pred")


def fit_isotonic(scored: DataFrame) -> IsotonicSteps:
    """Monotone step fit of the labels by score."""
    return IsotonicSteps.of(isotonic_blocks(scored))


def fit_sigmoid(scored: DataFrame) -> _Sigmoid:
    """Logistic curve through the score, with Platt's smoothed targets.

    A soft target t enters as a positive of weight t and a negative of weight 1 - t.
    """
    counts = {r["label"]: r["n"] for r in scored.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    up = (counts.get(1, 0) + 1.0) / (counts.get(1, 0) + 2.0)
    down = 1.0 / (counts.get(0, 0) + 2.0)
    target = F.when(F.col("label") == 1, up).otherwise(down)
    sides = F.explode(
        F.array(
            F.struct(F.lit(1.0).alias("y"), target.alias("share")),
            F.struct(F.lit(0.0).alias("y"), (1.0 - target).alias("share")),
        )
    )
    weighted = (
        scored.groupBy("score", "label").agg(F.count(F.lit(1)).alias("n"))
        .withColumn("side", sides)
        .select("score", F.col("side.y").alias("y"), (F.col("side.share") * F.col("n")).alias("weight"))
    )
    regression = LogisticRegression(
        featuresCol="_score", labelCol="y", weightCol="weight",
        predictionCol="_pred", probabilityCol="_prob", rawPredictionCol="_raw",
    )
    vector = VectorAssembler(inputCols=["score"], outputCol="_score")
    return _Sigmoid(regression.fit(vector.transform(weighted)))


METHODS = {"isotonic": fit_isotonic, "sigmoid": fit_sigmoid}


@dataclass(frozen=True)
class Calibrated:
    """Members (model, calibrator) of the folds; ``p1`` is their mean."""

    members: tuple[tuple[Fitted, object], ...]
    spec: FeatureSpec

    def transform(self, df: DataFrame) -> DataFrame:
        kept = df.columns
        chained, parts = df, []
        for i, (model, calibrator) in enumerate(self.members):
            out = calibrator.apply(model.transform(chained))
            parts.append(f"_cal_{i}")
            chained = out.select(*kept, *parts[:-1], F.col("_cal").alias(parts[-1]))
        mean = sum((F.col(c) for c in parts), F.lit(0.0)) / len(parts)
        return labelled(
            chained.withColumn("p1", mean)
            .withColumns({"score": F.col("p1"), "prediction": (F.col("p1") > 0.5).cast("int")})
            .drop(*parts),
            self.spec,
        )


@dataclass(frozen=True)
class CalibratedModel:
    """Members (model, calibrator) over one encoding; ``p1`` is the mean of their probabilities."""

    members: tuple[tuple[object, object], ...]

    def transform(self, df: DataFrame) -> DataFrame:
        kept, chained, parts = df.columns, df, []
        for i, (model, calibrator) in enumerate(self.members):
            out = calibrator.apply(model.transform(chained))
            parts.append(f"_cal_{i}")
            chained = out.select(*kept, *parts[:-1], F.col("_cal").alias(parts[-1]))
        mean = sum((F.col(c) for c in parts), F.lit(0.0)) / len(parts)
        found = chained.withColumn("p1", mean)
        return found.withColumns({"score": F.col("p1"), "prediction": (F.col("p1") > 0.5).cast("int")}).drop(*parts)


@dataclass(frozen=True)
class CalibratedLearner:
    """A learner like any other: its rows are dealt to stratified folds, each fold's model is trained on the others and
    calibrated on the fold's own scores."""

    base: Learner
    folds: int = 5
    method: str = "isotonic"
    seed: int = 0
    key: str = INDEX

    @property
    def name(self) -> str:
        return f"calibrated_{self.base.name}"

    def fit(self, encoded: DataFrame, encoding) -> CalibratedModel:
        if self.method not in METHODS:
            raise ValueError(f"unknown calibration method {self.method}")
        name = "_calibration_fold"
        dealt = stage(stratified_fold_column(encoded, "label", self.folds, self.seed, self.key, name), "calibration-folds")

        def member(fold: Fold):
            model = self.base.fit(dealt.where(fold.train), encoding)
            return model, METHODS[self.method](model.transform(dealt.where(fold.test)).select("score", "label"))

        return CalibratedModel(tuple(member(f) for f in folds_of_column(self.folds, name)))


def fit_calibrated(
    learner: Learner, train: DataFrame, folds: list[Fold], spec: FeatureSpec, method: str = "isotonic",
    vocabulary_from: DataFrame | Categories | None = None, parallelism: int = 4,
) -> Calibrated:
    """Per fold: train on its train part, calibrate on the scores of its test part."""
    if method not in METHODS:
        raise ValueError(f"unknown calibration method {method}")
    encodings = fit_encodings(train, [f.train for f in folds], spec, vocabulary_from)

    def member(fold: Fold, encoding: Encoding):
        model = fit_encoded(learner, train.where(fold.train), encoding)
        return model, METHODS[method](model.transform(train.where(fold.test)).select("score", "label"))

    tasks = [lambda f=f, e=e: member(f, e) for f, e in zip(folds, encodings)]
    members = in_threads(tasks, train.sparkSession, parallelism)
    return Calibrated(tuple(members), spec)
