"""Learners that pyspark.ml trains: tree, logistic regression, perceptron network."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import (
    DecisionTreeClassifier,
    LogisticRegression,
    MultilayerPerceptronClassifier,
)
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from readsift.learners.simple import DummyModel, class_counts
from readsift.session import staged_path

_DEEPEST_TREE = 30  # Limit of the tree learner in pyspark.ml.


@dataclass(frozen=True)
class MlModel:
    fitted: object

    def transform(self, df: DataFrame) -> DataFrame:
        out = self.fitted.transform(df).withColumn("p1", F.get(vector_to_array("probability"), F.lit(1)))
        return out.withColumns(
            {"score": F.col("p1"), "prediction": F.col("prediction").cast("int")}
        ).drop("rawPrediction", "probability")


def _fit(estimator, encoded: DataFrame):
    """Fit, or answer the only class present."""
    counts = class_counts(encoded)
    if len(counts) == 1:
        return DummyModel("most_frequent", float(next(iter(counts))), 0, "")
    return MlModel(estimator(counts).fit(encoded.select("features", "label")))


@dataclass(frozen=True)
class Tree:
    """Gini tree. Numeric split points come from ``bins`` quantile bins."""

    max_depth: int = 20
    bins: int = 128
    seed: int = 0
    name: str = "tree"

    def fit(self, encoded: DataFrame, encoding):
        if self.max_depth > _DEEPEST_TREE:
            raise ValueError(f"trees deeper than {_DEEPEST_TREE} are not available")
        return _fit(
            lambda _: DecisionTreeClassifier(
                maxDepth=self.max_depth, maxBins=self.bins, impurity="gini", seed=self.seed
            ),
            encoded,
        )


@dataclass(frozen=True)
class Logit:
    """L2-penalised logistic regression; ``c`` is the inverse penalty on summed loss."""

    c: float = 1.0
    max_iter: int = 100
    name: str = "logit"

    def fit(self, encoded: DataFrame, encoding):
        if self.c <= 0:
            raise ValueError("c must be positive")
        return _fit(
            lambda counts: LogisticRegression(
                regParam=1.0 / (self.c * sum(counts.values())),
                elasticNetParam=0.0, standardization=False, maxIter=self.max_iter,
            ),
            encoded,
        )


@dataclass(frozen=True)
class Network:
    """One hidden layer of sigmoid units, trained to convergence without a penalty
    term: pyspark.ml offers neither rectified units, nor L2, nor early stopping."""

    hidden: int = 100
    max_iter: int = 200
    seed: int = 0
    name: str = "network"

    def fit(self, encoded: DataFrame, encoding):
        return _fit(
            lambda _: MultilayerPerceptronClassifier(
                layers=[encoding.width, self.hidden, 2], maxIter=self.max_iter, seed=self.seed
            ),
            encoded,
        )


def tree_nodes(spark, model: MlModel) -> DataFrame:
    """Node table of a fitted tree: split, impurity, rows, class counts, class.

    Reads the table that saving the model writes.
    """
    path = staged_path(spark, "tree")
    model.fitted.save(path)
    counts = F.col("impurityStats")
    leaf = F.col("leftChild") < 0
    return spark.read.parquet(f"{path}/data").select(
        "id",
        F.when(~leaf, F.col("split.featureIndex")).alias("feature"),
        F.when(~leaf, F.get("split.leftCategoriesOrThreshold", F.lit(0))).alias("threshold"),
        F.when(~leaf, F.col("leftChild")).alias("left_child"),
        F.when(~leaf, F.col("rightChild")).alias("right_child"),
        F.col("impurity").alias("gini"),
        F.aggregate(counts, F.lit(0.0), lambda a, x: a + x).cast("bigint").alias("samples"),
        F.get(counts, F.lit(0)).cast("bigint").alias("class_0"),
        F.get(counts, F.lit(1)).cast("bigint").alias("class_1"),
        F.col("prediction").cast("int").alias("prediction"),
    )
