"""What every learner offers, and the fitted pair of encoding and model."""

from __future__ import annotations

import json
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import DataFrame, functions as F

from readsift.config import FeatureSpec
from readsift.operators.encode import Categories, Encoding, fit_encoding


class Model(Protocol):
    def transform(self, df: DataFrame) -> DataFrame:
        """Add ``prediction`` (0/1), ``p1`` (probability of class 1, or NULL) and
        ``score`` (what calibration reads: the probability or a margin)."""


class Learner(Protocol):
    name: str

    def fit(self, encoded: DataFrame, encoding: Encoding) -> Model:
        """Train on an encoded frame with an integer ``label``."""


@dataclass(frozen=True)
class Fitted:
    """Encoding and model applied to raw feature frames."""

    encoding: Encoding
    model: Model

    def transform(self, df: DataFrame) -> DataFrame:
        return self.model.transform(labelled(self.encoding.transform(df), self.encoding.spec))


def labelled(df: DataFrame, spec: FeatureSpec) -> DataFrame:
    if spec.label in df.columns:
        return df.withColumn("label", F.col(spec.label).cast("int"))
    return df


def fit(
    learner: Learner, train: DataFrame, spec: FeatureSpec, vocabulary_from: DataFrame | Categories | None = None
) -> Fitted:
    """Encode the training rows and train on them."""
    return fit_encoded(learner, train, fit_encoding(train, spec, vocabulary_from))


def fit_encoded(learner: Learner, train: DataFrame, encoding: Encoding) -> Fitted:
    """Train on rows whose encoding is known."""
    return Fitted(encoding, learner.fit(labelled(encoding.transform(train), encoding.spec), encoding))


SCORED = ("label", "prediction", "p1", "score")


def scored_columns(df: DataFrame, *keep: str) -> DataFrame:
    return df.select(*keep, *SCORED)


def table_sum(table: list[float], hot: str = "hot"):
    """Sum of ``table[slot]`` over the slots of a row, as a JVM expression.

    The table is one constant, parsed once when the plan is made, so its length costs neither the plan nor the generated
    code anything. Numbers written by ``repr`` come back as they were.
    """
    values = F.from_json(F.lit(json.dumps([float(v) for v in table])), "array<double>")
    return F.aggregate(F.transform(hot, lambda s: F.get(values, s)), F.lit(0.0), lambda a, x: a + x)
