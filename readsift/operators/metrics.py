"""Scores of a frame of labels, predictions and probabilities.

Every function takes ``by``: columns (model, fold, size) to score separately in
the same pass.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from readsift.operators.profile import bin_number

# Fixed value: the top probability edge lies this far above one, which puts a
# score equal to an inner edge into the lower bin.
_EDGE_SLACK = 1e-8


def _share(hit: Column, of: Column) -> Column:
    """hit / of, 0 where ``of`` is 0."""
    return F.when(of == 0, F.lit(0.0)).otherwise(hit / of)


def accuracy_of(label: str = "label", prediction: str = "prediction", count: Column | int = 1) -> Column:
    right = F.col(label) == F.col(prediction)
    return F.sum(F.when(right, count).when(~right, 0)) / F.sum(F.when(right.isNotNull(), count))


def _sum_where(condition: Column, count: Column | int = 1) -> Column:
    return F.sum(F.when(condition, count).otherwise(0))


def precision_of(label: str = "label", prediction: str = "prediction", count: Column | int = 1) -> Column:
    called = F.col(prediction) == 1
    return _share(_sum_where(called & (F.col(label) == 1), count), _sum_where(called, count))


def recall_of(label: str = "label", prediction: str = "prediction", count: Column | int = 1) -> Column:
    positive = F.col(label) == 1
    return _share(_sum_where(positive & (F.col(prediction) == 1), count), _sum_where(positive, count))


METRICS = {"accuracy": accuracy_of, "precision": precision_of, "recall": recall_of}


def scores(df: DataFrame, metrics: Sequence[str] = ("accuracy",), by: Sequence[str] = (), count: str | None = None) -> DataFrame:
    """``count`` names a column of how many rows a row stands for."""
    each = 1 if count is None else F.col(count)
    return df.groupBy(*by).agg(*[METRICS[m](count=each).alias(m) for m in metrics])


def confusion(df: DataFrame, by: Sequence[str] = (), label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Counts and shares of all rows: tn, fp, fn, tp. Absent cells are 0."""
    y, p = F.col(label), F.col(prediction)
    cells = {
        "tn": (y == 0) & (p == 0),
        "fp": (y == 0) & (p == 1),
        "fn": (y == 1) & (p == 0),
        "tp": (y == 1) & (p == 1),
    }
    counted = df.groupBy(*by).agg(*[_sum_where(c).alias(name) for name, c in cells.items()])
    total = sum((F.col(name) for name in cells), F.lit(0))
    return counted.withColumns({f"{name}_share": _share(F.col(name), total) for name in cells})


def prediction_counts(df: DataFrame, by: Sequence[str] = (), prediction: str = "prediction") -> DataFrame:
    return df.groupBy(*by, prediction).agg(F.count(F.lit(1)).alias("n"))


def brier_of(label: str = "label", probability: str = "p1") -> Column:
    return F.avg((F.col(probability) - F.col(label)) * (F.col(probability) - F.col(label)))


def reliability_edges(bins: int) -> list[float]:
    return [i * ((1.0 + _EDGE_SLACK) / bins) for i in range(bins + 1)]


def calibration_curve(
    df: DataFrame, bins: int = 10, by: Sequence[str] = (), label: str = "label", probability: str = "p1"
) -> DataFrame:
    """Mean score and share of positives per uniform score bin; empty bins are absent."""
    number = bin_number(F.col(probability), [F.lit(e) for e in reliability_edges(bins)])
    return (
        df.groupBy(*by, number.alias("bin"))
        .agg(
            F.avg(probability).alias("mean_predicted"),
            F.avg(F.col(label).cast("double")).alias("fraction_positive"),
            F.count(F.lit(1)).alias("n"),
        )
    )


def probability_histogram(
    df: DataFrame, bins: int = 10, by: Sequence[str] = (), probability: str = "p1"
) -> DataFrame:
    """Scores per tenth of [0, 1], empty bins included."""
    number = bin_number(F.col(probability), [F.lit(i * (1.0 / bins)) for i in range(bins + 1)])
    inside = df.where(F.col(probability).between(0.0, 1.0))
    counted = inside.groupBy(*by).agg(*[_sum_where(number == i).alias(f"b{i}") for i in range(bins)])
    cells = F.array(*[F.struct(F.lit(i).alias("bin"), F.col(f"b{i}").alias("n")) for i in range(bins)])
    return counted.select(*by, F.explode(cells).alias("c")).select(*by, "c.bin", "c.n")


def _confidence_of(probability: str) -> list[Column]:
    p1 = F.col(probability)
    p0 = F.lit(1.0) - p1
    sure = {"positive": F.when(p1 > 0.5, p1), "negative": F.when(p0 > 0.5, p0)}
    return [
        *[F.avg(c).alias(f"{side}_mean") for side, c in sure.items()],
        *[F.stddev_pop(c).alias(f"{side}_std") for side, c in sure.items()],
    ]


def confidence_summary(df: DataFrame, by: Sequence[str] = (), probability: str = "p1") -> DataFrame:
    """Mean and deviation of the scores above one half, per predicted side."""
    return df.groupBy(*by).agg(*_confidence_of(probability))


def compare_models(
    df: DataFrame, by: Sequence[str] = ("model",), label: str = "label", probability: str = "p1"
) -> DataFrame:
    """Accuracy, Brier score and confidence of several scored models, in one pass."""
    return df.groupBy(*by).agg(
        accuracy_of(label).alias("accuracy"),
        brier_of(label, probability).alias("brier"),
        *_confidence_of(probability),
    )


def mean_and_deviation(df: DataFrame, by: Sequence[str], value: str = "value") -> DataFrame:
    """Average and population deviation of fold scores."""
    return df.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))
