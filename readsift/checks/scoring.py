"""Metrics over stub scores on ``lineitem``: no learner needed to check them."""

from __future__ import annotations

from pyspark.sql import functions as F

from readsift.checks.registering import Book
from readsift.operators import metrics
from readsift.sources.given import given

BOOK = Book()
query = BOOK.query

# A score with eleven values, many of them on bin edges.
_SCORED = (
    "WITH scored AS (SELECT l_returnflag AS model, l_discount * 10 AS p1, "
    "CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END AS label, "
    "CASE WHEN l_discount * 10 > CAST(0.5 AS DOUBLE) THEN 1 ELSE 0 END AS prediction FROM lineitem) "
)


def scored(spark, sf_dir):
    p1 = F.col("l_discount") * 10
    return given(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("model"),
        p1.alias("p1"),
        F.when(F.col("l_linestatus") == "O", 1).otherwise(0).alias("label"),
        F.when(p1 > 0.5, 1).otherwise(0).alias("prediction"),
    )


@query(
    _SCORED + "SELECT avg(CASE WHEN label = prediction THEN 1.0 ELSE 0.0 END) AS accuracy FROM scored",
    rounded=('accuracy',),
)
def metric_accuracy(spark, sf_dir):
    return metrics.scores(scored(spark, sf_dir))


@query(
    _SCORED + "SELECT model, avg(CASE WHEN label = prediction THEN 1.0 ELSE 0.0 END) AS accuracy, "
    "CAST(sum(label * prediction) AS DOUBLE) / sum(prediction) AS precision, "
    "CAST(sum(label * prediction) AS DOUBLE) / sum(label) AS recall FROM scored GROUP BY model",
    rounded=('accuracy', 'precision', 'recall'),
)
def metric_precision_recall(spark, sf_dir):
    return metrics.scores(scored(spark, sf_dir), ("accuracy", "precision", "recall"), ["model"])


_CELLS = (("tn", 0, 0), ("fp", 0, 1), ("fn", 1, 0), ("tp", 1, 1))


@query(
    _SCORED + "SELECT model, "
    + ", ".join(f"CAST(count(*) FILTER (label = {y} AND prediction = {p}) AS BIGINT) AS {c}" for c, y, p in _CELLS)
    + ", " + ", ".join(
        f"CAST(count(*) FILTER (label = {y} AND prediction = {p}) AS DOUBLE) / count(*) AS {c}_share" for c, y, p in _CELLS
    )
    + " FROM scored GROUP BY model",
    rounded=('tn_share', 'fp_share', 'fn_share', 'tp_share'),
)
def confusion_matrix(spark, sf_dir):
    return metrics.confusion(scored(spark, sf_dir), ["model"])


@query(_SCORED + "SELECT label, prediction, CAST(count(*) AS BIGINT) AS n FROM scored GROUP BY label, prediction")
def confusion_counts(spark, sf_dir):
    return metrics.prediction_counts(scored(spark, sf_dir), ["label"])


@query(_SCORED + "SELECT prediction, CAST(count(*) AS BIGINT) AS n FROM scored GROUP BY prediction")
def prediction_counts(spark, sf_dir):
    return metrics.prediction_counts(scored(spark, sf_dir))


@query(
    _SCORED + "SELECT model, avg((p1 - label) * (p1 - label)) AS brier FROM scored GROUP BY model",
    rounded=('brier',),
)
def brier_score(spark, sf_dir):
    return scored(spark, sf_dir).groupBy("model").agg(metrics.brier_of().alias("brier"))


def _bin_sql(edges) -> str:
    return " + ".join(f"CASE WHEN p1 >= CAST('{e!r}' AS DOUBLE) THEN 1 ELSE 0 END" for e in edges[1:-1])


@query(
    _SCORED + f"SELECT model, CAST({_bin_sql(metrics.reliability_edges(10))} AS INT) AS bin, avg(p1) AS mean_predicted, "
    "avg(CAST(label AS DOUBLE)) AS fraction_positive, CAST(count(*) AS BIGINT) AS n FROM scored GROUP BY 1, 2",
    rounded=('mean_predicted', 'fraction_positive'),
)
def calibration_curve(spark, sf_dir):
    return metrics.calibration_curve(scored(spark, sf_dir), 10, ["model"])


@query(
    _SCORED + "SELECT m.model, CAST(i AS INT) AS bin, CAST(count(s.bin) AS BIGINT) AS n "
    "FROM (SELECT DISTINCT model FROM scored) m CROSS JOIN range(10) g(i) LEFT JOIN "
    f"(SELECT model, {_bin_sql([i * 0.1 for i in range(11)])} AS bin FROM scored) s ON s.model = m.model AND s.bin = i GROUP BY 1, 2"
)
def probability_histogram(spark, sf_dir):
    return metrics.probability_histogram(scored(spark, sf_dir), 10, ["model"])


_SURE = (
    "avg(p1) FILTER (p1 > CAST(0.5 AS DOUBLE)) AS positive_mean, avg(1 - p1) FILTER (1 - p1 > CAST(0.5 AS DOUBLE)) AS negative_mean, "
    "stddev_pop(p1) FILTER (p1 > CAST(0.5 AS DOUBLE)) AS positive_std, "
    "stddev_pop(1 - p1) FILTER (1 - p1 > CAST(0.5 AS DOUBLE)) AS negative_std"
)


@query(
    _SCORED + f"SELECT model, {_SURE} FROM scored GROUP BY model",
    rounded=('positive_mean', 'negative_mean', 'positive_std', 'negative_std'),
)
def confidence_summary(spark, sf_dir):
    return metrics.confidence_summary(scored(spark, sf_dir), ["model"])


@query(
    _SCORED + "SELECT model, avg(CASE WHEN label = prediction THEN 1.0 ELSE 0.0 END) AS accuracy, "
    f"avg((p1 - label) * (p1 - label)) AS brier, {_SURE} FROM scored GROUP BY model",
    rounded=('accuracy', 'brier', 'positive_mean', 'negative_mean', 'positive_std', 'negative_std'),
)
def model_comparison(spark, sf_dir):
    return metrics.compare_models(scored(spark, sf_dir))


@query(
    "SELECT avg(l_quantity) AS mean, stddev_pop(l_quantity) AS std, l_returnflag, l_linestatus FROM lineitem GROUP BY ALL",
    rounded=('mean', 'std'),
)
def fold_score_summary(spark, sf_dir):
    """Mean and population deviation per group, as fold scores are summarised."""
    lines = given(spark, sf_dir, "lineitem")
    return metrics.mean_and_deviation(lines, ["l_returnflag", "l_linestatus"], "l_quantity")
