"""Isotonic fits over parts against one pass over all scores."""

import random

import numpy as np
import pytest
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import functions as F

from readsift.learners.isotonic import IsotonicSteps, isotonic_blocks, pool


def _made(kind, n=400):
    r = random.Random(2)
    shape = {
        "rising": lambda i: r.random() < i / n, "falling": lambda i: r.random() > i / n, "saw": lambda i: r.random() < (i * 7 % n) / n,
        "split": lambda i: i > n // 2, "flat": lambda i: i % 2, "one": lambda i: 1,
    }[kind]
    return [((i // 3) / 10, int(shape(i))) for i in range(n)]


@pytest.mark.parametrize("kind", ["rising", "falling", "saw", "split", "flat", "one"])
@pytest.mark.parametrize("parts", [1, 7, 40])
def test_parts_pool_like_one_pass(spark, kind, parts):
    rows = _made(kind)
    df = spark.createDataFrame([*rows, (None, 1), (3.0, None)], "score double, label int")
    blocks = isotonic_blocks(df, parts)
    got = sorted((b.lo, b.hi, b.n, b.ones) for b in blocks.collect())
    merged = {}
    for score, label in rows:
        n, ones = merged.get(score, (0, 0))
        merged[score] = (n + 1, ones + label)
    want = [tuple(b) for b in pool((s, s, n, ones) for s, (n, ones) in sorted(merged.items()))]
    assert got == want
    fitted = IsotonicRegression(featuresCol="score", labelCol="label", predictionCol="p").fit(df.dropna().withColumn("label", F.col("label").cast("double")))
    asked = spark.createDataFrame([(x / 37,) for x in range(-20, 700)] + [(s,) for s in merged] + [(None,)], "score double")
    steps = IsotonicSteps.of(blocks)
    joined = {r.score: r["_cal"] for r in steps._joined(asked, 5).collect()}
    for r in fitted.transform(steps.apply(asked).dropna()).collect():
        assert r["_cal"] == pytest.approx(r.p, abs=1e-12) and joined[r.score] == pytest.approx(r.p, abs=1e-12)
    assert joined[None] is None and steps.apply(asked).where("score IS NULL").first()["_cal"] is None


def test_no_rows_no_values(spark):
    df = spark.createDataFrame([], "score double, label int")
    steps = IsotonicSteps.of(isotonic_blocks(df))
    assert steps.apply(spark.createDataFrame([(1.0,)], "score double")).first()["_cal"] is None


def test_pooling_keeps_means_rising():
    values = np.random.default_rng(3).integers(0, 2, 500)
    blocks = pool((i, i, 1, v) for i, v in enumerate(values))
    means = [ones / n for _, _, n, ones in blocks]
    assert all(a < b for a, b in zip(means, means[1:])) and sum(b[2] for b in blocks) == 500
