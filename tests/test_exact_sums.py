"""Sums that don't depend on the order of the rows."""

import math
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from readsift.operators.exact import Total, binned_sums, exact_sum, totals
from readsift.operators.profile import moments


def _hard(seed, n=600):
    r = random.Random(seed)
    made = [r.uniform(-1, 1) * 10.0 ** r.randint(-30, 30) for _ in range(n)]
    return made + [0.0, -0.0, 1e-300, 2.0**15, 2.0**16, -(2.0**16), 2.0**16 - 2.0**-36, 1 / 3, 1e100, -1e100]


@pytest.mark.parametrize("values", [_hard(1), [0.1] * 1000, [1e5 + i * 1e-9 for i in range(500)], [7.25]])
def test_moments_are_correctly_rounded_and_alike_on_any_partitioning(spark, values):
    df = spark.createDataFrame([(v, None if i % 7 else v) for i, v in enumerate(values)], "x double, y double")
    found = [tuple(moments(df.repartition(k), ["x", "y"]).collect()) for k in (1, 3, 11)]
    assert found[0] == found[1] == found[2]
    for row, column in zip(found[0], (values, values[::7])):
        exact = [Fraction(v) for v in column]
        mean = sum(exact) / len(exact)
        spread = sum((v - mean) ** 2 for v in exact) / len(exact)
        assert row["mean"] == float(mean) and row["std"] == pytest.approx(math.sqrt(spread), rel=1e-15)


def test_values_without_a_number(spark):
    rows = [("n", None), ("i", math.inf), ("i", 1.0), ("z", math.nan), ("s", 1e-300), ("s", 2.0), ("b", 1e200), ("m", 1.0), ("m", None)]
    df = spark.createDataFrame(rows, "g string, x double")
    got = {r["g"]: r["t"] for r in exact_sum(df, ["g"], "x", "t").collect()}
    assert got == {"i": None, "z": None, "s": 2.0, "b": 1e200, "m": 1.0}
    per = {g: totals(binned_sums(df.where(F.col("g") == g), ["x"]), ["x"])["x"] for g in "nizsbm"}
    assert per["n"].mean is None and per["n"].deviation is None and math.isnan(per["i"].mean)
    assert math.isnan(per["b"].deviation) and (per["m"].mean, per["m"].deviation) == (1.0, 0.0)
    assert moments(df.limit(0), ["x"]).first()["mean"] is None


def test_totals_of_groups_add_up(spark):
    values = _hard(3)[:-2]
    df = spark.createDataFrame([(i % 5, v) for i, v in enumerate(values)], "g int, x double")
    by_group: dict[int, Total] = {}
    for row in binned_sums(df, ["x"], ["g"]).collect():
        by_group.setdefault(row["g"], Total()).add(row)
    whole = sum(by_group.values(), Total())
    assert whole.n == len(values) and whole.first == sum(Fraction(v) for v in values if abs(v) >= 2.0**-960)
    sums = {r["g"]: r["t"] for r in exact_sum(df, ["g"], "x", "t").collect()}
    assert all(sums[g] == pytest.approx(float(t.first), rel=1e-14) for g, t in by_group.items())
