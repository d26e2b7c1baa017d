import math
from collections import Counter

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from readsift.config import FeatureSpec
from readsift.learners import fit, learner
from readsift.operators.duplicates import near_duplicate_rate
from readsift.operators.encode import categories, fit_encoding, nonzero_entries
from readsift.operators import neighbours
from readsift.operators.neighbours import nearest

SPEC = FeatureSpec(("c", "m"), ("x",), ("b",), "y")


def _rows(spark, rows):
    return spark.createDataFrame(rows, "row_idx long, c string, m int, x double, b int, y int")


def test_unseen_category_is_all_zeros_and_numbers_sort_as_numbers(spark):
    train = _rows(spark, [(0, "RES", 10, 1.0, 0, 1), (1, "COMM", 2, 3.0, 1, 0)])
    encoding = fit_encoding(train, SPEC)
    assert encoding.labels == (("COMM", "RES"), ("2", "10"))
    assert encoding.width == 6
    other = _rows(spark, [(2, "NEW", 10, 2.0, 1, 0), (3, None, None, 5.0, 0, 0)])
    got = encoding.transform(other).select("row_idx", vector_to_array("features").alias("v"), "hot").orderBy("row_idx").collect()
    assert got[0].v == [0, 0, 0, 1, 0.0, 1.0] and got[0].hot == [3, 4]
    assert got[1].v == [0, 0, 0, 0, 3.0, 0.0] and got[1].hot == [4, 4]


def test_scaled_numbers_have_mean_zero_and_population_deviation_one(spark):
    df = _rows(spark, [(i, "a", 1, float(i * i), 0, 0) for i in range(50)])
    z = fit_encoding(df, SPEC).transform(df).select(F.get("numbers", F.lit(0)).alias("z"))
    mean, std = z.agg(F.avg("z"), F.stddev_pop("z")).first()
    assert abs(mean) < 1e-9 and abs(std - 1) < 1e-9


def test_constant_column_is_divided_by_one(spark):
    df = _rows(spark, [(i, "a", 1, 4.0, 0, 0) for i in range(5)])
    assert fit_encoding(df, SPEC).stats["x"] == (4.0, 1.0)


def test_missing_feature_column_fails(spark):
    with pytest.raises(ValueError):
        fit_encoding(_rows(spark, []).drop("b"), SPEC)


def _mixed(rng, n, start=0):
    hot = np.sort(np.column_stack([rng.integers(0, 4, n), 4 + rng.integers(0, 5, n)]), axis=1)
    hot[rng.random(n) < 0.05, 1] = 9  # unknown second category
    numbers = np.round(rng.normal(size=(n, 2)), 2)
    copies = rng.random(n) < 0.3
    hot[copies], numbers[copies] = [0, 4], [0.0, 0.0]  # a third of the rows are copies
    return [(start + i, hot[i].tolist(), numbers[i].tolist(), float(i % 2)) for i in range(n)]


def _dense(row):
    one_hot = np.zeros(10)
    one_hot[row[1]] = 1
    return np.concatenate([one_hot[:9], row[2]])


def _brute(queries, base, k, exclude_self):
    want = {}
    for q in queries:
        d2 = [(round(float(((_dense(q) - _dense(b)) ** 2).sum()), 9), b[0]) for b in base if not (exclude_self and b[0] == q[0])]
        want[q[0]] = [i for _, i in sorted(d2)[:k]]
    return want


@pytest.mark.parametrize("exclude_self", [False, True])
@pytest.mark.parametrize("block_rows", [20, 100_000])
def test_search_equals_brute_force(spark, exclude_self, block_rows):
    rng = np.random.default_rng(11)
    base = _mixed(rng, 400)
    queries = base[:120] if exclude_self else _mixed(rng, 120, 1000)
    schema = "id long, hot array<int>, numbers array<double>, label double"
    got = nearest(
        spark.createDataFrame(queries, schema), spark.createDataFrame(base, schema), 4, 9, exclude_self,
        block_rows=block_rows, chunk_rows=16,
    ).collect()
    found = {}
    for r in sorted(got, key=lambda r: (r.query_id, r["rank"])):
        found.setdefault(r.query_id, []).append(r.neighbour_id)
    assert found == _brute(queries, base, 4, exclude_self)


@pytest.mark.parametrize("exclude_self", [False, True])
@pytest.mark.parametrize("block_rows, columns", [(20, 2), (100_000, 6)])
def test_lists_find_what_brute_force_finds(spark, exclude_self, block_rows, columns):
    """Rows of many columns that agree often, a third of them copies, unknown categories and no category at all."""
    rng = np.random.default_rng(columns)

    def made(n, start=0):
        hot = 4 * np.arange(columns) + (rng.integers(0, 4, (n, columns)) * (rng.random((n, columns)) < 0.4)).astype(int)
        hot[rng.random((n, columns)) < 0.05] = 4 * columns
        hot[::50] = 4 * columns
        copies = rng.random(n) < 0.3
        hot[copies] = 4 * np.arange(columns)
        numbers = np.round(rng.normal(size=(n, 2)), 1)
        return [(start + i, sorted(hot[i].tolist()), numbers[i].tolist(), float(i % 2)) for i in range(n)]

    base = made(300)
    queries = base[:90] if exclude_self else made(90, 1000) + [(5000, [4 * columns] * columns, [0.0, 0.0], 0.0)]
    schema = "id long, hot array<int>, numbers array<double>, label double"
    got = nearest(
        spark.createDataFrame(queries, schema), spark.createDataFrame(base, schema), 3, 4 * columns, exclude_self,
        block_rows=block_rows, chunk_rows=16, held_rows=0,
    ).collect()
    found = {}
    for r in sorted(got, key=lambda r: (r.query_id, r["rank"])):
        found.setdefault(r.query_id, []).append((r.neighbour_id, round(r.distance**2, 6)))

    def d2(a, b):
        x, y = set(a[1]) - {4 * columns}, set(b[1]) - {4 * columns}
        return round(len(x ^ y) + sum((u - v) ** 2 for u, v in zip(a[2], b[2])), 9)

    for q in queries:
        want = sorted((d2(q, b), b[0]) for b in base if not (exclude_self and b[0] == q[0]))[:3]
        assert found[q[0]] == [(i, round(d, 6)) for d, i in want]


def test_levels_find_what_brute_force_finds(spark):
    """Columns enough for several levels, some undecided by others, odd rows and numbers too large for single precision."""
    rng = np.random.default_rng(3)
    n, columns = 700, 12
    hot = 10 * np.arange(columns) + rng.integers(0, 10, (n, columns)) * (rng.random((n, columns)) < 0.5)
    hot[:, 1] = hot[:, 0] + 10
    numbers = np.round(rng.normal(size=(n, 2)), 1)
    hot[::90, 3], numbers[5::200] = 999, [1e30, 0.0]
    numbers[3::200] = [-4000.5, 70.0]
    schema = "id long, hot array<int>, numbers array<double>, label double"
    rows = [(i, sorted(hot[i].tolist()), numbers[i].tolist(), 0.0) for i in range(n)]
    df = spark.createDataFrame(rows, schema)
    sets = [set(r[1]) - {999} for r in rows]
    d2 = np.array([[len(a ^ b) for b in sets] for a in sets], float)
    for j in range(2):
        d2 += (numbers[:, j][:, None] - numbers[:, j][None, :]) ** 2
    d2 = np.round(d2, 9)
    np.fill_diagonal(d2, np.inf)
    for k, within in ((3, None), (1, 2.5)):
        want = {}
        for i in range(n):
            near = [j for j in np.lexsort((np.arange(n), d2[i])) if j != i and (within is None or math.sqrt(d2[i, j]) <= within)]
            want[i] = near[:k]
        got = {i: [] for i in range(n)}
        for r in sorted(nearest(df, df, k, 999, True, held_rows=0, within=within, copy_pairs=0).collect(), key=lambda r: (r.query_id, r["rank"])):
            got[r.query_id].append(r.neighbour_id)
        assert got == want
        assert nearest(df, df, k, 999, True, within=within).count() == sum(map(len, want.values()))


def test_only_what_lies_within_is_searched(spark, monkeypatch):
    """Near duplicates are looked up where classes of columns agree, not among all rows."""
    rng = np.random.default_rng(4)
    hot = 20 * np.arange(14) + rng.integers(0, 20, (600, 14))
    hot[300:] = hot[:300]
    hot[300:, 5] = 100 + (hot[:300, 5] - 99) % 20
    df = spark.createDataFrame([(i, hot[i].tolist(), [0.0]) for i in range(600)], "row_idx long, hot array<int>, numbers array<double>")
    monkeypatch.setattr(neighbours, "UNIT_ROWS", 10)
    met, search = [], neighbours._search

    def counted(visits, lists, *args):
        met.append(visits.groupBy("unit").count().join(lists.groupBy("unit").agg(F.count(F.lit(1)).alias("n")), "unit").agg(F.sum(F.col("count") * F.col("n"))).first()[0])
        return search(visits, lists, *args)

    monkeypatch.setattr(neighbours, "_search", counted)
    found = neighbours.nearest(df.withColumnRenamed("row_idx", "id"), df.withColumnRenamed("row_idx", "id"), 1, 999, True, held_rows=0, within=2.0, copy_pairs=0)
    assert found.count() == 600 and sum(met) < 600 * 600 * 0.8


def test_fewer_base_rows_than_k(spark):
    schema = "id long, hot array<int>, numbers array<double>, label double"
    base = spark.createDataFrame([(1, [0], [0.0], 1.0), (2, [1], [0.0], 0.0)], schema)
    assert nearest(base, base, 5, 2).count() == nearest(base, base, 5, 2, held_rows=0).count() == 4
    assert nearest(base, base.limit(0), 5, 2).count() == 0


def test_near_duplicate_rate(spark):
    rows = [(0, [0], [0.0]), (1, [0], [0.1]), (2, [1], [9.0])]
    df = spark.createDataFrame(rows, "row_idx long, hot array<int>, numbers array<double>")
    assert near_duplicate_rate(df, 2, 0.5).first()["n_near"] == 2


def _many(spark, n):
    rows = [(i, f"v{i * 7 % 997}", i % 13, math.sin(i), i % 2, i % 2) for i in range(n)]
    return _rows(spark, rows)


@pytest.mark.parametrize("spec", [SPEC, FeatureSpec(("m", "c"), ("x",), ("b",), "y"), FeatureSpec(("c",), ("x",), (), "y")])
@pytest.mark.parametrize("looked_up", [0, 13, 400])
def test_joined_columns_encode_like_looked_up_ones(spark, spec, looked_up):
    train = _many(spark, 700)
    other = train.unionByName(_rows(spark, [(9000, "new", 4, 1.0, 1, 0), (9001, None, None, 2.0, 0, 0), (9002, "v7", 99, 0.5, 0, 1)]))
    found = categories(train, spec, looked_up)
    assert found.table is not None and sum(map(len, found.listed.values())) <= looked_up
    views = []
    for vocabulary in (None, found):
        out = fit_encoding(train, spec, vocabulary).transform(other)
        assert not [c for c in out.columns if c.startswith("_")]
        rows = out.select("row_idx", "hot", "numbers", vector_to_array("features").alias("v")).orderBy("row_idx").collect()
        long = nonzero_entries(out, "row_idx").collect()
        assert Counter((r.row_idx, r.position, r.value) for r in long) == Counter(
            (r.row_idx, i, x) for r in rows for i, x in enumerate(r.v) if x
        )
        views.append(rows)
    assert views[0] == views[1]


def test_a_quarter_of_a_million_categories_fit(spark):
    n = 250_000
    df = spark.range(2 * n).select(
        F.col("id").alias("row_idx"), F.concat(F.lit("v"), F.col("id") % n).alias("c"), (F.col("id") % 3).cast("int").alias("m"),
        (F.col("id") % 17).cast("double").alias("x"), F.lit(0).alias("b"), (F.col("id") % 2).cast("int").alias("y"),
    )
    encoding = fit_encoding(df, SPEC)
    assert encoding.width_hot == n + 3 and encoding.labels == (None, ("0", "1", "2"))
    order = {v: i for i, v in enumerate(sorted(f"v{i}" for i in range(n)))}
    for r in encoding.transform(df).where("row_idx % 50021 = 7").select("c", "m", "hot").collect():
        assert r.hot == [order[r.c], n + r.m]
    # Even ids all carry label 0: the value alone tells it.
    model = fit(learner("bayes"), df, SPEC).transform(df.where("row_idx % 100 < 3")).agg(F.avg((F.col("label") == F.col("prediction")).cast("int")))
    assert model.first()[0] == 1.0
