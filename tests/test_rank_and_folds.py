import hashlib

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from readsift.config import Experiment
from readsift.operators import folds
from readsift.operators.rank import row_index, seeded_rank


def _numbers(spark, n):
    return spark.range(n).withColumnRenamed("id", "row_idx").withColumn("y", (F.col("row_idx") % 3 == 0).cast("int"))


def test_row_index_counts_through_copies(spark):
    df = spark.range(0, 5000, 1, 7).select((F.col("id") % 5).alias("a"), F.when(F.col("id") % 3 == 0, 1).otherwise(0).alias("b"))
    got = row_index(df, ["a"]).orderBy("row_idx").collect()
    assert [r.row_idx for r in got] == list(range(5000))
    assert [(r.a, r.b) for r in got] == sorted((r.a, r.b) for r in df.collect())


def test_seeded_rank_follows_the_digest(spark):
    got = {r.row_idx: (r.y, r["rank"]) for r in seeded_rank(_numbers(spark, 500), "row_idx", 4, ["y"], hex_digits=2).collect()}
    for y in (0, 1):
        keys = [k for k, (label, _) in got.items() if label == y]
        keys.sort(key=lambda k: hashlib.md5(f"4:{k}".encode()).hexdigest())
        assert [got[k][1] for k in keys] == list(range(len(keys)))


def test_seeded_rank_of_null_group(spark):
    df = spark.range(40).select(F.col("id").alias("row_idx"), F.when(F.col("id") < 10, 1).alias("y"))
    ranks = [r["rank"] for r in seeded_rank(df, "row_idx", 0, ["y"]).where("y IS NULL").collect()]
    assert sorted(ranks) == list(range(30))


def test_sliding_folds_of_a_hundred_rows(spark):
    members = folds.fold_membership(_numbers(spark, 100), folds.sliding_folds(100, 10, 0.8)).collect()
    for i in range(10):
        mine = [(m.row_idx, m.role) for m in members if m.fold == i]
        assert sorted(r for r, role in mine if role == "train") == list(range(10 * i, 10 * i + 8))
        assert sorted(r for r, role in mine if role == "test") == [10 * i + 8, 10 * i + 9]


def test_sliding_folds_leave_the_tail_out(spark):
    members = folds.fold_membership(_numbers(spark, 107), folds.sliding_folds(107, 10, 0.8))
    assert members.agg(F.max("row_idx")).first()[0] == 99


def test_too_few_rows_fail():
    for make in (lambda: folds.sliding_folds(10, 10, 0.8), lambda: folds.expanding_folds(10, 10)):
        with pytest.raises(ValueError):
            make()


def test_expanding_folds_train_on_everything_before(spark):
    members = folds.fold_membership(_numbers(spark, 25), folds.expanding_folds(25, 4)).collect()
    for i in range(4):
        train = [m.row_idx for m in members if m.fold == i and m.role == "train"]
        test = sorted(m.row_idx for m in members if m.fold == i and m.role == "test")
        assert sorted(train) == list(range(test[0])) and len(test) == 5
    assert max(m.row_idx for m in members) == 24


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 10_000), min_size=1, max_size=6), st.floats(0.01, 0.99))
def test_class_quotas_add_up_and_stay_near_their_share(counts, share):
    classes = dict(enumerate(counts))
    size = folds.ordered_train_size(sum(counts), share)
    quota = folds.class_quotas(classes, size)
    assert sum(quota.values()) == size
    assert all(abs(quota[c] - size * k / sum(counts)) < 1 for c, k in classes.items())


def test_stratified_folds_are_balanced_and_repeatable(spark):
    df = _numbers(spark, 1003)
    dealt = folds.stratified_fold_column(df, "y", 7, 1)
    per_class = dealt.groupBy("y", "fold").count().collect()
    for y in (0, 1):
        sizes = [r["count"] for r in per_class if r.y == y]
        assert len(sizes) == 7 and max(sizes) - min(sizes) <= 1
    again = folds.stratified_fold_column(df, "y", 7, 1)
    assert {tuple(r) for r in dealt.select("row_idx", "fold").collect()} == {tuple(r) for r in again.select("row_idx", "fold").collect()}


def test_permutation_keeps_the_labels(spark):
    df = _numbers(spark, 300)
    shuffled = folds.permute_labels(df, "y", 5)
    assert shuffled.count() == 300
    assert shuffled.agg(F.sum("y")).first()[0] == df.agg(F.sum("y")).first()[0]
    moved = shuffled.alias("a").join(df.alias("b"), "row_idx").where("a.y <> b.y").count()
    assert moved > 0


def test_scheme_follows_the_settings(spark):
    df = _numbers(spark, 60)
    for setting, count in (
        (Experiment(folds=4), 4),
        (Experiment(folds=4, expanding=False), 4),
        (Experiment(folds=4, time_series=False), 4),
        (Experiment(folds=4, time_series=False, repeated=True, repeats=2), 8),
    ):
        marked, cuts = folds.fold_scheme(df, 60, setting, "y")
        assert len(cuts) == count
        if not setting.time_series:
            tested = marked.select(*[F.sum(F.when(f.test, 1).otherwise(0)) for f in cuts]).first()
            assert sum(tested) == 60 * (count // 4)


def test_seeded_rank_moves_numbers_and_sends_the_starts(spark):
    from readsift.session import stage

    df = stage(_numbers(spark, 300), "numbers")
    ranked = seeded_rank(df, "row_idx", 4, ["y"])
    plan = ranked._jdf.queryExecution().executedPlan().toString()
    # One shuffle, of the digest as numbers; the starts of the slices are broadcast.
    assert plan.count("Exchange hashpartitioning") == 1 and "BroadcastHashJoin" in plan and "_digest" not in plan
    for digits in (1, 6):
        same = {r.row_idx: r["rank"] for r in seeded_rank(df, "row_idx", 4, ["y"], hex_digits=digits).collect()}
        assert same == {r.row_idx: r["rank"] for r in ranked.collect()}


def test_ranks_sort_the_bytes_of_the_digest_by_slice_first(spark):
    plan = seeded_rank(_numbers(spark, 50), "row_idx", 4, ["y"])._jdf.queryExecution().executedPlan().toString()
    assert "conv(" not in plan and "Sort [_slice" in plan


def test_ranks_of_many_members_come_from_one_shuffle(spark):
    df = _numbers(spark, 400).withColumn("fold", (F.col("row_idx") % 3).cast("int"))
    members = [F.col("fold") != i for i in range(3)]
    from readsift.operators.rank import seeded_ranks

    ranked = seeded_ranks(df, "row_idx", 4, members, "ranks")
    assert ranked._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    got = {r.row_idx: r.ranks for r in ranked.collect()}
    for i, member in enumerate(members):
        alone = {r.row_idx: r["rank"] for r in seeded_rank(df.where(member), "row_idx", 4).collect()}
        assert {k: ranks[i] for k, ranks in got.items() if ranks[i] is not None} == alone
    assert len(got) == 400
