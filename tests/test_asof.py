from datetime import datetime, timedelta

import numpy as np
from pyspark.sql import functions as F

from readsift.operators.asof import asof_backward, neighbour_instants
from readsift.operators.interval import earliest_by_day, join_in_force, time_span

START = datetime(2024, 1, 1)


def _frame(spark, rows):
    return spark.createDataFrame(rows, "k int, t timestamp_ntz, v int")


def _literal(probes, base):
    found = set()
    for k, t in {(k, t) for k, t, _ in probes}:
        times = sorted({b for kb, b, _ in base if kb == k})
        before = [b for b in times if b < t]
        after = [b for b in times if b > t]
        found.add(
            (k, t, before[-1] if before else None, before[-2] if len(before) > 1 else None, after[0] if after else None)
        )
    return found


def test_neighbours_match_literal_lookup_with_a_dominant_key(spark):
    rng = np.random.default_rng(3)

    def rows(n):
        # Half of all rows belong to one key; coarse times give many copies.
        keys = np.where(rng.random(n) < 0.5, 0, rng.integers(1, 6, n))
        hours = rng.integers(0, 24 * 12, n)
        return [(int(k), START + timedelta(hours=int(h)), int(i)) for i, (k, h) in enumerate(zip(keys, hours))]

    probes, base = rows(300), rows(250)
    got = neighbour_instants(_frame(spark, probes), _frame(spark, base), ["k"], "t").collect()
    assert {tuple(r) for r in got} == _literal(probes, base)
    assert len(got) == len({(k, t) for k, t, _ in probes})


def test_slices_without_base_rows_are_bridged(spark):
    base = [(1, START, 0), (1, START + timedelta(days=1), 1), (1, START + timedelta(days=9), 2)]
    probes = [(1, START + timedelta(days=5), 0), (1, START, 1), (2, START, 2)]
    got = {(r.k, r.t): (r.prev_t, r.prev2_t, r.next_t) for r in
           neighbour_instants(_frame(spark, probes), _frame(spark, base), ["k"], "t").collect()}
    assert got[(1, START + timedelta(days=5))] == (base[1][1], base[0][1], base[2][1])
    assert got[(1, START)] == (None, None, base[1][1])
    assert got[(2, START)] == (None, None, None)


def test_coarser_slices_give_the_same_answer(spark):
    base = [(1, START + timedelta(days=3 * i), i) for i in range(40)]
    probes = [(1, START + timedelta(days=2 * i, hours=1), i) for i in range(50)]
    args = (_frame(spark, probes), _frame(spark, base), ["k"], "t")
    monthly = neighbour_instants(*args, slice_of=lambda t: F.trunc(t.cast("date"), "MM"))
    assert {tuple(r) for r in monthly.collect()} == {tuple(r) for r in neighbour_instants(*args).collect()}


def test_timeline_is_exchanged_once(spark):
    rows = [(1, START + timedelta(days=i), i) for i in range(5)]
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = neighbour_instants(_frame(spark, rows), _frame(spark, rows), ["k"], "t")
        plan = found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    exchanges = [line.split("- ")[-1] for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    made = [line for line in exchanges if not line.startswith("ReusedExchange")]
    # The rows move once, by key and slice, and are used twice; no exchange is by instant.
    of_rows = [line for line in made if "REPARTITION" in line]
    assert len(of_rows) == 1 and "_slice" in of_rows[0] and plan.count("ReusedExchange") == 1
    assert not any(" t#" in line.partition(")")[0] for line in made)


def test_copies_of_the_neighbour_fan_out(spark):
    base = [(1, START, 10), (1, START, 11), (1, START - timedelta(days=2), 12)]
    probes = _frame(spark, [(1, START + timedelta(hours=1), 0)]).drop("v")
    got = asof_backward(probes, _frame(spark, base), ["k"], "t").collect()
    assert sorted(r.prev_v for r in got) == [10, 11]


def test_interval_join_edges_and_open_end(spark):
    intervals = spark.createDataFrame(
        [
            (1, "a", datetime(2020, 1, 1), datetime(2024, 1, 10)),
            (1, "b", datetime(2024, 1, 10), datetime(9999, 12, 31)),
            (1, "c", datetime(2024, 1, 5), datetime(2024, 3, 1)),
            (1, "none", datetime(2024, 1, 10), None),
            (1, "empty", datetime(2024, 1, 10), datetime(2024, 1, 10)),
        ],
        "k int, place string, lo timestamp_ntz, hi timestamp_ntz",
    )
    probes = _frame(spark, [(1, datetime(2024, 1, 10), 0), (1, datetime(2024, 1, 9, 23, 59, 59), 1), (2, START, 2), (1, datetime(2024, 3, 1), 3)])
    got = join_in_force(probes, intervals, "k", "t", "lo", "hi", time_span(probes, "t")).collect()
    assert sorted((r.v, r.place) for r in got) == [(0, "b"), (0, "c"), (1, "a"), (1, "c"), (3, "b")]


def test_interval_join_on_no_probes(spark):
    probes = _frame(spark, [])
    intervals = spark.createDataFrame([(1, "a", START, START)], "k int, place string, lo timestamp_ntz, hi timestamp_ntz")
    assert join_in_force(probes, intervals, "k", "t", "lo", "hi", time_span(probes, "t")).count() == 0


def test_interval_join_matches_the_literal_condition(spark):
    rng = np.random.default_rng(5)
    lo = [START + timedelta(days=int(d)) for d in rng.integers(-400, 400, 80)]
    spans = [(int(k), f"p{i}", a, a + timedelta(days=int(n))) for i, (k, a, n) in enumerate(zip(rng.integers(0, 3, 80), lo, rng.integers(0, 300, 80)))]
    probes = [(int(k), START + timedelta(days=int(d)), i) for i, (k, d) in enumerate(zip(rng.integers(0, 3, 60), rng.integers(-300, 300, 60)))]
    want = sorted((v, p) for k, t, v in probes for kb, p, a, b in spans if k == kb and a <= t < b)
    df = _frame(spark, probes)
    intervals = spark.createDataFrame(spans, "k int, place string, lo timestamp_ntz, hi timestamp_ntz")
    got = join_in_force(df, intervals, "k", "t", "lo", "hi", time_span(df, "t")).collect()
    assert sorted((r.v, r.place) for r in got) == want


def test_period_that_starts_after_midnight_skips_its_first_day(spark):
    periods = spark.createDataFrame(
        [(1, datetime(2024, 1, 1, 6), datetime(2024, 1, 3, 12), datetime(2024, 2, 1)), (1, datetime(2024, 1, 3), datetime(2024, 1, 4), datetime(2024, 1, 20))],
        "k int, lo timestamp_ntz, hi timestamp_ntz, bill timestamp_ntz",
    )
    got = earliest_by_day(periods, "k", "lo", "hi", "bill", (datetime(2023, 12, 1), datetime(2024, 6, 1))).collect()
    assert {(r.day.day, r.bill.strftime("%m-%d")) for r in got} == {(2, "02-01"), (3, "01-20"), (4, "01-20")}
