"""The rectified network: slopes, steps, stopping and repeatability."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from readsift.config import FeatureSpec
from readsift.learners import fit, learner, rectified
from readsift.learners.rectified import Shape, adam_step

SPEC = FeatureSpec(("c",), ("x", "z"), ("b",), "y")


def test_slopes_equal_finite_differences():
    draw = np.random.default_rng(5)
    shape = Shape(4, 2, 3)
    flat = shape.start(1)
    hot, numbers, label = draw.integers(0, 5, (9, 2)), draw.normal(size=(9, 2)), draw.integers(0, 2, 9).astype(float)
    _, slope = shape.loss_and_slope(flat, hot, numbers, label, 0.3)
    unknown = set(range(4 * 3, 5 * 3))
    for i in range(shape.size):
        if i in unknown:
            assert slope[i] == 0.0 == flat[i]
            continue
        up, down = flat.copy(), flat.copy()
        up[i] += 1e-6
        down[i] -= 1e-6
        high, low = (shape.loss_and_slope(f, hot, numbers, label, 0.3)[0] for f in (up, down))
        assert slope[i] == pytest.approx((high - low) / 2e-6, abs=1e-6)


def test_adam_steps_as_defined():
    flat, first, second = np.array([1.0, -2.0]), np.zeros(2), np.zeros(2)
    m = v = np.zeros(2)
    want = flat.copy()
    for t, slope in enumerate([np.array([0.5, -1.0]), np.array([0.1, 3.0])], 1):
        m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope**2
        want = want - 0.01 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8 / math.sqrt(1 - 0.999**t))
        adam_step(flat, first, second, slope, t, 0.01)
    assert flat == pytest.approx(want, rel=1e-12)


@pytest.fixture(scope="module")
def rows(spark):
    # Neither feature tells the label alone: the sign of the product does.
    made = []
    for i in range(500):
        x, z = math.sin(i * 12.9898), math.cos(i * 78.233)
        made.append((i, "uvw"[i % 3], x, z, i % 2, int(x * z > 0)))
    return spark.createDataFrame(made, "row_idx long, c string, x double, z double, b int, y int").cache()


def _net(**options):
    return learner("rectified_network", hidden=16, rate=0.02, batch=20, **options)


def test_it_learns_what_no_line_divides(rows):
    model = fit(_net(max_rounds=30), rows, SPEC)
    hit = F.avg((F.col("label") == F.col("prediction")).cast("int"))
    assert model.transform(rows).agg(hit).first()[0] > 0.9
    line = fit(learner("linear_svm", max_rounds=20), rows, SPEC).transform(rows).agg(hit).first()[0]
    assert line < 0.7
    odd = model.transform(rows.limit(1).withColumn("c", F.lit("new"))).first()
    assert 0 <= odd.p1 <= 1


@pytest.mark.parametrize("shard_rows", [50_000, 100])
def test_partitions_do_not_change_a_network(rows, monkeypatch, shard_rows):
    monkeypatch.setattr(rectified, "SHARD_ROWS", shard_rows)
    models = [fit(_net(max_rounds=3), rows.repartition(k), SPEC).model for k in (2, 9)]
    assert np.array_equal(models[0].flat, models[1].flat) and models[0].held_loss == models[1].held_loss


def test_held_out_loss_stops_it(rows):
    noise = rows.withColumn("y", (F.hash("row_idx") % 2 == 0).cast("int"))
    model = fit(_net(max_rounds=100, patience=3), noise, SPEC).model
    assert model.rounds < 60 and model.held_loss is not None
    full = fit(_net(max_rounds=4, validation_share=0.0), rows, SPEC).model
    assert full.rounds == 4 and full.held_loss is None


def test_a_slice_of_weights_is_mixed_exactly_in_any_order():
    w = [np.array([1e16, 0.1]), np.array([1.0, 0.2]), np.array([-1e16, math.inf])]
    parts = pd.DataFrame({"slice": 4, "w": [x.tobytes() for x in w], "n": [1.0, 3.0, 1.0], "held": 2.0, "held_loss": [1e16, 1.0, -1e16]})
    for order in ([0, 1, 2], [2, 0, 1]):
        row = rectified._mix(parts.iloc[order]).iloc[0]
        assert (row.slice, row.n, row.held, row.held_loss) == (4, 5.0, 6.0, 1.0)
        found = np.frombuffer(row.w, float)
        assert found[0] == 3.0 and math.isnan(found[1])


def test_a_shard_leaves_its_task_in_slices(rows):
    wide = Shape(4, 3, 200)
    state = np.concatenate([wide.start(0), np.zeros(2 * wide.size)])
    train = rows.selectExpr("array(0, 3) AS hot", "array(x, z, CAST(b AS DOUBLE)) AS numbers", "y AS label", "row_idx < 50 AS held_out", "0 AS shard")
    task = rectified._round(state, 0, wide, rectified.RectifiedNetwork(hidden=200))
    parts = train.coalesce(1).mapInArrow(task, rectified._PART_SCHEMA).toPandas()
    assert len(parts) > 1 and max(map(len, parts["w"])) <= 8 * rectified.SLICE
    assert sum(map(len, parts["w"])) == 8 * len(state) and set(parts["n"]) == {450.0} and set(parts["held"]) == {50.0}
