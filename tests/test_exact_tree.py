"""Trees over all splits, wherever a node is finished, and cuts of them."""

import random
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from readsift.config import FeatureSpec
from readsift.learners import exact_tree, fit, learner
from readsift.operators import folds
from readsift.plans import experiment

WIDTH = 5  # slots 0..4; 5 stands for an unknown value
SCHEMA = "tree int, hot array<int>, numbers array<double>, label int, row_idx long"


def _rows(seed, n, trees=2):
    r = random.Random(seed)
    made = []
    for i in range(n):
        hot = [r.choice([0, 1, 5]), r.choice([2, 3, 4, 5])]
        numbers = [round(r.gauss(0, 1), 1), float(r.randrange(2)), 7.0]
        odd = hot[0] == 1 or numbers[0] > 0.4 or (hot[1] == 3 and numbers[1] == 1)
        made.append((r.randrange(trees), sorted(hot), numbers, int(odd ^ (r.random() < 0.1)), i))
    return made + [made[0]] * 5


def _plain(rows, max_depth):
    """Every split of every node tried, by plain loops."""
    def value(row, f):
        return float(f in row[1]) if f < WIDTH else row[2][f - WIDTH]

    def split(rows):
        best = None
        for f in range(WIDTH + 3):
            seen = sorted({value(r, f) for r in rows})
            for low, high in zip(seen, seen[1:]):
                t = low if (low + high) / 2 >= high else (low + high) / 2
                left = [r for r in rows if value(r, f) <= t]
                l, l1 = len(left), sum(r[3] for r in left)  # noqa: E741
                k, k1 = len(rows) - l, sum(r[3] for r in rows) - l1
                score = ((l - l1) * float(l - l1) + l1 * float(l1)) / l + ((k - k1) * float(k - k1) + k1 * float(k1)) / k
                if best is None or score > best[0]:
                    best = (score, f, t)
        return best

    nodes, waiting = {}, [(t, 1, [r for r in rows if r[0] == t]) for t in {r[0] for r in rows}]
    while waiting:
        tree, node, own = waiting.pop()
        ones, depth = sum(r[3] for r in own), node.bit_length() - 1
        best = split(own) if 0 < ones < len(own) and depth < max_depth else None
        nodes[tree, node] = (depth, len(own) - ones, ones, *(best[1:] if best else (None, None)))
        if best:
            for side in (0, 1):
                waiting.append((tree, 2 * node + side, [r for r in own if (value(r, best[1]) > best[2]) == bool(side)]))
    return nodes


@pytest.mark.parametrize("local_rows", [0, 40, 10_000])
@pytest.mark.parametrize("max_depth", [0, 1, 6])
def test_trees_equal_a_search_of_all_splits(spark, local_rows, max_depth):
    rows = _rows(3, 220)
    nodes = exact_tree.grow(spark.createDataFrame(rows, SCHEMA), WIDTH, max_depth, local_rows, slice_values=4)
    got = {(r.tree, r.node): (r.depth, r.class_0, r.class_1, r.feature, r.threshold) for r in nodes.collect()}
    assert got == _plain(rows, max_depth)


def test_deep_trees_and_trees_without_rows(spark):
    # Labels that alternate along one column: each split takes off little, down to the bottom.
    rows = [(0, [0, 5], [float(2 ** (i % 40)), 0.0, 0.0], i % 2, i) for i in range(40)]
    nodes = exact_tree.grow(spark.createDataFrame(rows, SCHEMA), WIDTH, 50)
    assert nodes.where("feature IS NULL AND class_0 > 0 AND class_1 > 0").count() == 0
    assert exact_tree.grow(spark.createDataFrame([], SCHEMA), WIDTH, 3).count() == 0
    same = [(0, [0, 5], [1.0, 1.0, 1.0], i % 2, i) for i in range(6)]
    for local_rows in (0, 10):
        (only,) = exact_tree.grow(spark.createDataFrame(same, SCHEMA), WIDTH, 5, local_rows).collect()
        assert (only.class_0, only.class_1, only.feature) == (3, 3, None)
    for depth in (-1, 61):
        with pytest.raises(ValueError):
            exact_tree.grow(spark.createDataFrame(same, SCHEMA), WIDTH, depth)


SPEC = FeatureSpec(("c",), ("x",), ("b",), "y")


@pytest.fixture(scope="module")
def frame(spark):
    r = random.Random(8)
    rows = []
    for i in range(500):
        c, x, b = r.choice("uvw"), round(r.uniform(-2, 2), 2), r.randrange(2)
        rows.append((i, c, x, b, int((x > 0.5 or c == "u") ^ (b == 1 and x < -1) ^ (r.random() < 0.1))))
    return spark.createDataFrame(rows, "row_idx long, c string, x double, b int, y int").cache()


def test_walking_and_joining_give_the_same_answers(frame):
    model = fit(learner("exact_tree", max_depth=7), frame, SPEC)
    joined = replace(model.model, held_nodes=0)
    encoded = model.encoding.transform(frame.withColumn("c", F.when(F.col("row_idx") % 9 > 0, F.col("c"))))
    a, b = (m.transform(encoded).select("row_idx", "prediction", "p1", "score").orderBy("row_idx").collect() for m in (model.model, joined))
    assert a == b and len(a) == 500
    scored = model.transform(frame)
    assert scored.agg(F.avg((F.col("label") == F.col("prediction")).cast("int"))).first()[0] > 0.85


def test_cut_trees_are_trees_of_that_depth(frame):
    dealt = folds.stratified_fold_column(frame, "y", 3, 0)
    cuts = folds.folds_of_column(3)
    key = lambda r: (r.params["max_depth"], r.fold, r.split, r.metric)
    swept = {key(r): r.value for r in experiment.depth_sweep(dealt, cuts, [0, 1, 3, 9], SPEC, ("accuracy", "recall")).collect()}
    fitted = experiment.grid_search(
        dealt, cuts, lambda **s: learner("exact_tree", **s), experiment.grid(max_depth=[0, 1, 3, 9]), SPEC, ("accuracy", "recall")
    )
    assert swept == {key(r): r.value for r in fitted.collect()} and len(swept) == 4 * 3 * 2 * 2
    distributed = experiment.depth_sweep(dealt, cuts, [0, 1, 3, 9], SPEC, ("accuracy", "recall"), local_rows=0)
    assert {key(r): r.value for r in distributed.collect()} == swept
    assert len(experiment.VALIDATION_RANGES["exact_tree"][1]) == 50


def test_rows_carry_the_slices_of_their_numbers(spark):
    """Slices follow the place of a value among all columns' distinct ones, so levels need no table of all values."""
    rng = np.random.default_rng(8)
    numbers = np.column_stack([rng.integers(-40, 40, 300) / 2, rng.integers(0, 2, 300)]).astype(float)
    rows = spark.createDataFrame([(i, n) for i, n in enumerate(numbers.tolist())], "id long, numbers array<double>")
    ranks = [np.unique(numbers[:, j], return_inverse=True)[1] for j in range(2)]
    n = int(ranks[0].max()) + 1
    for r in exact_tree._sliced(rows, 4).collect():
        assert r.slices == [ranks[0][r.id] // 4 + 1, (n + ranks[1][r.id]) // 4 - n // 4 + 1]


@pytest.mark.parametrize("local_rows", [0, 60, 10_000])
def test_test_rows_walk_down_and_shape_no_tree(spark, local_rows):
    rows = _rows(5, 260)
    # A tree of test rows alone has no nodes.
    marked = [(*r, r[4] % 3 > 0) for r in rows] + [(7, *rows[0][1:], False)]
    nodes = exact_tree.grow(spark.createDataFrame(marked, f"{SCHEMA}, _fits boolean"), WIDTH, 5, local_rows, slice_values=4).collect()
    trained = _plain([r[:5] for r in marked if r[5]], 5)
    assert {(n.tree, n.node): (n.depth, n.class_0, n.class_1, n.feature, n.threshold) for n in nodes} == trained
    seen = {(n.tree, n.node): [0, 0] for n in nodes}
    for tree, hot, numbers, label, _, fits in marked:
        node = 1
        while not fits and (tree, node) in trained:
            seen[tree, node][label] += 1
            feature, threshold = trained[tree, node][3:]
            if feature is None:
                break
            node = 2 * node + int((float(feature in hot) if feature < WIDTH else numbers[feature - WIDTH]) > threshold)
    assert {(n.tree, n.node): [n.test_0, n.test_1] for n in nodes} == seen


def test_a_depth_sweep_holds_no_tree_on_the_driver(frame, monkeypatch):
    monkeypatch.setattr(exact_tree.Walk, "of", lambda *a: pytest.fail("nodes were collected"))
    dealt = folds.stratified_fold_column(frame, "y", 3, 0)
    assert experiment.depth_sweep(dealt, folds.folds_of_column(3), [1, 4], SPEC).count() == 2 * 3 * 2
