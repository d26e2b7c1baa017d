"""Gini trees with exact splits, grown level by level, many trees at once.

Rows carry the tree they train and the node they have reached. A level finds the best split of every open node over all
slots and all midpoints between neighbouring values: counts per (node, slot) or per (node, column, value) are combined
before the shuffle, and running counts along a column go through slices of its sorted distinct values, so no window
holds more than a slice. A node of few rows is finished by the one task that its rows are sent to, with the same
arithmetic and the same order among equal splits, so where that happens changes no tree.

Splits are by falling ``(l0^2 + l1^2) / l + (r0^2 + r1^2) / r``, then by feature, then by threshold. Nodes are numbered
as in a heap, from 1; a row goes right where its value exceeds the threshold. Numbers are taken unscaled: scaling
changes no order, and thresholds then stay in the units of their columns whatever the training rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from readsift.config import FeatureSpec
from readsift.learners.simple import DummyModel, class_counts
from readsift.operators.encode import raw_numbers
from readsift.operators.rank import row_index
from readsift.session import stage

#: Heap numbers of nodes must fit a bigint.
DEEPEST = 60
#: A node of at most this many rows is finished by one task: some 400 bytes a row.
LOCAL_ROWS = 50_000
#: Distinct values of a column that one window sorts.
SLICE_VALUES = 4096
#: A tree of at most this many nodes is walked as a constant, a larger one by a join per level.
HELD_NODES = 100_000

NODE_SCHEMA = "tree int, node bigint, depth int, class_0 bigint, class_1 bigint, feature int, threshold double"
#: Class counts of rows that only walk down the tree, beside those of the rows that it is grown on.
_TESTED = "test_0 bigint, test_1 bigint"
_SPLIT = ["tree", "node"]


def _score(left: Column, left_1: Column, right: Column, right_1: Column) -> Column:
    """Falling with the gini impurity that a split leaves."""
    l1, r1 = left_1.cast("double"), right_1.cast("double")
    l0, r0 = left.cast("double") - l1, right.cast("double") - r1
    return (l0 * l0 + l1 * l1) / left + (r0 * r0 + r1 * r1) / right


def _middle(low: Column, high: Column) -> Column:
    """Between two neighbouring values; the lower one if nothing is."""
    half = (low + high) / 2
    return F.when(half >= high, low).otherwise(half)


def _slot_candidates(rows: DataFrame, totals: DataFrame, width_hot: int) -> DataFrame:
    active = rows.select(*_SPLIT, "label", F.explode("hot").alias("feature")).where(F.col("feature") < width_hot)
    right = active.groupBy(*_SPLIT, "feature").agg(F.count(F.lit(1)).alias("r"), F.sum("label").alias("r1"))
    l, l1 = F.col("n") - F.col("r"), F.col("ones") - F.col("r1")  # noqa: E741
    return right.join(totals, _SPLIT).where(F.col("r") < F.col("n")).select(
        *_SPLIT, "feature", F.lit(0.5).alias("threshold"), _score(l, l1, F.col("r"), F.col("r1")).alias("score")
    )


def _number_candidates(rows: DataFrame, totals: DataFrame, width_hot: int) -> DataFrame:
    """Every midpoint of every number column; running counts slice by slice, then inside each."""
    cells = rows.select(*_SPLIT, "label", F.posexplode(F.arrays_zip("numbers", "slices")).alias("j", "_cell"))
    placed = cells.groupBy(*_SPLIT, "j", F.col("_cell.slices").alias("slice"), F.col("_cell.numbers").alias("value")).agg(
        F.count(F.lit(1)).alias("k"), F.sum("label").alias("k1")
    )
    column = [*_SPLIT, "j"]
    along = Window.partitionBy(*column).orderBy("slice")
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    whole = placed.groupBy(*column, "slice").agg(F.sum("k").alias("s"), F.sum("k1").alias("s1"), F.min("value").alias("first"))
    starts = whole.select(
        *column, "slice", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("before"),
        F.coalesce(F.sum("s1").over(before), F.lit(0)).alias("before_1"), F.lead("first").over(along).alias("after"),
    )
    inside = Window.partitionBy(*column, "slice").orderBy("value")
    running = inside.rowsBetween(Window.unboundedPreceding, 0)
    l, l1 = F.col("before") + F.sum("k").over(running), F.col("before_1") + F.sum("k1").over(running)  # noqa: E741
    sides = placed.join(starts, [*column, "slice"]).select(
        *column, "value", F.coalesce(F.lead("value").over(inside), "after").alias("next"), l.alias("l"), l1.alias("l1")
    )
    r, r1 = F.col("n") - F.col("l"), F.col("ones") - F.col("l1")
    return sides.where("next IS NOT NULL").join(totals, _SPLIT).select(
        *_SPLIT, (F.col("j") + width_hot).cast("int").alias("feature"), _middle(F.col("value"), F.col("next")).alias("threshold"),
        _score(F.col("l"), F.col("l1"), r, r1).alias("score"),
    )


def _sliced(rows: DataFrame, slice_values: int) -> DataFrame:
    """``rows`` with the slice of each of its numbers: so many distinct values of a column, in order, make one.

    The first values of the slices go to the tasks, so a row finds its slices without a join, and once.
    """
    distinct = rows.select(F.posexplode("numbers").alias("j", "value")).distinct()
    ordered = row_index(distinct, ["j", "value"], "at").withColumn("slice", F.floor(F.col("at") / slice_values))
    firsts: dict[int, list[float]] = {}
    for row in ordered.groupBy("j", "slice").agg(F.min("value").alias("first")).orderBy("j", "slice").collect():
        firsts.setdefault(row["j"], []).append(row["first"])
    bounds = {j: np.array(found, float) for j, found in firsts.items()}

    @F.pandas_udf("array<int>")
    def slices(numbers: pd.Series) -> pd.Series:
        if not len(numbers):
            return pd.Series([], dtype=object)
        values = np.array(numbers.tolist(), float).reshape(len(numbers), -1)
        places = [np.searchsorted(bounds[j], values[:, j], "right") for j in range(values.shape[1])]
        return pd.Series(list(np.stack(places, axis=1).astype(np.int32))) if places else pd.Series([[]] * len(numbers))

    return stage(rows.withColumn("slices", slices("numbers")), "tree-rows")


def _goes_right(feature: Column, threshold: Column, width_hot: int) -> Column:
    return F.when(feature < width_hot, F.array_contains("hot", feature)).otherwise(F.get("numbers", feature - width_hot) > threshold)


def _best(
    hot: np.ndarray, columns: list[np.ndarray], label: np.ndarray, own: np.ndarray, orders: list[np.ndarray], width_hot: int
) -> tuple[int, float] | None:
    """The best split of the few rows ``own``; ``orders`` are the same rows, by rising values of each number column."""
    n, mine = len(own), label[own]
    ones, flat = mine.sum(), hot[own].ravel()
    known = flat < width_hot
    flat, who = flat[known], np.repeat(mine, hot.shape[1])[known]
    if width_hot <= 4 * len(flat):
        r, r1 = np.bincount(flat, minlength=width_hot).astype(float), np.bincount(flat, who, width_hot)
        slots = np.flatnonzero(r)
        r, r1 = r[slots], r1[slots]
    else:
        slots, at = np.unique(flat, return_inverse=True)
        r, r1 = np.bincount(at, minlength=len(slots)).astype(float), np.bincount(at, who, len(slots))
    inner = r < n
    features, thresholds, lefts, left_ones = [slots[inner]], [np.full(inner.sum(), 0.5)], [n - r[inner]], [ones - r1[inner]]
    for j, order in enumerate(orders):
        value = columns[j][order]
        cut = np.flatnonzero(value[1:] != value[:-1])
        low, high = value[cut], value[cut + 1]
        half = (low + high) / 2
        features.append(np.full(len(cut), width_hot + j))
        thresholds.append(np.where(half >= high, low, half))
        lefts.append(cut + 1.0)
        left_ones.append(np.cumsum(label[order])[cut])
    feature, threshold, l, l1 = map(np.concatenate, (features, thresholds, lefts, left_ones))  # noqa: E741
    if not len(feature):
        return None
    l0, r, r1 = l - l1, n - l, ones - l1
    r0 = r - r1
    # Features and thresholds rise, so the first of equal scores is the one wanted.
    first = int(np.argmax((l0 * l0 + l1 * l1) / l + (r0 * r0 + r1 * r1) / r))
    return int(feature[first]), float(threshold[first])


def _finish(width_hot: int, max_depth: int):
    """All nodes below one node, from its rows."""

    def subtree(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        hot = np.array(rows["hot"].tolist(), np.int64).reshape(len(rows), -1)
        numbers = np.array(rows["numbers"].tolist(), float).reshape(len(rows), -1)
        label, fits = rows["label"].to_numpy(float), rows["_fits"].to_numpy(bool)
        # Columns are sorted once; the two sides of a split keep the order.
        columns = [np.ascontiguousarray(numbers[:, j]) for j in range(numbers.shape[1])]
        train, test = np.flatnonzero(fits), np.flatnonzero(~fits)
        made, waiting = [], [(int(key[1]), train, test, [train[np.argsort(c[train], kind="stable")] for c in columns])]
        while waiting:
            node, own, tested, orders = waiting.pop()
            ones, depth = int(label[own].sum()), node.bit_length() - 1
            split = None
            if 0 < ones < len(own) and depth < max_depth:
                split = _best(hot, columns, label, own, orders, width_hot)
            feature, threshold = split or (None, None)
            answers = label[tested]
            made.append((int(key[0]), node, depth, len(own) - ones, ones, feature, threshold, int((answers == 0).sum()), int((answers == 1).sum())))
            if split:
                right = np.zeros(len(rows), bool)
                for some in (own, tested):
                    right[some] = (hot[some] == feature).any(axis=1) if feature < width_hot else columns[feature - width_hot][some] > threshold
                for child, side in ((2 * node, ~right), (2 * node + 1, right)):
                    waiting.append((child, own[side[own]], tested[side[tested]], [o[side[o]] for o in orders]))
        found = pd.DataFrame(made, columns=["tree", "node", "depth", "class_0", "class_1", "feature", "threshold", "test_0", "test_1"])
        return found.astype({"feature": "Int32", "threshold": "float64"})

    return subtree


def grow(
    rows: DataFrame, width_hot: int, max_depth: int, local_rows: int = LOCAL_ROWS, slice_values: int = SLICE_VALUES
) -> DataFrame:
    """Node table of the trees of (tree, hot, numbers, label): a row per node, staged; leaves have no feature.

    A node is split while it holds both classes, lies above ``max_depth`` and some feature tells its rows apart. Trees
    without rows have no nodes. Rows with a false ``_fits``, if there is that column, shape no tree: they walk down beside the others,
    and nodes count their classes in ``test_0`` and ``test_1``.
    """
    if not 0 <= max_depth <= DEEPEST:
        raise ValueError(f"depth must be from 0 to {DEEPEST}")
    spark, tests = rows.sparkSession, "_fits" in rows.columns
    fits = F.col("_fits") if tests else F.lit(True)
    kept = [*_SPLIT, "depth", "class_0", "class_1", "feature", "threshold", *(["test_0", "test_1"] if tests else [])]
    open_rows = stage(rows.select("tree", "hot", "numbers", F.col("label").cast("bigint").alias("label"), F.lit(1).cast("bigint").alias("node"), fits.alias("_fits")), "tree-rows")
    levels: list[DataFrame] = []
    finished: list[DataFrame] = []
    for depth in range(max_depth + 1):
        own, tested = F.col("_fits"), lambda c: F.count_if(~F.col("_fits") & (F.col("label") == c)).alias(f"test_{c}")
        totals = open_rows.groupBy(*_SPLIT).agg(
            F.count_if(own).alias("n"), F.sum(F.when(own, F.col("label"))).alias("ones"), F.count(F.lit(1)).alias("_rows"), tested(0), tested(1)
        )
        totals = stage(totals.where("n > 0"), "tree-totals")
        if totals.isEmpty():
            break
        small = F.col("_rows") <= local_rows
        finished.append(open_rows.join(totals.where(small).select(*_SPLIT), _SPLIT, "left_semi").drop("slices"))
        large = totals.where(~small)
        if large.isEmpty():
            break
        if "slices" not in open_rows.columns and depth < max_depth:
            open_rows = _sliced(open_rows, slice_values)
        split = stage(_best_splits(open_rows.where("_fits"), large, width_hot), "tree-splits") if depth < max_depth else None
        plain = large.join(split, _SPLIT, "left") if split is not None else large.withColumns({"feature": F.lit(None).cast("int"), "threshold": F.lit(None).cast("double")})
        levels.append(plain.select("tree", "node", F.lit(depth).alias("depth"), (F.col("n") - F.col("ones")).alias("class_0"), F.col("ones").alias("class_1"), "feature", "threshold", "test_0", "test_1"))
        if split is None:
            break
        right = _goes_right(F.col("feature"), F.col("threshold"), width_hot)
        moved = open_rows.join(split, _SPLIT).withColumn("node", 2 * F.col("node") + right.cast("bigint"))
        open_rows = stage(moved.drop("feature", "threshold"), "tree-rows")
    if finished:
        below = reduce(DataFrame.unionByName, finished).select("tree", "node", "hot", "numbers", "label", "_fits")
        levels.append(below.groupBy(*_SPLIT).applyInPandas(_finish(width_hot, max_depth), f"{NODE_SCHEMA}, {_TESTED}"))
    if not levels:
        return spark.createDataFrame([], f"{NODE_SCHEMA}, {_TESTED}").select(*kept)
    return stage(reduce(DataFrame.unionByName, levels).select(*kept), "tree-nodes")


def _best_splits(rows: DataFrame, totals: DataFrame, width_hot: int) -> DataFrame:
    """(tree, node, feature, threshold) of the nodes of ``totals`` that can be split."""
    mixed = totals.where((F.col("ones") > 0) & (F.col("ones") < F.col("n")))
    own = rows.join(mixed.select(*_SPLIT), _SPLIT, "left_semi")
    found = _slot_candidates(own, mixed, width_hot).unionByName(_number_candidates(own, mixed, width_hot))
    order = F.struct("score", -F.col("feature"), -F.col("threshold"))
    best = found.groupBy(*_SPLIT).agg(F.max_by(F.struct("feature", "threshold"), order).alias("best"))
    return best.select(*_SPLIT, "best.*")


@dataclass(frozen=True)
class Walk:
    """Node tables as constants: rows find their way without a join. Each tree's root is at ``roots``."""

    width_hot: int
    nodes: pd.DataFrame
    roots: dict[int, int]

    @classmethod
    def of(cls, nodes: DataFrame, width_hot: int) -> "Walk":
        held = nodes.toPandas().sort_values(_SPLIT).reset_index(drop=True)
        at = {key: i for i, key in enumerate(zip(held["tree"], held["node"]))}
        inner = held["feature"].notna()
        held["left"] = [at[t, 2 * n] if i else -1 for t, n, i in zip(held["tree"], held["node"], inner)]
        held["right"] = [at[t, 2 * n + 1] if i else -1 for t, n, i in zip(held["tree"], held["node"], inner)]
        held["feature"], held["threshold"] = held["feature"].fillna(0).astype(int), held["threshold"].fillna(0.0)
        return cls(width_hot, held, {t: i for (t, n), i in at.items() if n == 1})

    def column(self, name: str, at: Column) -> Column:
        kind = "double" if name == "threshold" else "bigint"
        return F.get(F.from_json(F.lit(json.dumps(self.nodes[name].tolist())), f"array<{kind}>"), at.cast("int"))

    def step(self, at: Column) -> Column:
        """The child that the row goes to; a leaf stays."""
        feature = self.column("feature", at).cast("int")
        right = _goes_right(feature, self.column("threshold", at), self.width_hot)
        child = F.when(right, self.column("right", at)).otherwise(self.column("left", at))
        return F.when(self.column("left", at) < 0, at).otherwise(child)

    def root(self, tree: Column) -> Column:
        found = F.lit(None).cast("bigint")
        for number, at in self.roots.items():
            found = F.when(tree == number, F.lit(at).cast("bigint")).otherwise(found)
        return found

    def leaf(self, tree: Column, depth: int) -> Column:
        if depth == 0:
            return self.root(tree)
        return F.aggregate(F.sequence(F.lit(1), F.lit(depth)), self.root(tree), lambda at, _: self.step(at))


def _answered(df: DataFrame, class_0: Column, class_1: Column) -> DataFrame:
    p1 = class_1 / (class_0 + class_1)
    return df.withColumns({"p1": p1, "score": p1, "prediction": (class_1 > class_0).cast("int")})


@dataclass(frozen=True)
class ExactTreeModel:
    nodes: DataFrame
    spec: FeatureSpec
    width_hot: int
    depth: int
    held_nodes: int = HELD_NODES

    def transform(self, df: DataFrame) -> DataFrame:
        found = self._counted(df.withColumnRenamed("numbers", "_scaled").withColumn("numbers", raw_numbers(self.spec)))
        p1 = F.col("_c1") / (F.col("_c0") + F.col("_c1"))
        scored = found.withColumns({"p1": p1, "score": p1, "prediction": (F.col("_c1") > F.col("_c0")).cast("int")})
        return scored.drop("numbers", "_c0", "_c1").withColumnRenamed("_scaled", "numbers")

    def _counted(self, df: DataFrame) -> DataFrame:
        """``df`` with the class counts of each row's leaf."""
        if self.nodes.count() <= self.held_nodes:
            walk = Walk.of(self.nodes, self.width_hot)
            found, leaf = df.withColumn("_leaf", walk.leaf(F.lit(0), self.depth)), F.col("_leaf")
            return found.withColumns({"_c0": walk.column("class_0", leaf), "_c1": walk.column("class_1", leaf)}).drop("_leaf")
        walked = df.withColumn("_node", F.lit(1).cast("bigint"))
        own = self.nodes.select(F.col("node").alias("_node"), F.col("feature").alias("_feature"), F.col("threshold").alias("_threshold"))
        for _ in range(self.depth):
            right = _goes_right(F.col("_feature"), F.col("_threshold"), self.width_hot).cast("bigint")
            down = F.when(F.col("_feature").isNull(), F.col("_node")).otherwise(2 * F.col("_node") + right)
            walked = walked.join(own, "_node").withColumn("_node", down).drop("_feature", "_threshold")
        counts = self.nodes.select(F.col("node").alias("_node"), F.col("class_0").alias("_c0"), F.col("class_1").alias("_c1"))
        return walked.join(counts, "_node").drop("_node")


def tree_rows(encoded: DataFrame, spec: FeatureSpec) -> DataFrame:
    """Encoded rows with the numbers that trees are grown on."""
    return encoded.withColumn("numbers", raw_numbers(spec))


@dataclass(frozen=True)
class ExactTree:
    """Gini tree over all splits of all features, to any depth up to ``DEEPEST``."""

    max_depth: int = 20
    local_rows: int = LOCAL_ROWS
    name: str = "exact_tree"

    def fit(self, encoded: DataFrame, encoding):
        counts = class_counts(encoded)
        if len(counts) == 1:
            return DummyModel("most_frequent", float(next(iter(counts))), 0, "")
        rows = tree_rows(encoded, encoding.spec).withColumn("tree", F.lit(0))
        nodes = grow(rows, encoding.width_hot, self.max_depth, self.local_rows)
        return ExactTreeModel(nodes, encoding.spec, encoding.width_hot, self.max_depth)


def cut_counts(nodes: DataFrame, depths: list[int]) -> DataFrame:
    """Rows (tree, split, depth, label, prediction, n): what each tree cut at each depth says of its train and test rows,
    from the nodes of :func:`grow` with test rows.

    A split depends on nothing below it, so the tree of depth d is the first d levels of any deeper one, and its leaves
    are the nodes at d and the leaves above. Nodes are summed by their depth first; none of them reaches the driver.
    """
    counts = ["class_0", "class_1", "test_0", "test_1"]
    at = nodes.groupBy(
        "tree", F.col("depth").alias("_at"), F.col("feature").isNull().alias("_leaf"), (F.col("class_1") > F.col("class_0")).cast("int").alias("prediction")
    ).agg(*[F.sum(c).alias(c) for c in counts])
    cut = at.withColumn("depth", F.explode(F.array(*[F.lit(d) for d in depths])))
    cut = cut.where((F.col("_at") == F.col("depth")) | (F.col("_leaf") & (F.col("_at") < F.col("depth"))))
    cells = [
        F.struct(F.lit(split).alias("split"), F.lit(y).alias("label"), F.col(f"{side}_{y}").alias("n"))
        for split, side in (("train", "class"), ("test", "test")) for y in (0, 1)
    ]
    return cut.withColumn("_cell", F.explode(F.array(*cells))).select("tree", "depth", "prediction", "_cell.*").where("n > 0")
