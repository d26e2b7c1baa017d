"""Cross-validation, hold-out tests and sweeps over learners.

Each fit is a set of Spark jobs; folds and settings run side by side from a few
driver threads. Results come back as one row per (setting, fold, split, metric).
"""

from __future__ import annotations

import itertools
import time
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from readsift.config import Experiment, FeatureSpec
from readsift.learners.base import Fitted, Learner, fit, fit_encoded, labelled, scored_columns
from readsift.learners.calibration import fit_calibrated
from readsift.learners.exact_tree import cut_counts, grow, tree_rows
from readsift.operators import folds as fold_ops, metrics as metric_ops
from readsift.operators.folds import INDEX, Fold
from readsift.operators.encode import Categories, Encoding, fit_encoding, fit_encodings, known_categories
from readsift.operators.rank import seeded_ranks
from readsift.plans.features import align_to
from readsift.session import in_threads, stage

RESULT_SCHEMA = (
    "classifier string, params map<string,string>, size bigint, fold int, split string, "
    "metric string, value double, fit_seconds double, setting int"
)


def _fold_rows(
    df: DataFrame, fold: Fold, learner: Learner, spec: FeatureSpec, metrics, train_scores, vocabulary_from, params, size, setting=0
) -> list[tuple]:
    began = time.monotonic()
    fitted = fit(learner, df.where(fold.train), spec, vocabulary_from)
    seconds = time.monotonic() - began
    role = F.when(fold.train, "train").when(fold.test, "test")
    wanted = df.withColumn("split", role).where(
        F.col("split").isNotNull() if train_scores else F.col("split") == "test"
    )
    # Train and test rows are scored in one pass over both.
    found = metric_ops.scores(fitted.transform(wanted), metrics, ["split"]).collect()
    text = {k: str(v) for k, v in params.items()}
    return [
        (learner.name, text, size, fold.number, row["split"], m, float(row[m]), seconds, setting) for row in found for m in metrics
    ]


def _run(tasks: list[Callable[[], list[tuple]]], spark, parallelism: int) -> DataFrame:
    rows = [row for part in in_threads(tasks, spark, parallelism) for row in part]
    return spark.createDataFrame(rows, RESULT_SCHEMA)


def cross_validate(
    df: DataFrame,
    folds: Sequence[Fold],
    learner: Learner,
    spec: FeatureSpec,
    metrics: Sequence[str] = ("accuracy",),
    train_scores: bool = True,
    vocabulary_from: DataFrame | Categories | None = None,
    parallelism: int = 4,
) -> DataFrame:
    """Scores of one learner on every fold."""
    vocabulary_from = known_categories(vocabulary_from, spec)
    tasks = [
        lambda f=f: _fold_rows(df, f, learner, spec, metrics, train_scores, vocabulary_from, {}, None) for f in folds
    ]
    return _run(tasks, df.sparkSession, parallelism)


@dataclass(frozen=True)
class PrefixPart:
    """Train on the rows before ``stop``, test on those from ``start`` to ``end``; ``size`` and ``fold`` are labels."""

    size: int | None
    fold: int
    stop: int
    start: int
    end: int


def expanding_parts(n: int, folds: int, size: int | None = None) -> list[PrefixPart]:
    return [PrefixPart(size, fold, stop, stop, end) for fold, stop, end in fold_ops.expanding_bounds(n, folds)]


def _fits_prefixes(learner: Learner) -> bool:
    return hasattr(learner, "prefix_counters") or hasattr(learner, "prefix_scorers")


def prefix_validate(
    df: DataFrame,
    parts: Sequence[PrefixPart],
    learner: Learner,
    spec: FeatureSpec,
    metrics: Sequence[str] = ("accuracy",),
    train_scores: bool = True,
    vocabulary_from: DataFrame | Categories | None = None,
    index: str = INDEX,
    encoding: Encoding | None = None,
) -> DataFrame:
    """Scores of a learner trained on prefixes of the order of ``index``.

    The learner has ``prefix_counters`` or ``prefix_scorers``: all prefixes are fitted from one pass of sums per window
    between two stops, and a row is scored for all its parts in one pass a group of them; counters give counts per part,
    split, label and prediction, scorers a row for every part that a row is in. Scores are those of a fit per part; ``fit_seconds``
    is a part's share. A part whose train rows are none is left out. Categories are those of ``vocabulary_from``, or
    of all rows: a value that a prefix lacks has no weight there either way.
    With ``encoding`` the rows of ``df`` are encoded by it already.
    """
    encoded = df
    if encoding is None:
        encoding = fit_encoding(df, spec, known_categories(vocabulary_from if vocabulary_from is not None else df, spec))
        encoded = labelled(encoding.transform(df), spec)
    stops, began, rows = sorted({p.stop for p in parts}), time.monotonic(), []

    def note(mine: list[PrefixPart], scored: DataFrame) -> None:
        for r in scored.collect():
            part = mine[r["part"]]
            rows.extend((learner.name, {}, part.size, part.fold, r["split"], m, float(r[m]), 0.0, 0) for m in metrics)

    counts = hasattr(learner, "prefix_counters")
    for group, score in (learner.prefix_counters if counts else learner.prefix_scorers)(encoded, encoding, stops, index):
        mine = [p for p in parts if p.stop in group]
        if counts:
            near = encoded.where(F.col(index) < max(p.end for p in mine))
            cells = score(near, [(group.index(p.stop), p.stop, p.start, p.end) for p in mine])
            note(mine, metric_ops.scores(cells if train_scores else cells.where("split = 'test'"), metrics, ["part", "split"], "n"))
            continue
        constants = {k: F.array(*[F.lit(getattr(p, k)) for p in mine]) for k in ("stop", "start", "end")}
        constants["at"] = F.array(*[F.lit(group.index(p.stop)) for p in mine])

        def role(i, constants=constants):
            at, bound = F.col(index), {k: F.get(constants[k], i) for k in ("stop", "start", "end")}
            tested = (at >= bound["start"]) & (at < bound["end"])
            return F.struct(i.alias("part"), F.when(at < bound["stop"], "train").when(tested, "test").alias("split"))

        roles = F.filter(F.transform(F.sequence(F.lit(0), F.lit(len(mine) - 1)), lambda i: role(i)), lambda r: r["split"].isNotNull())
        if not train_scores:
            roles = F.filter(roles, lambda r: r["split"] == "test")
        dealt = encoded.where(F.col(index) < max(p.end for p in mine)).withColumn("_role", F.explode(roles))
        scored = score(dealt.select("*", "_role.part", "_role.split").withColumn("_at", F.get(constants["at"], F.col("part"))))
        note(mine, metric_ops.scores(scored, metrics, ["part", "split"]))
    share = (time.monotonic() - began) / max(len(parts), 1)
    return df.sparkSession.createDataFrame([(*r[:7], share, r[8]) for r in rows], RESULT_SCHEMA)


def summary(results: DataFrame, by: Sequence[str] = ("classifier", "params", "split", "metric")) -> DataFrame:
    """Mean and population deviation over folds. A map column groups by its text."""
    shown = results.withColumn("params", F.to_json("params")) if "params" in by else results
    return metric_ops.mean_and_deviation(shown, list(by))


def out_of_fold(
    df: DataFrame,
    folds: Sequence[Fold],
    learner: Learner,
    spec: FeatureSpec,
    vocabulary_from: DataFrame | Categories | None = None,
    index: str = INDEX,
    parallelism: int = 4,
) -> DataFrame:
    """Every row predicted once, by the model of the fold that tests it.

    Time-ordered folds leave rows untested, so they are refused.
    """
    tested = sum((F.when(f.test, 1).otherwise(0) for f in folds), F.lit(0))
    if df.where(tested != 1).take(1):
        raise ValueError("pooled predictions need folds that test every row exactly once")
    encodings = fit_encodings(df, [f.train for f in folds], spec, vocabulary_from)

    def one(f: Fold, encoding: Encoding) -> DataFrame:
        scored = fit_encoded(learner, df.where(f.train), encoding).transform(df.where(f.test))
        return scored_columns(scored.withColumn("fold", F.lit(f.number)), index, "fold")

    tasks = [lambda f=f, e=e: one(f, e) for f, e in zip(folds, encodings)]
    return reduce(DataFrame.unionByName, in_threads(tasks, df.sparkSession, parallelism))


def holdout(df: DataFrame, n: int, experiment: Experiment, index: str = INDEX) -> tuple[DataFrame, DataFrame]:
    """Train and test rows: by position for time series, else stratified."""
    if experiment.time_series:
        marked = fold_ops.ordered_holdout(df, n, experiment.train_share, index)
    else:
        marked = fold_ops.stratified_holdout(df, experiment.spec.label, experiment.train_share, experiment.seed, index)
    return marked.where(F.col("role") == "train").drop("role"), marked.where(F.col("role") == "test").drop("role")


def holdout_test(
    train: DataFrame, test: DataFrame, learner: Learner, spec: FeatureSpec, vocabulary_from: DataFrame | Categories | None = None
) -> tuple[Fitted, DataFrame]:
    """Fit on train; return the model and the scored test rows."""
    fitted = fit(learner, train, spec, vocabulary_from)
    return fitted, fitted.transform(test)


def cross_dataset_test(
    train: DataFrame, other: DataFrame, learner: Learner, spec: FeatureSpec, extra: Sequence[str] = (INDEX,)
) -> DataFrame:
    """Train on one utility, score another, cut to the columns the model knows."""
    fitted = fit(learner, train, spec)
    return fitted.transform(align_to(other, [*extra, *spec.features, spec.label]))


def calibration_test(
    train: DataFrame,
    test: DataFrame,
    learner: Learner,
    folds: Sequence[Fold],
    spec: FeatureSpec,
    method: str = "isotonic",
    vocabulary_from: DataFrame | Categories | None = None,
) -> DataFrame:
    """Test rows scored by the plain and the calibrated model, told apart by ``model``."""
    vocabulary_from = known_categories(vocabulary_from, spec)
    plain = fit(learner, train, spec, vocabulary_from).transform(test)
    calibrated = fit_calibrated(learner, train, list(folds), spec, method, vocabulary_from).transform(test)
    return scored_columns(plain.withColumn("model", F.lit(f"Uncalibrated {learner.name}")), "model").unionByName(
        scored_columns(calibrated.withColumn("model", F.lit(f"Calibrated {learner.name}")), "model")
    )


def grid(**choices: Iterable) -> list[dict]:
    """All combinations of the given parameter values, as a list to iterate freely."""
    names = list(choices)
    return [dict(zip(names, values)) for values in itertools.product(*(list(choices[n]) for n in names))]


# Parameter ranges declared per learner. The tree of pyspark.ml ends at depth 30,
# and a logistic penalty of c = 0 does not exist.
TUNING_GRIDS = {
    "neighbours": grid(k=[5]),
    "tree": grid(max_depth=range(1, 21)),
    "exact_tree": grid(max_depth=range(1, 21)),
    "logit": grid(c=[1.0]),
    "perceptron": grid(
        penalty=["l1", "l2"],
        alpha=[0.005 * i for i in range(20)],
        max_rounds=range(500, 10000, 500),
        eta=[0.01, 0.1, 1.0],
        tolerance=[1e-3, None],
        patience=[5, 10],
    ),
}
VALIDATION_RANGES = {
    "neighbours": ("k", list(range(1, 11))),
    "tree": ("max_depth", list(range(1, 31))),
    "exact_tree": ("max_depth", list(range(1, 51))),
    "perceptron": ("max_rounds", list(range(500, 10000, 500))),
    "logit": ("c", [0.1 * i for i in range(1, 11)]),
}


def grid_search(
    df: DataFrame,
    folds: Sequence[Fold],
    make: Callable[..., Learner],
    settings: Sequence[dict],
    spec: FeatureSpec,
    metrics: Sequence[str] = ("accuracy",),
    train_scores: bool = True,
    vocabulary_from: DataFrame | Categories | None = None,
    parallelism: int = 4,
) -> DataFrame:
    """Scores of every setting on every fold."""
    vocabulary_from = known_categories(vocabulary_from, spec)
    tasks = [
        lambda i=i, s=s, f=f: _fold_rows(df, f, make(**s), spec, metrics, train_scores, vocabulary_from, s, None, i)
        for i, s in enumerate(settings)
        for f in folds
    ]
    return _run(tasks, df.sparkSession, parallelism)


def best_settings(results: DataFrame) -> DataFrame:
    """Per classifier and metric the setting with the best mean test score; of equals the first in grid order."""
    tested = results.where(F.col("split") == "test")
    first = tested.groupBy(F.to_json("params").alias("params")).agg(F.min("setting").alias("setting"))
    ranked = summary(tested).join(first, "params")
    return ranked.groupBy("classifier", "metric").agg(
        F.max_by("params", F.struct("mean", -F.col("setting"))).alias("params"), F.max("mean").alias("mean")
    )


def validation_curve(df, folds, make, parameter: str, values, spec, **options) -> DataFrame:
    """A sweep of one parameter."""
    return grid_search(df, folds, make, grid(**{parameter: values}), spec, **options)


def depth_sweep(
    df: DataFrame,
    folds: Sequence[Fold],
    depths: Sequence[int],
    spec: FeatureSpec,
    metrics: Sequence[str] = ("accuracy",),
    train_scores: bool = True,
    vocabulary_from: DataFrame | Categories | None = None,
    local_rows: int | None = None,
) -> DataFrame:
    """Scores of exact trees of every depth on every fold, as :func:`grid_search` gives them.

    One tree a fold is grown, all folds' trees together, and cut at every depth; test rows walk down while it grows, so scores are
    sums over nodes. ``fit_seconds`` is a fold's share of the growing.
    """
    known = known_categories(vocabulary_from if vocabulary_from is not None else df, spec)
    encoding, depths = fit_encoding(df, spec, known), list(depths)
    parts = [F.struct(F.lit(f.number).alias("tree"), F.when(f.train, "train").when(f.test, "test").alias("split")) for f in folds]
    mine = labelled(tree_rows(encoding.transform(df), spec), spec).withColumn("_part", F.explode(F.filter(F.array(*parts), lambda p: p["split"].isNotNull())))
    rows = mine.select("_part.*", "hot", "numbers", "label").withColumn("_fits", F.col("split") == "train")
    began = time.monotonic()
    options = {} if local_rows is None else {"local_rows": local_rows}
    nodes = grow(rows, encoding.width_hot, max(depths), **options)
    seconds = (time.monotonic() - began) / max(len(folds), 1)
    cells = cut_counts(nodes, depths)
    found = metric_ops.scores(cells if train_scores else cells.where("split = 'test'"), metrics, ["tree", "split", "depth"], "n").collect()
    made = [
        ("exact_tree", {"max_depth": str(r["depth"])}, None, r["tree"], r["split"], m, float(r[m]), seconds, depths.index(r["depth"]))
        for r in found for m in metrics
    ]
    return df.sparkSession.createDataFrame(made, RESULT_SCHEMA)


def learning_curve(
    df: DataFrame,
    folds: Sequence[Fold],
    learner: Learner,
    fractions: Sequence[float],
    spec: FeatureSpec,
    metrics: Sequence[str] = ("accuracy",),
    seed: int = 0,
    vocabulary_from: DataFrame | Categories | None = None,
    index: str = INDEX,
    parallelism: int = 4,
) -> DataFrame:
    """Scores after training on growing shares of each fold's train rows, taken in
    seeded random order; ``size`` is the number of rows trained on. All folds use the sizes
    that the smallest one allows, so a size's mean is over every fold. A learner that can fit all prefixes together
    does so, fold by fold."""
    vocabulary_from = known_categories(vocabulary_from, spec)
    tasks = []
    trained = [r or 0 for r in df.agg(*[F.count_if(f.train) for f in folds]).first()]
    n = min(trained)
    sizes = sorted({max(1, int(share * n)) for share in fractions})
    if _fits_prefixes(learner):
        known = vocabulary_from if vocabulary_from is not None else known_categories(df, spec)
        rows, encoding = df, None
        if hasattr(learner, "prefix_counters"):
            # Counters read slots and unscaled numbers, which are the same in every fold: rows are encoded once.
            encoding = fit_encoding(df, spec, known)
            rows = labelled(encoding.transform(df), spec).drop("features", "numbers")
        # One order for all folds, in which each has its own ranks.
        rows = stage(seeded_ranks(rows, index, seed, [f.train for f in folds], "_ranks"), "curve-rows")

        def one(i: int, f: Fold, behind: int) -> DataFrame:
            # Test rows stand behind all train rows, at one place.
            ordered = rows.where(f.train | f.test).withColumn("_rank", F.coalesce(F.get("_ranks", F.lit(i)), F.lit(behind))).drop("_ranks")
            parts = [PrefixPart(size, f.number, size, behind, behind + 1) for size in sizes]
            return prefix_validate(ordered, parts, learner, spec, metrics, True, known, "_rank", encoding)

        tasks = [lambda i=i, f=f, k=k: one(i, f, k) for i, (f, k) in enumerate(zip(folds, trained))]
        return reduce(DataFrame.unionByName, in_threads(tasks, df.sparkSession, parallelism))
    # Read by every size of every fold, so the ranks are made once.
    ranked = stage(seeded_ranks(df, index, seed, [f.train for f in folds], "_ranks"), "curve-rows")
    for i, f in enumerate(folds):
        shuffled = ranked.withColumn("_rank", F.get("_ranks", F.lit(i))).drop("_ranks")
        for size in sizes:
            part = Fold(f.number, F.col("_rank") < size, f.test)
            tasks.append(
                lambda p=part, s=size, d=shuffled: _fold_rows(
                    d, p, learner, spec, metrics, True, vocabulary_from, {}, s
                )
            )
    return _run(tasks, df.sparkSession, parallelism)


def expanding_learning_curve(
    df: DataFrame,
    sizes: Sequence[int],
    folds: int,
    learner: Learner,
    spec: FeatureSpec,
    metrics: Sequence[str] = ("accuracy",),
    vocabulary_from: DataFrame | Categories | None = None,
    index: str = INDEX,
    parallelism: int = 4,
) -> DataFrame:
    """Expanding-window validation on growing prefixes; a size of s takes s + 1 rows.

    A learner that can fit all prefixes together does so (:func:`prefix_validate`), others are fitted once a part."""
    if _fits_prefixes(learner):
        parts = [p for size in sizes for p in expanding_parts(size + 1, folds, size)]
        return prefix_validate(df, parts, learner, spec, metrics, True, vocabulary_from, index)
    vocabulary_from = known_categories(vocabulary_from, spec)
    tasks = []
    for size in sizes:
        prefix = df.where(F.col(index) <= size)
        for f in fold_ops.expanding_folds(size + 1, folds, index):
            tasks.append(
                lambda p=prefix, f=f, s=size: _fold_rows(p, f, learner, spec, metrics, True, vocabulary_from, {}, s)
            )
    return _run(tasks, df.sparkSession, parallelism)


def curve_summary(results: DataFrame) -> DataFrame:
    """Mean and deviation of scores and fit times by size and split."""
    return results.groupBy("classifier", "size", "split", "metric").agg(
        F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"),
        F.avg("fit_seconds").alias("fit_mean"), F.stddev_pop("fit_seconds").alias("fit_std"),
    )
