"""A whole experiment: hold-out, folds, and the parts its settings switch on."""

from __future__ import annotations

from functools import partial, reduce

from pyspark.sql import DataFrame

from readsift.config import Experiment
from readsift.learners import fit, learner
from readsift.learners.calibration import CalibratedLearner
from readsift.learners.spark_ml import tree_nodes
from readsift.operators import folds as fold_ops, metrics
from readsift.operators.duplicates import audited_rows, neighbour_audit
from readsift.operators.encode import categories
from readsift.operators.folds import INDEX
from readsift.operators.profile import value_counts
from readsift.operators.rank import row_index
from readsift.plans import experiment as parts
from readsift.session import stage

# Share of the train rows the largest prefix of an expanding learning curve takes.
_LARGEST_PREFIX = 0.9


def curve_sizes(n: int, steps: int, folds: int = 0) -> list[int]:
    """Prefix sizes of the expanding learning curve: equal steps up to nine tenths. Prefixes too short for that many
    ``folds`` are left out."""
    return [size for i in range(1, steps + 1) if (size := int(_LARGEST_PREFIX * n * i / steps)) >= folds]


def curve_fractions(settings: Experiment) -> list[float]:
    """Train shares of the other learning curves; shuffled ones stop short of all rows."""
    steps = settings.curve_steps
    return [i / steps for i in range(1, steps + 1 if settings.time_series else steps)]


def run_experiment(
    df: DataFrame,
    settings: Experiment,
    name: str,
    params: dict | None = None,
    other: DataFrame | None = None,
    parallelism: int = 4,
) -> dict[str, DataFrame]:
    """Result tables by part, for learner ``name`` on an indexed frame.

    ``other`` is a second data set to score with a model trained on all of ``df``.
    """
    spec, make = settings.spec, partial(learner, name)
    chosen = make(**(params or {}))
    known = categories(df, spec)
    n = df.count()
    train, test = parts.holdout(df, n, settings)
    if not settings.time_series:
        # The drawn train rows get positions of their own.
        train = row_index(train.withColumnRenamed(INDEX, "_drawn"), ["_drawn"]).drop("_drawn")
    if settings.shuffle_targets:
        train = fold_ops.permute_labels(train, spec.label, settings.seed)
        if other is not None:
            df = fold_ops.permute_labels(df, spec.label, settings.seed)
    size = fold_ops.ordered_train_size(n, settings.train_share)
    dealt, cuts = fold_ops.fold_scheme(train, size, settings, spec.label)
    train = stage(dealt, "experiment-train")
    options = {"vocabulary_from": known, "parallelism": parallelism}

    out = {"targets": value_counts(train, [spec.label])}
    if settings.do_tuning:
        # The same learners whichever one the experiment is about.
        unknown = [t for t in settings.tuned if t not in parts.TUNING_GRIDS]
        if unknown:
            raise ValueError(f"no grid is declared for {', '.join(unknown)}")
        found = reduce(DataFrame.unionByName, [
            parts.grid_search(
                train, cuts, partial(learner, t), parts.TUNING_GRIDS[t], spec, settings.metrics, settings.train_scores, **options
            )
            for t in settings.tuned
        ])
        out["tuning"] = parts.summary(found)
        out["best"] = parts.best_settings(found)
    if settings.do_learning_analysis:
        fitted = fit(chosen, train, spec, known)
        if name == "tree":
            out["tree_nodes"] = tree_nodes(df.sparkSession, fitted.model)
        audit = neighbour_audit(fitted.encoding.transform(train), size, fitted.encoding.width_hot, seed=settings.seed)
        out["neighbour_audit"] = audited_rows(stage(audit, "audit"), train.select(INDEX, *spec.features, spec.label))
    if settings.do_learning_curve:
        if settings.time_series and settings.expanding:
            curve = parts.expanding_learning_curve(
                train, curve_sizes(size, settings.curve_steps), settings.folds, chosen, spec, settings.metrics, **options
            )
        else:
            curve = parts.learning_curve(
                train, cuts, chosen, curve_fractions(settings), spec, settings.metrics, settings.seed, **options
            )
        out["learning_curve"] = parts.curve_summary(curve)
    if settings.do_validation_curve:
        if name not in parts.VALIDATION_RANGES:
            raise ValueError(f"no parameter range is declared for {name}")
        parameter, values = parts.VALIDATION_RANGES[name]
        out["validation_curve"] = parts.summary(
            parts.validation_curve(train, cuts, make, parameter, values, spec, metrics=settings.metrics, **options)
        )
    if settings.do_calibration:
        inner_train, inner_test = parts.holdout(train, size, settings)
        inner_size = fold_ops.ordered_train_size(size, settings.train_share)
        if not settings.time_series:
            inner_train = inner_train.drop(*[c for c in inner_train.columns if c.startswith("fold")])
        inner_train, inner_cuts = fold_ops.fold_scheme(inner_train, inner_size, settings, spec.label)
        scored = stage(
            parts.calibration_test(
                stage(inner_train, "calibration-train"), inner_test, chosen, inner_cuts, spec,
                settings.calibration_method, known,
            ),
            "calibration-scores",
        )
        out["calibration"] = metrics.compare_models(scored)
        out["calibration_curve"] = metrics.calibration_curve(scored, settings.calibration_bins, ["model"])
        out["calibration_histogram"] = metrics.probability_histogram(scored, settings.calibration_bins, ["model"])
    if settings.do_cross_validation:
        out["cross_validation"] = parts.summary(
            parts.cross_validate(train, cuts, chosen, spec, settings.metrics, settings.train_scores, **options)
        )
    if settings.do_calibrated_validation:
        calibrated = CalibratedLearner(chosen, settings.folds, settings.calibration_method, settings.seed)
        out["calibrated_validation"] = parts.summary(
            parts.cross_validate(train, cuts, calibrated, spec, settings.metrics, settings.train_scores, **options)
        )
    if settings.do_pooled_confusion:
        pooled = stage(parts.out_of_fold(train, cuts, chosen, spec, **options), "pooled")
        out["pooled_predictions"] = metrics.prediction_counts(pooled)
        out["pooled_confusion"] = metrics.confusion(pooled)
    if other is not None:
        crossed = stage(parts.cross_dataset_test(df, other, chosen, spec), "crossed")
        out["cross_scores"] = metrics.scores(crossed, settings.metrics)
        out["cross_confusion"] = metrics.confusion(crossed)
    if settings.do_test_set:
        _, scored = parts.holdout_test(train, test, chosen, spec, known)
        scored = stage(scored.select("label", "prediction"), "tested")
        out["test_scores"] = metrics.scores(scored, settings.metrics)
        out["test_confusion"] = metrics.confusion(scored)
    return out
