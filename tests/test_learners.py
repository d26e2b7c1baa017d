import math
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from readsift.config import Experiment, FeatureSpec
from readsift.learners import fit, learner
from readsift.learners.calibration import fit_calibrated, fit_isotonic, fit_sigmoid
from readsift.learners.spark_ml import tree_nodes
from readsift.operators import folds, metrics
from readsift.plans import experiment, run

SPEC = FeatureSpec(("c",), ("x", "z"), ("b",), "y")


@pytest.fixture(scope="module")
def separable(spark):
    """Label follows x, with a margin; c and b carry some of it, z none."""
    rows = []
    for i in range(600):
        y = i % 2
        x = (1.5 if y else -1.5) + math.sin(i * 12.9898) * 0.9
        rows.append((i, "hi" if x > 1 else ("lo" if x < -1 else "mid"), x, math.cos(i * 78.233), int(i % 5 == 0), y))
    return spark.createDataFrame(rows, "row_idx long, c string, x double, z double, b int, y int").cache()


@pytest.mark.parametrize(
    "name", ["tree", "logit", "bayes", "neighbours", "network", "perceptron", "passive_aggressive", "linear_svm"]
)
def test_learners_separate_what_is_separable(separable, name):
    params = {"max_iter": 40, "hidden": 8} if name == "network" else {}
    train, test = experiment.holdout(separable, 600, Experiment(spec=SPEC))
    fitted, scored = experiment.holdout_test(train, test, learner(name, **params), SPEC)
    assert scored.count() == 120
    assert metrics.scores(scored).first()["accuracy"] >= 0.95
    assert scored.where(F.col("score").isNull()).count() == 0


def test_unknown_learner_and_bad_parameters(separable):
    with pytest.raises(ValueError):
        learner("oracle")
    for name, params in (("logit", {"c": 0.0}), ("tree", {"max_depth": 31}), ("dummy", {"strategy": "loud"})):
        with pytest.raises(ValueError):
            fit(learner(name, **params), separable, SPEC)


def test_dummy_follows_the_class_share(separable):
    thin = separable.where((F.col("y") == 0) | (F.col("row_idx") % 3 == 0))
    drawn = fit(learner("dummy"), thin, SPEC).transform(thin)
    share, drawn_share = drawn.agg(F.avg("label"), F.avg("prediction")).first()
    assert abs(share - drawn_share) < 0.1
    constant = fit(learner("dummy", strategy="most_frequent"), thin, SPEC).transform(thin)
    assert constant.agg(F.max("prediction")).first()[0] == 0


def test_bayes_equals_a_dense_computation(separable):
    fitted = fit(learner("bayes"), separable, SPEC)
    rows = fitted.transform(separable).select("hot", "numbers", "label", "p1").collect()
    w = fitted.encoding.width_hot
    X = np.array([[float(s in r.hot) for s in range(w)] + list(r.numbers) for r in rows])
    y = np.array([r.label for r in rows])
    floor = 1e-9 * X.var(axis=0).max()
    logs = []
    for c in (0, 1):
        m, v = X[y == c].mean(axis=0), X[y == c].var(axis=0) + floor
        logs.append(math.log((y == c).mean()) - 0.5 * (np.log(2 * np.pi * v) + (X - m) ** 2 / v).sum(axis=1))
    want = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -700, 700)))
    assert np.allclose([r.p1 for r in rows], want, atol=1e-6)


def test_tree_table_accounts_for_every_row(spark, separable):
    nodes = {r.id: r for r in tree_nodes(spark, fit(learner("tree", max_depth=4), separable, SPEC).model).collect()}
    assert nodes[0].samples == 600 and (nodes[0].class_0, nodes[0].class_1) == (300, 300)
    assert abs(nodes[0].gini - 0.5) < 1e-9
    for node in nodes.values():
        if node.left_child is not None:
            assert node.samples == nodes[node.left_child].samples + nodes[node.right_child].samples


def test_one_class_training_answers_that_class(separable):
    ones = separable.where("y = 1")
    for name in ("tree", "perceptron", "bayes"):
        assert fit(learner(name), ones, SPEC).transform(separable).agg(F.min("prediction")).first()[0] == 1


def _noisy(spark):
    rows = [(i, i / 400, int((i * 7919) % 400 < i)) for i in range(400)]
    return spark.createDataFrame(rows, "row_idx long, score double, label int")


def test_calibrators_are_monotone(spark):
    df = _noisy(spark)
    for make in (fit_isotonic, fit_sigmoid):
        values = [r["_cal"] for r in make(df).apply(df.select("row_idx", "score")).orderBy("score").collect()]
        assert all(a <= b + 1e-9 for a, b in zip(values, values[1:]))
        assert 0 <= values[0] < 0.3 and 0.7 < values[-1] <= 1


def test_calibrated_model_averages_its_folds(separable):
    model = fit_calibrated(learner("bayes"), separable, folds.expanding_folds(600, 3), SPEC)
    assert len(model.members) == 3
    out = model.transform(separable)
    low, high = out.agg(F.min("p1"), F.max("p1")).first()
    assert 0 <= low and high <= 1 and out.count() == 600
    assert metrics.scores(out).first()["accuracy"] > 0.95


def test_cross_validation_rows(separable):
    cuts = folds.sliding_folds(600, 4, 0.8)
    results = experiment.cross_validate(separable, cuts, learner("bayes"), SPEC, ("accuracy", "recall"))
    assert results.count() == 4 * 2 * 2
    line = experiment.summary(results).where("split = 'test' AND metric = 'accuracy'").first()
    assert line["mean"] > 0.9 and line["std"] >= 0


def test_pooled_predictions_refuse_time_folds(separable):
    with pytest.raises(ValueError):
        experiment.out_of_fold(separable, folds.expanding_folds(600, 3), learner("bayes"), SPEC)
    dealt = folds.stratified_fold_column(separable, "y", 3, 0)
    pooled = experiment.out_of_fold(dealt, folds.folds_of_column(3), learner("bayes"), SPEC)
    assert pooled.select("row_idx").distinct().count() == pooled.count() == 600


def test_cross_dataset_needs_the_trained_columns(separable):
    other = separable.withColumn("extra", F.lit(1))
    assert experiment.cross_dataset_test(separable, other, learner("bayes"), SPEC).count() == 600
    with pytest.raises(ValueError):
        experiment.cross_dataset_test(separable, other.drop("z"), learner("bayes"), SPEC)


def test_grid_and_best_setting(separable):
    settings = experiment.grid(max_depth=[1, 3])
    assert settings == [{"max_depth": 1}, {"max_depth": 3}]
    results = experiment.grid_search(
        separable, folds.sliding_folds(600, 2, 0.8), lambda **s: learner("tree", **s), settings, SPEC
    )
    assert results.count() == 2 * 2 * 2
    assert experiment.best_settings(results).first()["mean"] > 0.9
    assert len(experiment.TUNING_GRIDS["tree"]) == 20


def test_learning_curves_train_on_the_stated_rows(separable):
    curve = experiment.expanding_learning_curve(separable, [119, 599], 2, learner("bayes"), SPEC)
    assert sorted(r.size for r in experiment.curve_summary(curve).select("size").distinct().collect()) == [119, 599]
    dealt = folds.stratified_fold_column(separable, "y", 2, 0)
    shuffled = experiment.learning_curve(dealt, folds.folds_of_column(2), learner("bayes"), [0.5, 1.0], SPEC)
    assert sorted({r.size for r in shuffled.collect()}) == [150, 300]


def test_curve_sizes_take_nine_tenths_in_equal_steps():
    sizes = run.curve_sizes(41970, 20)
    assert (len(sizes), sizes[0], sizes[1], sizes[-1]) == (20, 1888, 3777, 37773)


def test_whole_experiment_in_time_order(separable):
    settings = Experiment(
        folds=2, curve_steps=2, do_calibration=True, do_test_set=True, spec=SPEC, metrics=("accuracy", "recall")
    )
    out = run.run_experiment(separable, settings, "bayes", other=separable)
    assert set(out) == {
        "targets", "learning_curve", "calibration", "calibration_curve", "calibration_histogram", "cross_validation",
        "cross_scores", "cross_confusion", "test_scores", "test_confusion",
    }
    assert out["targets"].agg(F.sum("n")).first()[0] == 480
    assert out["test_scores"].first()["accuracy"] > 0.95
    assert {r.size for r in out["learning_curve"].collect()} == {216, 432}
    assert out["calibration"].count() == 2
    with pytest.raises(ValueError):
        run.run_experiment(
            separable, Experiment(folds=2, do_learning_curve=False, do_pooled_confusion=True, spec=SPEC), "bayes"
        )


def test_whole_experiment_shuffled_and_with_permuted_targets(separable):
    settings = Experiment(
        folds=3, time_series=False, do_learning_curve=False, do_pooled_confusion=True, spec=SPEC
    )
    out = run.run_experiment(separable, settings, "bayes")
    assert out["pooled_predictions"].agg(F.sum("n")).first()[0] == 480
    honest = out["cross_validation"].where("split = 'test'").first()["mean"]
    blind = run.run_experiment(separable, replace(settings, shuffle_targets=True, do_pooled_confusion=False), "bayes")
    assert honest > 0.95
    assert abs(blind["cross_validation"].where("split = 'test'").first()["mean"] - 0.5) < 0.15
