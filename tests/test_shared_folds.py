"""Prefix folds fitted together against a fit per fold."""

import math

import pytest

from readsift.config import FeatureSpec
from readsift.learners import learner, simple
from readsift.operators import folds
from readsift.plans import experiment

SPEC = FeatureSpec(("c", "m"), ("x", "z"), ("b",), "y")


@pytest.fixture(scope="module")
def rows(spark):
    made = []
    for i in range(400):
        y = int(math.sin(i * 12.9898) > 0.1)
        # The first rows are all of one class, and values of c come in as time goes on.
        y = 0 if i < 30 else y
        made.append((i, f"v{i % (3 + i // 60)}", i % 4 + y, 5.0 + y + math.sin(i * 3.7), 100.0, int(i % 5 == y), y))
    return spark.createDataFrame(made, "row_idx long, c string, m int, x double, z double, b int, y int").cache()


def _by_part(results):
    return {(r.size, r.fold, r.split, r.metric): r.value for r in results.collect()}


@pytest.mark.parametrize("cells", [1, 2_000_000])
def test_prefix_scores_are_those_of_single_fits(rows, monkeypatch, cells):
    monkeypatch.setattr(simple, "PREFIX_CELLS", cells)
    sizes, metrics = [59, 399], ("accuracy", "recall")
    shared = experiment.expanding_learning_curve(rows, sizes, 3, learner("bayes"), SPEC, metrics, rows)
    alone = []
    for size in sizes:
        cuts = folds.expanding_folds(size + 1, 3)
        alone.append({
            (size, *key[1:]): v
            for key, v in _by_part(experiment.cross_validate(rows, cuts, learner("bayes"), SPEC, metrics, vocabulary_from=rows)).items()
        })
    assert _by_part(shared) == alone[0] | alone[1] and len(alone[0]) == 3 * 2 * 2


def test_prefix_models_equal_single_models(rows):
    encoding = experiment.fit_encoding(rows, SPEC)
    encoded = experiment.labelled(encoding.transform(rows), SPEC)
    for stop, model in learner("bayes").fit_prefixes(encoded, encoding, [20, 100, 333], "row_idx"):
        train = rows.where(f"row_idx < {stop}")
        if stop == 20:
            assert isinstance(model, simple.DummyModel) and model.prior == 0.0
            continue
        own = experiment.fit_encoding(train, SPEC, encoding.categories)
        alone = learner("bayes").fit(experiment.labelled(own.transform(train), SPEC), own)
        for c in (0, 1):
            assert model.constant[c] == pytest.approx(alone.constant[c], rel=1e-6)
            assert model.slot_change[c] == pytest.approx(alone.slot_change[c], rel=1e-6)
            for i, name in enumerate(("x", "z")):
                mean, std = own.stats[name]
                m, v = alone.number_stats[c][i]
                assert model.number_stats[c][i] == pytest.approx((m * std + mean, v * std * std), rel=1e-6)


def test_test_scores_alone(rows):
    found = experiment.prefix_validate(rows, experiment.expanding_parts(400, 4), learner("bayes"), SPEC, train_scores=False)
    assert {(r.fold, r.split) for r in found.collect()} == {(i, "test") for i in range(4)}
    with pytest.raises(ValueError):
        folds.expanding_bounds(3, 3)


def test_shuffled_curves_are_those_of_single_fits(rows):
    dealt = folds.stratified_fold_column(rows, "y", 3, 0)
    cuts = folds.folds_of_column(3)

    class Alone:
        """The same learner without a way to fit prefixes together."""

        def __init__(self):
            self.fit, self.name = learner("bayes").fit, "bayes"

    shared, alone = (
        _by_part(experiment.learning_curve(dealt, cuts, one, [0.3, 1.0], SPEC, vocabulary_from=rows)) for one in (learner("bayes"), Alone())
    )
    assert shared == alone and len(shared) == 2 * 3 * 2


def test_prefix_scores_count_rows_and_never_copy_them_per_part(rows, monkeypatch):
    seen = []
    whole = experiment.metric_ops.scores
    monkeypatch.setattr(experiment.metric_ops, "scores", lambda df, metrics, by, count=None: seen.append((count, df.count())) or whole(df, metrics, by, count))
    experiment.expanding_learning_curve(rows, [199, 399], 3, learner("bayes"), SPEC, ("accuracy",), rows)
    ((count, cells),) = seen
    # Two splits of six parts with four cells at most, of every batch.
    assert count == "n" and cells <= 48 * rows.rdd.getNumPartitions()


def test_encodings_of_folds_are_those_of_single_fits(rows, monkeypatch):
    from readsift.operators import encode

    monkeypatch.setattr(encode, "TOGETHER", 3)
    dealt = folds.stratified_fold_column(rows, "y", 5, 0)
    cuts = folds.folds_of_column(5)
    passes = []
    whole = encode.binned_sums
    monkeypatch.setattr(encode, "binned_sums", lambda *args: passes.append(1) or whole(*args))
    for room in (50_000, 4):
        shared = encode.fit_encodings(dealt, [f.train for f in cuts], SPEC, looked_up=room)
        for f, found in zip(cuts, shared):
            alone = encode.fit_encoding(dealt.where(f.train), SPEC)
            assert found.stats == alone.stats and found.categories.sizes == alone.categories.sizes
            if room > 4:
                assert found.labels == alone.labels
    assert len(passes) == 4
