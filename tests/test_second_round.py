"""Answers that were once wrong, and parts that came later."""

import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from readsift.config import Experiment, FeatureSpec
from readsift.learners import fit, learner
from readsift.learners.calibration import CalibratedLearner
from readsift.learners.online import Weights, passive_aggressive_rule
from readsift.operators import folds
from readsift.plans import experiment, run
from readsift.session import released, stage, staging_root
from readsift.sources import files

SPEC = FeatureSpec(("c",), ("x",), ("b",), "y")


@pytest.fixture(scope="module")
def rows(spark):
    made = [(i, "hi" if i % 3 else "lo", (1.5 if i % 2 else -1.5) + math.sin(i * 12.9898) * 0.9, int(i % 5 == 0), i % 2) for i in range(301)]
    return spark.createDataFrame(made, "row_idx long, c string, x double, b int, y int").cache()


@pytest.mark.parametrize("name", ["bayes", "neighbours", "perceptron"])
def test_a_missing_number_fails_by_name(rows, name):
    model = fit(learner(name), rows, SPEC)
    holed = rows.withColumn("x", F.when(F.col("row_idx") != 7, F.col("x")))
    with pytest.raises(Exception, match="column x holds NULL"):
        model.transform(holed).select("prediction").collect()
    with pytest.raises(Exception, match="column b holds NULL"):
        fit(learner(name), rows.withColumn("b", F.lit(None).cast("int")), SPEC).transform(rows).select("prediction").collect()


def test_csv_keeps_every_text(spark, tmp_path):
    schema = StructType([StructField("a", StringType()), StructField("b", StringType())])
    made = [("  lead and trail  ", "x"), ("", "y"), (None, "z"), ('say "hi", ok', 'back\\slash "'), ("line\nbreak", "\r\nend"), (",", '"')]
    files.write_csv(spark.createDataFrame(made, schema), str(tmp_path / "t"))
    assert sorted(map(str, map(tuple, files.read_csv(spark, str(tmp_path / "t"), schema).collect()))) == sorted(map(str, made))
    (tmp_path / "other.csv").write_text('a,b\n"say ""hi"", ok",  k \n')
    assert [tuple(r) for r in files.read_csv(spark, str(tmp_path / "other.csv"), schema).collect()] == [('say "hi", ok', "  k ")]


def test_equal_settings_go_to_the_first_of_the_grid(spark):
    made = [("tree", {"max_depth": d}, None, f, "test", "accuracy", 0.9, 0.1, i) for i, d in enumerate(("20", "9")) for f in (0, 1)]
    found = experiment.best_settings(spark.createDataFrame(made, experiment.RESULT_SCHEMA)).collect()
    assert [r.params for r in found] == ['{"max_depth":"20"}']


def test_every_size_of_a_curve_is_over_all_folds(rows):
    dealt = folds.stratified_fold_column(rows, "y", 3, 0)
    curve = experiment.learning_curve(dealt, folds.folds_of_column(3), learner("bayes"), [0.5, 1.0], SPEC).collect()
    sizes = sorted({r.size for r in curve})
    assert len(sizes) == 2 and all({r.fold for r in curve if r.size == s} == {0, 1, 2} for s in sizes)


@pytest.mark.parametrize("name", ["perceptron", "passive_aggressive", "linear_svm"])
def test_partitions_do_not_change_a_fit(spark, rows, name):
    models = []
    for partitions in ("3", "11"):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        models.append(fit(learner(name, max_rounds=4), rows.repartition(int(partitions)), SPEC).model)
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert models[0] == models[1]


def test_passive_aggressive_steps_row_by_row():
    update, w = passive_aggressive_rule(10.0), Weights.zero(3, 1)
    hot, numbers, side = np.array([[0, 3], [1, 2]]), np.array([[2.0], [1.0]]), np.array([1.0, -1.0])
    update(w, hot, numbers, side, 0)
    # First row: loss 1, norm 1 + 4 (slot 3 is unknown); second: margin from the first step, norm 2 + 1.
    step = 1 / 5
    margin = step * 2.0 * 1.0 + step
    second = (1 + margin) / 3
    assert w.numbers[0] == pytest.approx(2 * step - second) and w.slots.tolist() == pytest.approx([step, -second, -second, 0])


def test_calibrated_learner_in_cross_validation(rows):
    made = CalibratedLearner(learner("bayes"), folds=3, method="sigmoid")
    scores = experiment.cross_validate(rows, folds.expanding_folds(301, 2), made, SPEC).where("split = 'test'").collect()
    assert all(r.classifier == "calibrated_bayes" and r.value > 0.9 for r in scores) and len(scores) == 2


def test_tuning_and_analysis_whichever_the_learner(rows, monkeypatch):
    monkeypatch.setitem(experiment.TUNING_GRIDS, "tree", experiment.grid(max_depth=[1, 2]))
    settings = Experiment(
        folds=2, do_learning_curve=False, do_cross_validation=False, do_tuning=True, tuned=("tree", "neighbours"), do_learning_analysis=True, spec=SPEC
    )
    out = run.run_experiment(rows, settings, "bayes")
    assert {r.classifier for r in out["best"].collect()} == {"tree", "neighbours"}
    audit = out["neighbour_audit"].collect()
    assert len(audit) == 50 and {"query_x", "neighbour_x", "query_y", "neighbour_y"} <= set(out["neighbour_audit"].columns)


def test_released_copies_are_gone(spark):
    root = f"{staging_root(spark).removeprefix('file://')}/readsift"
    kept = stage(spark.range(3))
    before = set(os.listdir(root))
    with released(spark):
        assert stage(spark.range(5), "gone").count() == 5
        assert set(os.listdir(root)) > before
    assert set(os.listdir(root)) == before and kept.count() == 3
