"""Distributed isotonic regression, and scorers that are saved and read again."""

import os
import subprocess
import sys
import threading

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from corpuscope.operators import forest, models
from corpuscope.operators.isotonic import pooled_blocks
from corpuscope.plans import relevance

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def pooled(x, y):
    """Pool adjacent violators over distinct scores, one by one."""
    stack = []
    for value in np.unique(x):
        part = y[x == value]
        block = [value, value, part.sum(), len(part)]
        while stack and stack[-1][2] / stack[-1][3] >= block[2] / block[3]:
            before = stack.pop()
            block = [before[0], block[1], before[2] + block[2], before[3] + block[3]]
        stack.append(block)
    return [(a, b, round(s / n, 12), float(n)) for a, b, s, n in stack]


def blocks_of(spark, x, y, per_task):
    rows = spark.createDataFrame([(float(a), int(b)) for a, b in zip(x, y)], "score double, label int").repartition(7)
    return [(r.low, r.high, round(r.fit, 12), r.weight) for r in pooled_blocks(rows, blocks_per_task=per_task).orderBy("low").collect()]


@pytest.mark.parametrize("per_task", [100_000, 40])
@pytest.mark.parametrize("kind", ["noise", "rising", "decreasing", "ties", "late drop"])
def test_blocks_match_pooling_one_by_one(spark, kind, per_task):
    rng = np.random.default_rng(4)
    n = 400
    x = np.sort(rng.random(n)) if kind != "ties" else np.round(rng.random(n), 1)
    y = {
        "noise": (rng.random(n) < x), "rising": np.arange(n) >= n // 2, "decreasing": np.arange(n) < n // 2,
        "ties": (rng.random(n) < x), "late drop": (rng.random(n) < x) & (np.arange(n) < n - 60),
    }[kind].astype(int)
    assert blocks_of(spark, x, y, per_task) == pooled(x, y)


def test_steadily_falling_labels_are_one_block(spark):
    x = np.arange(500) / 500
    rows = spark.createDataFrame([(float(a), float(1 - a)) for a in x], "score double, label double")
    (only,) = pooled_blocks(rows, blocks_per_task=30).collect()
    assert (only.low, only.high, only.weight) == (0.0, x[-1], 500.0) and abs(only.fit - (1 - x).mean()) < 1e-12


def test_missing_scores_and_no_rows(spark):
    rows = spark.createDataFrame([(0.5, 1), (None, 1), (float("nan"), 0), (0.7, None), (0.2, 0)], "score double, label int")
    assert [(r.low, r.fit) for r in pooled_blocks(rows).orderBy("low").collect()] == [(0.2, 0.0), (0.5, 1.0)]
    assert pooled_blocks(rows.where("score > 9")).count() == 0


def test_calibration_interpolates_and_clips(spark):
    rows = spark.createDataFrame([(0.2, 0), (0.4, 0), (0.6, 1), (0.8, 1)], "score double, label int")
    asked = spark.createDataFrame([(0.0,), (0.5,), (0.45,), (0.9,)], "score double")
    found = [round(r.score, 9) for r in models.fit_isotonic(rows)(asked).collect()]
    assert found == [0.0, 0.5, 0.25, 1.0]


def vectors(spark, n=300):
    rng = np.random.default_rng(9)
    rows = [(i, rng.normal(size=3).tolist()) for i in range(n)]
    frame = spark.createDataFrame([(i, v, int(v[0] + 0.3 * v[1] > 0)) for i, v in rows], "id long, v array<double>, label int")
    return frame.select("id", "label", array_to_vector("v").alias("features"))


FITS = {
    "logreg": lambda t, v: models.pipeline_scorer(models.fit_logreg(t)),
    "forest": lambda t, v: models.pipeline_scorer(models.fit_forest(t, trees=5)),
    "boosted": lambda t, v: models.pipeline_scorer(models.fit_boosted(t, val=v, rounds=5)),
    "mlp": lambda t, v: models.pipeline_scorer(models.fit_perceptron(t, width=3)),
    "svm": lambda t, v: models.fit_linear_svm(t, "id"),
}


@pytest.mark.parametrize("name", sorted(FITS))
def test_saved_scorers_score_equal_rows_equally(spark, tmp_path, name):
    rows = vectors(spark).persist()
    train, val = rows.where("id % 3 > 0"), rows.where("id % 3 = 0")
    scorer = FITS[name](train, val)
    if name != "svm":
        scorer = scorer.then(*models.fit_isotonic(scorer(val)).model.stages)
    whole = scorer.with_threshold(0.4)
    whole.save(str(tmp_path / "model"))
    want = {r.id: (r.confidence, r.predicted_label) for r in whole(rows).collect()}
    again = models.ModelScorer.load(str(tmp_path / "model"))(rows)
    assert {r.id: (r.confidence, r.predicted_label) for r in again.collect()} == want
    assert again.columns == ["id", "label", "features", "score", "predicted_label", "confidence"]
    assert all(label == (score >= 0.4) for score, label in want.values())
    hits = rows.join(again.select("id", "predicted_label"), "id").where("label = predicted_label").count()
    assert hits > 240


def test_probabilities_are_taken_as_they_are(spark):
    rows = vectors(spark)
    model = models.fit_logreg(rows)
    raw = {r.id: r.probability[1] for r in model.transform(rows).collect()}
    assert {r.id: r.score for r in models.pipeline_scorer(model)(rows).collect()} == raw


def test_chosen_model_is_read_in_a_new_session(spark, tmp_path):
    """The whole flow: five models compared, the best saved; another process without this package labels rows alike."""
    rng = np.random.default_rng(3)
    rows = [(str(i), rng.normal(size=4).tolist()) for i in range(240)]
    emb = spark.createDataFrame(rows, "video_id string, embedding array<double>")
    truth = spark.createDataFrame([(k, int(v[0] > 0)) for k, v in rows], "video_id string, label int")
    fitted = truth.where("cast(video_id as int) % 2 = 0")
    model = relevance.train(emb, fitted, truth.join(fitted, "video_id", "left_anti"), boosting_rounds=5, forest_trees=5)
    model.save(str(tmp_path / "chosen"))
    features = relevance.as_features(emb, "video_id")
    features.write.parquet(str(tmp_path / "features"))
    want = {r.video_id: (r.score, int(r.score >= model.threshold)) for r in model.scorer(features).collect()}
    code = f"""
from pyspark.sql import SparkSession
from pyspark.ml import PipelineModel
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
rows = PipelineModel.load({str(tmp_path / "chosen")!r}).transform(spark.read.parquet({str(tmp_path / "features")!r}))
rows.select("video_id", "confidence", "predicted_label").write.parquet({str(tmp_path / "out")!r})
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], check=True, cwd=tmp_path, env=env, capture_output=True)
    found = {r.video_id: (r.confidence, r.predicted_label) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert found == want and len(found) == 240


def test_forest_keeps_the_nodes_of_rows(spark):
    """Without it every pass descends all trees from their roots; the trees are the same."""
    rows = vectors(spark).persist()
    model = models.fit_forest(rows, trees=5).stages[-1]
    assert model.getCacheNodeIds()
    scaled = models._scaled(models.RandomForestClassifier(featuresCol="scaled", numTrees=5, maxDepth=30, seed=42))
    assert model.toDebugString.split("\n")[1:] == scaled.fit(rows).stages[-1].toDebugString.split("\n")[1:]


def test_models_are_fitted_at_the_same_time(spark, monkeypatch):
    """Each of the two fits waits until the other has begun, and so do the folds of the SVM."""
    rows = vectors(spark).persist()

    def together(barrier, fit):
        return lambda *args, **options: (barrier.wait(), fit(*args, **options))[1]

    both, folds = threading.Barrier(2, timeout=60), threading.Barrier(3, timeout=60)
    monkeypatch.setattr(models, "fit_logreg", together(both, models.fit_logreg))
    monkeypatch.setattr(models, "fit_linear_svm", together(both, models.fit_linear_svm))
    monkeypatch.setattr(models, "LinearSVC", together(folds, models.LinearSVC))
    parts = [rows.where(f"id % 3 = {i}") for i in range(3)]
    table, scorers = models.compare_models(*parts, "id", names=("svm", "logreg"))
    assert [r.model for r in table.collect()] == ["svm", "logreg"] and list(scorers) == ["svm", "logreg"]
    assert all(r.test_roc_auc > 0.9 for r in table.collect())


def test_large_forest_is_fitted_asked_saved_and_read_in_parts(spark, tmp_path, monkeypatch):
    """No more nodes at once on the driver than the bound, one tree aside; another session reads one forest of all trees."""
    rows = vectors(spark).persist()
    monkeypatch.setattr(forest, "NODES_AT_ONCE", 800)
    most = []
    load = RandomForestClassificationModel.load.__func__

    def watched(cls, path):
        model = load(cls, path)
        most.append(model.totalNumNodes)
        return model

    monkeypatch.setattr(RandomForestClassificationModel, "load", classmethod(watched))
    scorer = models.pipeline_scorer(models.fit_forest(rows, trees=4)).with_threshold(0.4)
    asked = rows.unionByName(rows.where("id < 5"))
    want = sorted((r.id, r.score) for r in scorer(asked).collect())
    assert len(want) == 305 and len(most) == 2 and max(most) <= 800
    hits = sum((score >= 0.4) == bool(label) for (_, score), label in zip(
        want, [r.label for r in asked.orderBy("id").collect()]))
    assert hits > 290
    scorer.save(str(tmp_path / "m"))
    stages = PipelineModel.load(str(tmp_path / "m")).stages
    assert stages[1].getNumTrees == 4 and stages[1].totalNumNodes == sum(most[:2])
    assert stages[1].numFeatures == 3
    monkeypatch.setattr(forest, "NODES_AT_ONCE", 100)
    again = models.ModelScorer.load(str(tmp_path / "m"))
    assert isinstance(again.model.stages[1], forest.PartedForest)
    for reader in (again, PipelineModel(stages).transform):
        found = sorted((r.id, r.score) for r in reader(asked).collect())
        assert [i for i, _ in found] == [i for i, _ in want]
        assert np.allclose([s for _, s in found], [s for _, s in want], rtol=0, atol=1e-12)
    again.save(str(tmp_path / "n"))
    assert PipelineModel.load(str(tmp_path / "n")).stages[1].totalNumNodes == stages[1].totalNumNodes
