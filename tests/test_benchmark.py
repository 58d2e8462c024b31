"""Benchmarks that go on where they stopped, final models of any configuration, and scoring that survives bad rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratalith.operators import benchmark as B
from stratalith.operators import evaluate as V
from stratalith.operators import models as M
from stratalith.operators.reduce import ReduceFeatures
from stratalith.plans import workflows as W

GRID = V.configuration_grid([2, "all"], 6, 2)


@pytest.fixture(autouse=True)
def small_forests(monkeypatch):
    monkeypatch.setattr(M, "FOREST_GRID", {"numTrees": [3, 5], "maxDepth": [2, 3]})


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    made = [(f"s{i}", "ab"[i % 2], [*(rng.random(5) + 3 * (i % 2)).tolist(), float(rng.random())], i // 2 % 2) for i in range(24)]
    return spark.createDataFrame(made, "name string, label string, vec array<double>, fold int").cache()


def table(df):
    return sorted(tuple(r[c] for c in [*B.KEYS, "upsampling", "effective_n_components", "accuracy", "n_test"]) for r in df.collect())


def test_a_killed_run_goes_on(spark, rows, tmp_path, monkeypatch):
    args = (rows, GRID[2:], ["dummy", "decisiontree"], 2)
    whole = table(B.run(*args, str(tmp_path / "whole"), 1, [1, 3]))
    assert len(whole) == 2 * 2 * 2 and {r[8] for r in whole} == {2, 6} and {r[4] for r in whole} == {"all_columns", "threshold_only"}
    real, n = B._evaluate, [0]

    def dies(*a):
        n[0] += 1
        if n[0] == 6:
            real(*a[:2], str(tmp_path / "lost"), *a[3:])  # what was written is not in place
            raise KeyboardInterrupt
        return real(*a)

    monkeypatch.setattr(B, "_evaluate", dies)
    with pytest.raises(KeyboardInterrupt):
        B.run(*args, str(tmp_path / "part"), 1, [1, 3])
    assert len(table(B.results(spark, str(tmp_path / "part")))) == 5
    monkeypatch.setattr(B, "_evaluate", lambda *a: (n.append(1), real(*a)))
    assert table(B.run(*args, str(tmp_path / "part"), 1, [1, 3])) == whole and len(n) - 1 == 8 - 5
    before = len(n)
    assert table(B.run(*args, str(tmp_path / "part"), 1, [1, 3])) == whole and len(n) == before  # nothing is left to do
    told = B.result_table(spark, str(tmp_path / "part")).filter("model = 'decisiontree' AND n_components = 'all' AND thr_features AND fold = 0").first()
    truth = [r["label"] for r in rows.filter("fold = 0").orderBy("name").collect()]
    assert told["test_set"].split(",") == truth
    assert math.isclose(told["accuracy"], np.mean([a == b for a, b in zip(truth, told["predicted_set"].split(","))]))


def test_a_failing_learner_leaves_a_record(spark, rows, tmp_path, monkeypatch):
    path = str(tmp_path)
    real = M.learner
    monkeypatch.setattr(M, "learner", lambda name, *a, **b: real(name if name != "broken" else 1 / 0, *a, **b))
    with pytest.raises(RuntimeError, match="broken fold 0: ZeroDivisionError"):
        B.run(rows, GRID[2:3], ["broken", "decisiontree"], 2, path)
    assert [(r["model"], r["fold"]) for r in B.failures(spark, path).orderBy("fold").collect()] == [("broken", 0), ("broken", 1)]
    assert {r["model"] for r in B.results(spark, path).collect()} == {"decisiontree"} and B.results(spark, path).count() == 2
    monkeypatch.setattr(M, "learner", lambda name, *a, **b: real("decisiontree", *a, **b))
    assert B.run(rows, GRID[2:3], ["broken", "decisiontree"], 2, path).count() == 4 and B.failures(spark, path).isEmpty()


def test_repetitions_have_seeds_and_folds_of_their_own(spark, rows, tmp_path, monkeypatch):
    seeds, real = [], M.learner
    monkeypatch.setattr(M, "learner", lambda name, seed=42, **b: (seeds.append(seed), real("decisiontree", seed, **b))[1])
    found = B.run(lambda r: rows.withColumn("fold", (F.col("fold") + r * F.pmod(F.xxhash64("name"), F.lit(2))).cast("int") % 2), GRID[2:3], ["rf"], 2, str(tmp_path), 3)
    assert seeds == [42, 42, 43, 43, 44, 44] and found.count() == 6
    sets = {tuple(sorted(r["key"] for r in B.predictions(spark, str(tmp_path)).filter(f"repetition = {k} AND fold = 0").collect())) for k in (0, 1)}
    assert len(sets) == 2


def test_tuning_inside_an_evaluation(spark, rows, tmp_path, monkeypatch):
    asked, real = [], M.tuned_forest
    monkeypatch.setattr(M, "tuned_forest", lambda r, k, d, *a: (asked.append((r.count(), k, d)), real(r, k, 1, *a))[1])
    B.run(rows, GRID[2:3], ["rf"], 2, str(tmp_path), draws=4)
    assert asked == [(12, 5, 4), (12, 5, 4)]


@pytest.mark.parametrize("n,flag,width", [("2", True, 2), ("all", False, 2), ("all", True, 6)])
def test_the_final_model_takes_what_it_was_fitted_on(spark, rows, tmp_path, monkeypatch, n, flag, width):
    saved, real = [], M.save_model
    monkeypatch.setattr(M, "save_model", lambda model, *a, **b: (saved.append(model), real(model, *a, **b)))
    found = spark.createDataFrame([("all", 0, n, flag, "x", f, "rf", "none", width, 0.9, 12) for f in range(2)], B.RESULT)
    names = [f"f{i}" for i in range(6)]
    meta = B.final_model(rows.drop("fold"), names, found, "rf", str(tmp_path), [1, 3], draws=1)
    assert meta["n_components"] == n and meta["cv_accuracy"] == 0.9 and "numTrees" in meta["best_params"]
    kept = M.model_meta(str(tmp_path), spark)
    assert list(kept["feature_names"]) == names and kept["thr_indices"] == [1, 3] and kept["best_params"] == meta["best_params"]
    pipeline = M.load_model(str(tmp_path), spark)[0]
    assert pipeline.stages[-1].numFeatures == width
    held = rows if len(saved[0].stages) == 2 else M.vectors(rows)
    want = {r["name"]: r["probability"].toArray().tolist() for r in saved[0].transform(held).collect()}
    long = rows.select(F.col("name").alias("sample_name"), F.posexplode("vec").alias("position", "value")).withColumn("feature", F.concat(F.lit("f"), F.col("position")))
    got = {r["sample_name"]: r["probabilities"] for r in M.score(long, str(tmp_path)).collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k]) for k in want)


def test_svd_wins_and_the_workflow_saves_it(spark, tmp_path, monkeypatch):
    """As found in a whole run: a projection on 16 components is best, is saved, and scores new samples."""
    rng = np.random.default_rng(5)
    made = [(f"s{i}", "ab"[i % 2], (rng.random(20) + (i % 2)).tolist()) for i in range(40)]
    data = spark.createDataFrame(made, "name string, label string, vec array<double>")
    monkeypatch.setattr(M, "runtime_config", lambda ci: {"draws": 1, "repetitions": 1, "components": [16]})
    names = [f"f{i}" for i in range(20)]
    assert W.train(data, names, str(tmp_path / "m"), 2, learner="decisiontree").count() == 2 * 2 * 2
    assert M.model_meta(str(tmp_path / "m"), spark)["n_components"] == "16"
    long = data.select(F.col("name").alias("sample_name"), F.posexplode("vec").alias("position", "value")).withColumn("feature", F.concat(F.lit("f"), F.col("position"))).drop("position")
    got = {r["sample_name"]: r["predicted"] for r in W.infer(long, str(tmp_path / "m")).collect()}
    assert np.mean([got[n] == label for n, label, _ in made]) > 0.9


def test_bad_rows_and_missing_metadata(spark, rows, tmp_path):
    data, labels = M.indexed(M.vectors(rows))
    fit = M.learner("decisiontree").fit(data)
    M.save_model(fit, list("uvwxyz"), labels.labels, str(tmp_path / "with"), spark)
    from pyspark.ml import PipelineModel

    PipelineModel([fit]).save(str(tmp_path / "without") + "/model")
    cells = [(s, p, v) for s, values in {"good": [3.5] * 6, "low": [0.5] * 6, "short": [1.0] * 4, "long": [1.0] * 9, "nan": [1.0, math.nan] + [1.0] * 4, "null": [None] + [1.0] * 5, "inf": [math.inf] * 6}.items() for p, v in enumerate(values)]
    aligned = spark.createDataFrame(cells, "sample_name string, position int, value double").withColumn("feature", F.concat(F.lit("f"), F.col("position")))
    got = {r["sample_name"]: r for r in M.score_models(aligned, {"a": str(tmp_path / "with"), "b": str(tmp_path / "without"), "c": str(tmp_path / "gone")}).collect()}
    assert got["good"]["a_prediction"] == "b" and got["low"]["a_prediction"] == "a" and got["good"]["a_confidence"] == 1.0
    assert got["good"]["b_prediction"] == "class_1" and got["low"]["b_prediction"] == "class_0"
    for bad in ("short", "long", "nan", "null", "inf"):
        assert [got[bad][c] for c in ("a_prediction", "a_confidence", "b_prediction", "b_confidence")] == ["ERROR", 0.0, "ERROR", 0.0]
    assert {(r["c_prediction"], r["c_confidence"]) for r in got.values()} == {("ERROR", 0.0)}
    assert M.score(aligned, str(tmp_path / "with")).filter("sample_name = 'nan'").first()["probabilities"] is None


def test_reducer_is_saved_whole(spark, rows, tmp_path):
    matrix = np.random.default_rng(1).random((6, 3))
    for k, stage in enumerate((ReduceFeatures([4, 0]), ReduceFeatures(None, matrix), ReduceFeatures([0, 1, 2, 3, 4, 5], matrix), ReduceFeatures())):
        stage.write().overwrite().save(str(tmp_path / str(k)))
        again = ReduceFeatures.load(str(tmp_path / str(k)))
        a, b = ([r["features"].toArray().tolist() for r in s.transform(rows).orderBy("name").collect()] for s in (stage, again))
        assert a == b and again.uid == stage.uid
    vec = rows.orderBy("name").first()["vec"]
    assert np.allclose(ReduceFeatures(None, matrix).transform(rows).orderBy("name").first()["features"].toArray(), np.array(vec) @ matrix)
