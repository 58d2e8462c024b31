"""Benchmarks that go on where they stopped, and the final model they choose.

An evaluation is one learner on one fold of one configuration in one repetition. Its predictions, then its result, are written to folders named
after it, overwriting what a killed run may have left, so writing it again changes nothing; what has a result is not planned again (anti join).
A learner that fails leaves a record of its error, and the others go on. Predictions are rows: lists of them are made for reports only.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark import StorageLevel
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import evaluate as V
from . import folds as S
from . import models as M
from .reduce import ReduceFeatures

KEYS = ["tag", "repetition", "n_components", "thr_features", "component_setting", "fold", "model"]
PLAN = "tag string, repetition int, n_components string, thr_features boolean, component_setting string, fold int, model string"
RESULT = f"{PLAN}, upsampling string, effective_n_components int, accuracy double, n_test long"
FAILURE = f"{PLAN}, error string"


def planned(spark: SparkSession, configurations: Sequence[tuple], models: Sequence[str], k: int, repetitions: int, tag: str = "all") -> DataFrame:
    """Every evaluation of a benchmark, a row each."""
    rows = [(tag, r, str(n), flag, setting, f, m) for r, n, flag, setting, f, m in M.benchmark_plan(repetitions, configurations, k, models)]
    return spark.createDataFrame(rows, PLAN)


def _folder(path: str, kind: str, e: Sequence) -> str:
    tag, repetition, n, flag, setting, fold, model = e
    name = "-".join(re.sub(r"[^A-Za-z0-9_]", "_", str(x)) for x in (tag, f"r{repetition}", f"n{n}", f"thr{flag}", setting, model, f"fold{fold}"))
    return f"{path}/{kind}/evaluation={name}"


def _read(spark: SparkSession, path: str, kind: str, schema: str) -> DataFrame:
    """All records of a kind; none if none was written yet. Half-written ones have no files, as Spark moves files in at the end."""
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{kind}/*/*.parquet")
    found = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(place)
    return spark.read.schema(schema).option("basePath", f"{path}/{kind}").parquet(f"{path}/{kind}/*") if found else spark.createDataFrame([], schema)


def results(spark: SparkSession, path: str) -> DataFrame:
    """One row for each finished evaluation."""
    return _read(spark, path, "results", RESULT).select(*[c.split()[0] for c in RESULT.split(", ")])


def failures(spark: SparkSession, path: str) -> DataFrame:
    """Evaluations that failed and have no result yet, with the error."""
    return V.pending(_read(spark, path, "failures", FAILURE), results(spark, path), KEYS)


def predictions(spark: SparkSession, path: str, key_type: str = "string") -> DataFrame:
    """(evaluation's keys, key, truth, predicted) of finished evaluations."""
    rows = _read(spark, path, "predictions", f"{PLAN}, key {key_type}, truth string, predicted string")
    return rows.join(F.broadcast(results(spark, path).select(*KEYS)), KEYS, "left_semi")


def result_table(spark: SparkSession, path: str) -> DataFrame:
    """Results with truths and predictions as comma-joined lists, ordered by accuracy: the published table. For folds that fit into a row."""
    lists = V.join_lists(predictions(spark, path), KEYS, "key")
    return results(spark, path).join(lists, KEYS).orderBy("accuracy")


def reducer_of(rows: DataFrame, n_components: str | int, threshold_flag: bool, threshold_places: Sequence[int], vec: str = "vec") -> ReduceFeatures:
    """What one configuration takes of a vector: all, threshold features only, or a projection on singular vectors of `rows`."""
    if str(n_components) == "all":
        return ReduceFeatures(None if threshold_flag or not threshold_places else threshold_places, None, vec)
    return ReduceFeatures(None, M.svd(rows, int(n_components), vec), vec)


def reduced(rows: DataFrame, reducer: ReduceFeatures) -> DataFrame:
    """Rows whose vector is what the reducer takes of it."""
    return reducer.transform(rows).withColumn(reducer.vec, vector_to_array(reducer.features)).drop(reducer.features)


def fitted(name: str, train: DataFrame, seed: int, draws: int = 0, inner: str | None = None):
    """A learner fitted on indexed rows with `features`; a forest is tuned first if draws are asked for, over the folds in column `inner`. Returns (model, parameters, score)."""
    if name != "rf" or not draws:
        return M.learner(name, seed).fit(train), None, None
    k = train.agg(F.max(inner)).first()[0] + 1
    best = M.tuned_forest(train.drop("features", "label_idx"), k, draws, inner, seed).first()
    chosen = M.forest_parameters(best["parameters"])
    return M.learner("rf", seed).setParams(**chosen).fit(train), best["parameters"], best["weighted_f1"]


def run(
    rows: DataFrame | Callable[[int], DataFrame],
    configurations: Sequence[tuple],
    models: Sequence[str],
    k: int,
    path: str,
    repetitions: int = 1,
    threshold_places: Sequence[int] = (),
    tag: str = "all",
    draws: int = 0,
    key: str | None = None,
    fold: str = "fold",
    seed: int = 42,
    strict: bool = True,
    upsampling: str = "none",
) -> DataFrame:
    """Runs what the plan has and `path` hasn't, and returns the results.

    `rows` (key, label, vec, fold), or a function that gives them for each repetition, so that repetitions can have folds of their own; learners' seeds
    are `seed` + repetition. With `draws`, forests are tuned within the training rows. Failed evaluations are recorded; if `strict`, an error
    at the end names them, and a further run tries them again.
    """
    of = rows if callable(rows) else lambda _: rows
    spark = of(0).sparkSession
    left = V.pending(planned(spark, configurations, models, k, repetitions, tag), results(spark, path), KEYS).collect()  # the plan, not data
    todo: dict[tuple, list[str]] = {}
    for e in left:
        todo.setdefault(tuple(e)[:6], []).append(e["model"])
    for e in sorted(todo):
        _, r, n, flag, _, f = e
        here = of(r)
        name = key or next(c for c in here.columns if c not in ("label", "vec", fold))
        train, test = here.filter(F.col(fold) != f), here.filter(F.col(fold) == f)
        prepared = None
        for m in sorted(todo[e], key=list(models).index):
            try:
                if prepared is None:
                    reducer = reducer_of(train, n, flag, threshold_places)
                    both = reduced(train.withColumn("_test", F.lit(False)).unionByName(test.withColumn("_test", F.lit(True))), reducer)
                    data, labels = M.indexed(M.vectors(both))
                    prepared = data.persist(StorageLevel.MEMORY_AND_DISK), labels.labels, len(data.select("vec").first()[0])
                _evaluate(prepared, (*e, m), path, name, seed + r, draws, upsampling)
            except Exception as error:  # recorded, and told of at the end
                spark.createDataFrame([(*e, m, f"{type(error).__name__}: {error}"[:2000])], FAILURE).coalesce(1).write.mode("overwrite").parquet(_folder(path, "failures", (*e, m)))
        if prepared is not None:
            prepared[0].unpersist()
    failed = failures(spark, path)
    if strict and not failed.isEmpty():
        told = "; ".join(f"{x['model']} fold {x['fold']}: {x['error'][:200]}" for x in failed.limit(5).collect())
        raise RuntimeError(f"benchmark incomplete; run it again to go on from {path}. Failures: {told}")
    return results(spark, path).filter(F.col("tag") == tag)


def _evaluate(prepared: tuple, e: tuple, path: str, key: str, seed: int, draws: int, upsampling: str) -> None:
    data, labels, width = prepared
    spark = data.sparkSession
    train, test = data.filter("NOT _test").drop("_test"), data.filter("_test")
    if e[-1] == "dummy":
        top = train.groupBy("label_idx").count().orderBy(F.desc("count"), "label_idx").first()[0]
        done = test.withColumn("prediction", F.lit(float(top)))
    else:
        if draws and e[-1] == "rf":
            train = S.stratified_folds(train.drop("fold"), "label", key, S.require_k(train, "label")).withColumnRenamed("fold", "_inner")
        done = fitted(e[-1], train, seed, draws, "_inner")[0].transform(test)
    named = F.get(F.array(*[F.lit(x) for x in labels]), F.col("prediction").cast("int"))
    keys = [F.lit(v).cast(t.split()[1]).alias(t.split()[0]) for v, t in zip(e, PLAN.split(", "), strict=True)]
    # read back with the key as text, whatever it is
    done.select(*keys, F.col(key).cast("string").alias("key"), F.col("label").alias("truth"), named.alias("predicted")).write.mode("overwrite").parquet(_folder(path, "predictions", e))
    written = spark.read.parquet(_folder(path, "predictions", e))
    right = written.agg(F.avg((F.col("truth") == F.col("predicted")).cast("double")).alias("accuracy"), F.count("*").alias("n_test"))
    right.select(*keys, F.lit(upsampling).alias("upsampling"), F.lit(width).cast("int").alias("effective_n_components"), "accuracy", "n_test").coalesce(1).write.mode("overwrite").parquet(_folder(path, "results", e))


def final_model(rows: DataFrame, names: Sequence[str], found: DataFrame, model: str, path: str, threshold_places: Sequence[int] = (), draws: int = 10, k: int = 5, seed: int = 42, filter_mode: str = "all") -> dict:
    """Fits the best configuration's learner on all rows (key, label, vec) and saves it, with what it takes of a vector, at `path`; returns what was saved beside it."""
    best = V.best_configuration(found).filter(F.col("model") == model).first()
    if best is None or model == "dummy":
        raise ValueError(f"no result of a learner {model!r} to fit a final model by")
    reducer = reducer_of(rows, best["n_components"], best["thr_features"], threshold_places)
    key = next(c for c in rows.columns if c not in ("label", "vec"))
    used = reduced(rows, reducer)
    if model == "rf" and draws:
        used = S.stratified_folds(used, "label", key, min(k, S.require_k(used, "label"))).withColumnRenamed("fold", "_inner")
    data, labels = M.indexed(M.vectors(used))
    data = data.persist(StorageLevel.MEMORY_AND_DISK)
    fit, parameters, score = fitted(model, data, seed, draws, "_inner")
    data.unpersist()
    meta = {"n_components": best["n_components"], "thr_features": best["thr_features"], "thr_indices": [int(p) for p in threshold_places], "filter_mode": filter_mode, "model_name": model, "cv_accuracy": best["mean_accuracy"], "best_params": parameters, "best_cv_score": score}
    whole = reducer.places is None and reducer.matrix is None
    M.save_model(PipelineModel([fit] if whole else [reducer, fit]), names, labels.labels, path, rows.sparkSession, **meta)
    return meta
