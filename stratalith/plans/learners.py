"""Queries over learners: rows only, as no SQL can express them; determinism and sanity are tested."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import folds as S
from ..operators import models as M
from ..operators import structure as R
from .registry import query, table

_N = 64
_FOLDS = 3
_NAMES = [f"d{i}" for i in range(_N)]


def rows(spark: SparkSession, sf_dir: str, labels: int = 4) -> DataFrame:
    """Embeddings as vectors of all their features with a label that the first two nearly tell."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("vec"))
    label = ((F.get("vec", F.lit(0)) > 0).cast("int") * 2 + (F.get("vec", F.lit(1)) > 0).cast("int")) % labels
    return S.stratified_folds(v.withColumn("label", label.cast("string")), "label", "vec_id", _FOLDS).select("vec_id", "label", "vec", "fold").repartition(8, "vec_id").sortWithinPartitions("vec_id")


@query()
def rf_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.forest_importance(rows(spark, sf_dir), _NAMES)


@query()
def tuned_rf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.tuned_forest(rows(spark, sf_dir), _FOLDS, M.runtime_config()["draws"])


@query()
def logistic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.cross_validate(rows(spark, sf_dir), "logistic", _FOLDS)


@query()
def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.cross_validate(rows(spark, sf_dir), "decisiontree", _FOLDS)


@query()
def boosted_ovr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.cross_validate(rows(spark, sf_dir, 3), "xgb", _FOLDS)


@query()
def svd_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = rows(spark, sf_dir)
    return M.project(r, M.svd(r, 3)).select("vec_id", F.transform("vec", lambda x: F.round(x, 6)).alias("vec"))


@query()
def ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.ablation(rows(spark, sf_dir), _NAMES, _FOLDS, 5)


@query()
def learning_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = rows(spark, sf_dir).withColumn("well", F.col("vec_id") % 6)
    return M.learning_curve(r, S.pool_ranks(r, "label", "well"), [1, 4], "well", [0, 1])


@query()
def benchmark_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.evaluate import configuration_grid

    return M.benchmark(rows(spark, sf_dir), configuration_grid([4, "all"], _N, 3), ["dummy", "decisiontree"], _FOLDS, 1, [0, 3, 5])


@query()
def hier_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    import numpy as np

    r = table(spark, sf_dir, "embeddings").select("label", F.col("embedding").cast("array<double>").alias("vec"))
    pairs = R.centroid_distances(r, "label", 64).collect()
    labels = sorted({x for p in pairs for x in (p["a"], p["b"])})
    d = np.zeros((len(labels), len(labels)))
    for p in pairs:
        d[labels.index(p["a"]), labels.index(p["b"])] = d[labels.index(p["b"]), labels.index(p["a"])] = p["distance"]
    return spark.createDataFrame([(m, *row) for m in ("single", "weighted", "complete", "average", "median") for row in M.linkage(d, m)], "method string, left int, right int, height double, size int")


@query()
def tree_shap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attributions of a small forest; they add up to its probabilities, which the tests check."""
    from ..operators import explain as E

    r = rows(spark, sf_dir)
    data, _ = M.indexed(M.vectors(r))
    model = M.RandomForestClassifier(labelCol="label_idx", numTrees=5, maxDepth=4, seed=1).fit(data)
    done = E.tree_attributions(model, r)
    return done.select("vec_id", F.posexplode("attributions").alias("feature", "attribution")).groupBy("feature").agg(F.avg(F.abs("attribution")).alias("importance"))


@query()
def path_margins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance of values from the thresholds on their decision paths."""
    r = rows(spark, sf_dir)
    data, _ = M.indexed(M.vectors(r))
    model = M.RandomForestClassifier(labelCol="label_idx", numTrees=5, maxDepth=4, seed=1).fit(data)
    return M.path_margins(model, r).select("vec_id", "total")
