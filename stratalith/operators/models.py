"""Learners on feature vectors: ranking, tuning, boosting, SVD, ablation, learning curves, clustering, attributions of trees.

Rows hold (key, label, vec array<double>, fold or group). Training is MLlib's; what loops on the driver are plans of evaluations (repetitions,
configurations, folds), never rows. scikit-learn's forests, folds and searches can't be had number by number; the contracts are kept.
"""

from __future__ import annotations

import ast
import random
import uuid
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, LogisticRegression, OneVsRest, RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import StringIndexer, StringIndexerModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.linalg import Vectors as OldVectors
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

from ..shipping import ship

#: Grid of the random search, as published for the tuned forest; MLlib has no counterpart of the minimal split size.
FOREST_GRID = {"numTrees": [50, 100, 200], "maxDepth": [5, 10, 15], "featureSubsetStrategy": ["sqrt", "log2"], "minInstancesPerNode": [1, 2, 4]}
COMPONENTS = [16, 32, 64, 128, 256, 512, "all"]


def runtime_config(ci: bool = False) -> dict:
    """Draws of a search, repetitions and component counts of the benchmark; small ones for continuous integration."""
    return {"draws": 2, "repetitions": 1, "components": ["all"]} if ci else {"draws": 10, "repetitions": 3, "components": COMPONENTS}


def vectors(rows: DataFrame, vec: str = "vec") -> DataFrame:
    return rows.withColumn("features", array_to_vector(F.col(vec)))


def indexed(rows: DataFrame, label: str = "label") -> tuple[DataFrame, StringIndexerModel]:
    """`rows` with `label_idx`: sorted labels numbered from 0."""
    model = StringIndexer(inputCol=label, outputCol="label_idx", stringOrderType="alphabetAsc").fit(rows.withColumn(label, F.col(label).cast("string")))
    return model.transform(rows.withColumn(label, F.col(label).cast("string"))), model


def at_once(work: Callable, items: Sequence, most: int = 3) -> list:
    """`work` of every item, in order, up to `most` at the same time: a fit's jobs are short and of few tasks and leave cores idle."""
    with ThreadPoolExecutor(most) as pool:
        return list(pool.map(inheritable_thread_target(work), items))


def forest_importance(rows: DataFrame, names: Sequence[str], label: str = "label", trees: int = 200, seed: int = 1234) -> DataFrame:
    """(feature, score): importances of a forest that may use all features at every split, highest first."""
    data, _ = indexed(vectors(rows), label)
    model = RandomForestClassifier(labelCol="label_idx", numTrees=trees, featureSubsetStrategy="all", seed=seed).fit(data)
    found = sorted(zip(names, model.featureImportances.toArray().tolist(), strict=True), key=lambda x: (-x[1], x[0]))
    return rows.sparkSession.createDataFrame(found, "feature string, score double")


def learner(name: str, seed: int = 42, boosting_rounds: int = 100):
    """A learner by its key."""
    common = {"labelCol": "label_idx", "featuresCol": "features"}
    return {
        "rf": lambda: RandomForestClassifier(**common, numTrees=50, seed=seed),
        "decisiontree": lambda: DecisionTreeClassifier(**common, maxDepth=10, seed=seed),
        "logistic": lambda: LogisticRegression(**common, family="multinomial", maxIter=100),
        "xgb": lambda: OneVsRest(classifier=GBTClassifier(maxIter=boosting_rounds, maxDepth=3, stepSize=0.3, seed=seed), parallelism=3, **common),
    }[name]()


def cross_validate(rows: DataFrame, name: str, k: int, fold: str = "fold") -> DataFrame:
    """(fold, truth, predicted, key...) of every row, predicted by a model of the other folds. The rows are worked out once for all fits; folds are fitted at the same time."""
    data, labels = indexed(vectors(rows))
    kept = data.drop("vec").cache()
    models = at_once(lambda f: learner(name).fit(kept.filter(F.col(fold) != f)), range(k))
    kept.unpersist()
    out = None
    for f, model in enumerate(models):
        part = model.transform(data.filter(F.col(fold) == f)).select(*[c for c in rows.columns if c != "vec"], "prediction")
        out = part if out is None else out.union(part)
    return out.withColumn("predicted", F.get(F.array(*[F.lit(x) for x in labels.labels]), F.col("prediction").cast("int"))).withColumnRenamed("label", "truth").drop("prediction")


def tuned_forest(rows: DataFrame, k: int, draws: int = 10, fold: str = "fold", seed: int = 42) -> DataFrame:
    """Random search of a forest: (draw, parameters, weighted_f1) by falling score. Folds are those of the rows."""
    rng = random.Random(seed)
    data, _ = indexed(vectors(rows))
    data = data.drop("vec").cache()
    scorer = MulticlassClassificationEvaluator(labelCol="label_idx", metricName="f1")
    chosen = [{p: rng.choice(v) for p, v in FOREST_GRID.items()} for _ in range(draws)]

    def score_of(evaluation: tuple[int, int]) -> float:
        d, f = evaluation
        return scorer.evaluate(RandomForestClassifier(labelCol="label_idx", seed=seed, **chosen[d]).fit(data.filter(F.col(fold) != f)).transform(data.filter(F.col(fold) == f)))

    scores = np.reshape(at_once(score_of, [(d, f) for d in range(draws) for f in range(k)], 2), (draws, k))
    data.unpersist()
    found = [(d, str(sorted(chosen[d].items())), float(np.mean(scores[d]))) for d in range(draws)]
    return rows.sparkSession.createDataFrame(sorted(found, key=lambda x: (-x[2], x[0])), "draw int, parameters string, weighted_f1 double")


def svd(rows: DataFrame, n: int, vec: str = "vec") -> np.ndarray:
    """Right singular vectors (features x n) of the uncentred rows, largest first; each vector's largest entry is positive."""
    ship(rows.sparkSession)
    matrix = RowMatrix(rows.select(vec).rdd.map(lambda r: OldVectors.dense(r[0])))
    v = matrix.computeSVD(n).V.toArray()
    return v * np.sign(v[np.abs(v).argmax(axis=0), np.arange(v.shape[1])])


def project(rows: DataFrame, v: np.ndarray, vec: str = "vec") -> DataFrame:
    """Rows with `vec` projected on the columns of v, as one array expression of constants."""
    columns = [F.aggregate(F.zip_with(vec, F.array(*[F.lit(float(x)) for x in column]), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x) for column in v.T]
    return rows.withColumn(vec, F.array(*columns))


def fold_features(train: DataFrame, test: DataFrame, n_components, threshold_flag: bool, threshold_places: Sequence[int], vec: str = "vec") -> tuple[DataFrame, DataFrame, np.ndarray | None]:
    """Train and test rows as one configuration has them: threshold features only, or projected by an SVD of the training rows, or as they are."""
    if n_components == "all":
        if threshold_flag or not threshold_places:
            return train, test, None
        pick = F.array(*[F.get(vec, F.lit(i)) for i in threshold_places])
        return train.withColumn(vec, pick), test.withColumn(vec, pick), None
    from .benchmark import reduced
    from .reduce import ReduceFeatures

    v = svd(train, int(n_components), vec)
    return reduced(train, ReduceFeatures(None, v, vec)), reduced(test, ReduceFeatures(None, v, vec)), v


def ablation(rows: DataFrame, names: Sequence[str], k: int, step: int = 20, fold: str = "fold", seed: int = 42) -> DataFrame:
    """(top_n, accuracy): mean accuracy over folds of the top 1, 1 + step, ... features, ranked once on all rows."""
    rows = rows.cache()
    order = [list(names).index(r["feature"]) for r in forest_importance(rows, names, trees=50, seed=seed).collect()]

    def accuracy_of(n: int) -> tuple[int, float]:
        part = rows.withColumn("vec", F.array(*[F.get("vec", F.lit(i)) for i in order[:n]]))
        right = cross_validate(part, "rf", k, fold).groupBy(fold).agg(F.avg((F.col("truth") == F.col("predicted")).cast("double")).alias("a")).agg(F.avg("a")).first()[0]
        return n, float(right)

    found = at_once(accuracy_of, list(range(1, len(names), step)) if len(names) > 1 else [1], 2)
    rows.unpersist()
    return rows.sparkSession.createDataFrame(found, "top_n int, accuracy double")


def learning_curve(rows: DataFrame, ranks: DataFrame, counts: Sequence[int], group: str, test_groups: Sequence, label: str = "label", trees: int = 200) -> DataFrame:
    """(n_pools, test_group, accuracy): trained on the first n groups of each label without the test group."""
    data, labels = indexed(vectors(rows), label)
    ranked = data.join(F.broadcast(ranks.withColumn(label, F.col(label).cast("string"))), [label, group]).cache()
    found = []
    for n in counts:
        for g in test_groups:
            train = ranked.filter((F.col("pool_rank") <= n + 1) & (F.col(group) != g))
            test = ranked.filter(F.col(group) == g)
            a = RandomForestClassifier(labelCol="label_idx", numTrees=trees, seed=1).fit(train).transform(test).agg(F.avg((F.col("prediction") == F.col("label_idx")).cast("double"))).first()[0]
            found.append((int(n), str(g), None if a is None else float(a)))
    ranked.unpersist()
    return rows.sparkSession.createDataFrame(found, "n_pools int, test_group string, accuracy double")


def benchmark_plan(repetitions: int, configurations: Sequence[tuple], folds: int, models: Sequence[str]) -> Iterator[tuple]:
    """Every evaluation of a benchmark, in order: (repetition, count, flag, setting, fold, model)."""
    return ((r, *c, f, m) for r in range(repetitions) for c in configurations for f in range(folds) for m in models)


def benchmark(rows: DataFrame, configurations: Sequence[tuple], models: Sequence[str], k: int, repetitions: int = 1, threshold_places: Sequence[int] = (), tag: str = "all", path: str | None = None, fold: str = "fold") -> DataFrame:
    """Result rows of a benchmark by rising accuracy, kept at `path` evaluation by evaluation; without a path, in a scratch folder of this run's own."""
    from ..scratch import scratch_root
    from .benchmark import run

    path = path or f"{scratch_root(rows.sparkSession)}/benchmark-{uuid.uuid4().hex}"
    return run(rows, configurations, models, k, path, repetitions, threshold_places, tag, fold=fold).orderBy("accuracy", "repetition", "component_setting", "thr_features", "fold", "model")


def forest_parameters(told: str) -> dict:
    """The parameters of a forest as `tuned_forest` tells them."""
    return dict(ast.literal_eval(told))


def save_model(model, names: Sequence[str], labels: Sequence[str], path: str, spark, **meta) -> None:
    """A fitted model, or a pipeline of a `ReduceFeatures` and one, and its metadata side by side: <path>/model and <path>/meta."""
    pipeline = model if isinstance(model, PipelineModel) else PipelineModel([model])
    pipeline.write().overwrite().save(f"{path}/model")
    kinds = {"n_components": "string", "thr_features": "boolean", "thr_indices": "array<int>", "filter_mode": "string", "model_name": "string", "cv_accuracy": "double", "best_params": "string", "best_cv_score": "double"}
    schema = ", ".join(["feature_names array<string>", "labels array<string>", *[f"{c} {t}" for c, t in kinds.items()]])
    spark.createDataFrame([(list(names), list(labels), *[meta.get(c) for c in kinds])], schema).write.mode("overwrite").parquet(f"{path}/meta")


def model_meta(path: str, spark) -> Row | None:
    """The metadata saved beside a model, or None if it has none."""
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/meta")
    if not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        return None
    return spark.read.parquet(f"{path}/meta").first()


def load_model(path: str, spark) -> tuple[PipelineModel, list[str] | None, list[str] | None]:
    """(pipeline, feature names, labels); a model without metadata still loads, its names and labels are None."""
    meta = model_meta(path, spark)
    return PipelineModel.load(f"{path}/model"), *((None, None) if meta is None else (meta["feature_names"], meta["labels"]))


def _width(pipeline: PipelineModel) -> int | None:
    """Entries a vector must have for a model, as far as it tells."""
    first, last = pipeline.stages[0], pipeline.stages[-1]
    n = first.takes() if hasattr(first, "takes") else None
    picks = hasattr(first, "places") and (first.places is not None or first.matrix is not None)
    return n if picks else getattr(last, "numFeatures", None)


def score(aligned: DataFrame, path: str, key: str = "sample_name") -> DataFrame:
    """(key, predicted, confidence, probabilities) of aligned long rows (key, feature, position, value) by a saved model.

    A row the model can't take (too few or too many entries, an empty one, one that is no number) gets ERROR, 0.0 and no probabilities; the
    others stay as they are. Labels of a model without metadata are `class_<number>`.
    """
    spark = aligned.sparkSession
    pipeline, names, labels = load_model(path, spark)
    rows = aligned.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "value"))), lambda x: x["value"]).alias("vec"))
    width = len(names) if names else _width(pipeline)
    fits = ~F.exists("vec", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    fits = F.coalesce(fits if width is None else fits & (F.size("vec") == width), F.lit(False))
    # rows that don't fit are scored as zeros and marked, so that one of them ends no task
    zeros = F.array_repeat(F.lit(0.0), width) if width else F.transform("vec", lambda v: F.lit(0.0))
    safe = rows.withColumn("_fits", fits).withColumn("vec", F.when(F.col("_fits"), F.col("vec")).otherwise(zeros))
    reduces = hasattr(pipeline.stages[0], "places")
    done = pipeline.transform(safe if reduces else vectors(safe)).withColumn("probabilities", F.when(F.col("_fits"), vector_to_array("probability")))
    code = F.col("prediction").cast("int")
    known = F.get(F.array(*[F.lit(x) for x in labels]), code) if labels else F.lit(None).cast("string")
    label = F.when(F.col("_fits"), F.coalesce(known, F.concat(F.lit("class_"), code.cast("string")))).otherwise("ERROR")
    return done.select(key, label.alias("predicted"), F.when(F.col("_fits"), F.array_max("probabilities")).otherwise(0.0).alias("confidence"), "probabilities")


def linkage(distances: np.ndarray, method: str = "average") -> list[tuple[int, int, float, int]]:
    """Hierarchical clustering of a small distance matrix by Lance-Williams updates: (left, right, height, size), nodes numbered from n on."""
    d = distances.astype(float).copy()
    if method == "median":
        d **= 2
    n = len(d)
    np.fill_diagonal(d, np.inf)
    alive, size, node, out = list(range(n)), dict.fromkeys(range(n), 1), {i: i for i in range(n)}, []
    for step in range(n - 1):
        sub = d[np.ix_(alive, alive)]
        i, j = divmod(int(sub.argmin()), len(alive))
        a, b = sorted((alive[i], alive[j]))
        height = d[a, b]
        for c in alive:
            if c in (a, b):
                continue
            x, y = d[a, c], d[b, c]
            new = {"single": min(x, y), "complete": max(x, y), "weighted": (x + y) / 2, "average": (size[a] * x + size[b] * y) / (size[a] + size[b]), "median": x / 2 + y / 2 - height / 4}[method]
            d[a, c] = d[c, a] = new
        out.append((*sorted((node[a], node[b])), float(np.sqrt(height) if method == "median" else height), size[a] + size[b]))
        size[a] += size[b]
        node[a] = n + step
        alive.remove(b)
    return out


def path_margins(model, rows: DataFrame, vec: str = "vec") -> DataFrame:
    """Sum of |value - threshold| along every tree's decision path, in all and per feature: `total`, `by_feature` array<double>.

    The trees are sent to the workers once; rows stay where they are.
    """
    ship(rows.sparkSession)
    trees = [_nodes(t) for t in model.trees]
    n = model.numFeatures
    held = rows.sparkSession.sparkContext.broadcast(trees)

    @F.pandas_udf("array<double>")
    def margins(column):
        import pandas as pd

        out = []
        for value in column:
            sums = np.zeros(n)
            for tree in held.value:
                at = 0
                while tree[at] is not None:
                    feature, threshold, left, right = tree[at]
                    sums[feature] += abs(value[feature] - threshold)
                    at = left if value[feature] <= threshold else right
            out.append(sums)
        return pd.Series(out)

    return rows.withColumn("by_feature", margins(F.col(vec))).withColumn("total", F.aggregate("by_feature", F.lit(0.0), lambda a, v: a + v))


def _nodes(tree) -> list:
    """Nodes of a tree as (feature, threshold, left, right), None for leaves."""
    out: list = []

    def walk(node) -> int:
        me = len(out)
        out.append(None)
        if node.getClass().getSimpleName() == "InternalNode":
            split = node.split()
            left = walk(node.leftChild())
            right = walk(node.rightChild())
            out[me] = (int(split.featureIndex()), float(split.threshold()), left, right)
        return me

    walk(tree._java_obj.rootNode() if hasattr(tree._java_obj, "rootNode") else tree._call_java("rootNode"))
    return out


def score_models(aligned: DataFrame, paths: dict[str, str], key: str = "sample_name") -> DataFrame:
    """One row per sample with `<model>_prediction` and `<model>_confidence`; a model that can't be read or applied gives ERROR and 0.0."""
    out = aligned.select(key).distinct()
    for name, path in paths.items():
        try:
            found = score(aligned, path, key).select(key, F.col("predicted").alias(f"{name}_prediction"), F.col("confidence").alias(f"{name}_confidence"))
            out = out.join(found, key, "left")
        except Exception:  # the other models' columns must not be lost with this one
            out = out.withColumn(f"{name}_prediction", F.lit("ERROR")).withColumn(f"{name}_confidence", F.lit(0.0))
    return out
