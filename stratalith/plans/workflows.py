"""The workflows users run: features from stacks, training, inference. Each is one Spark plan per stage, with Parquet between stages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numbers as X
from ..operators import benchmark as B
from ..operators import evaluate as V
from ..operators import features as A
from ..operators import folds as S
from ..operators import models as M
from ..operators import quality as Q
from ..operators import stack_measures as K
from ..scratch import kept
from ..sources import stacks as T


def generate_features(spark: SparkSession, images: str, voxel: tuple[float, float, float] = X.VOXEL, part_bytes: int = 64 << 20) -> DataFrame:
    """Stacks below `images` to the long feature table (sample_name, feature, value) under the published names.

    A file is decoded once, by as many tasks as it has shares of `part_bytes`; only of stacks that several tasks share, or that are too large to be
    held, layers are read again for the transitions.
    """
    x, y, z = X.voxel_dimensions(*voxel)
    layers = T.read_stacks(spark, images, part_bytes)
    measured = kept(K.measure(layers, x * y * z), "measured")
    tops = K.open_stacks(measured)
    return K.feature_rows(measured, x * y * z, None if tops.isEmpty() else K.transitions(layers, tops))


def train(rows: DataFrame, names: Sequence[str], target: str, k: int = 3, ci: bool = False, learner: str = "rf", draws: int = 0, filter_mode: str = "all") -> DataFrame:
    """Benchmark of labelled vectors (key, label, vec); the best configuration's learner, a forest tuned by a random search, is fitted on all rows and saved at `target`.

    Whatever configuration is best can be saved: what it takes of a vector is saved with it. The benchmark keeps each evaluation below `target`, so a
    stopped run goes on there; `draws` tunes forests inside each evaluation too. Returns the result table.
    """
    config = M.runtime_config(ci)
    used = Q.drop_unlabelled(rows)
    k = min(k, S.require_k(used, "label"))
    key = next(c for c in rows.columns if c not in ("label", "vec"))
    folded = S.stratified_folds(used, "label", key, k)
    thresholds = [i for i, n in enumerate(names) if "Threshold" in n]
    plan = V.configuration_grid(config["components"], len(names), len(thresholds))
    results = B.run(folded, plan, ["dummy", learner], k, f"{target}/benchmark", config["repetitions"], thresholds, filter_mode, draws, key)
    B.final_model(used.select(key, "label", "vec"), names, results, learner, target, thresholds, config["draws"], k, filter_mode=filter_mode)
    return results


def infer(long: DataFrame, model: str) -> DataFrame:
    """Predictions of a saved model for the long feature table of new samples; cells are imputed as the batch has them."""
    spark = long.sparkSession
    _, names, _ = M.load_model(model, spark)
    expected = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "feature string, position int")
    clean = long.withColumn("value", X.last_resort(X.impute(F.col("value"), "feature")))
    return M.score(A.align(clean, expected), model)
