"""Result tables: accuracy, confusion, F1, configurations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names as N


def accuracy(predictions: DataFrame, *by: str) -> DataFrame:
    """Share of right predictions and their number, per group."""
    return predictions.groupBy(*by).agg(F.avg((F.col("truth") == F.col("predicted")).cast("double")).alias("accuracy"), F.count("*").alias("n"))


def confusion(predictions: DataFrame) -> DataFrame:
    """Dense: every pair of labels seen as truth or prediction, 0 where none fell. The labels are few; predictions are counted first."""
    counts = predictions.groupBy("truth", "predicted").agg(F.count("*").alias("n"))
    labels = counts.select(F.col("truth").alias("l")).union(counts.select("predicted")).distinct()
    pairs = labels.select(F.col("l").alias("truth")).join(F.broadcast(labels.select(F.col("l").alias("predicted"))), how="cross")
    return pairs.join(counts, ["truth", "predicted"], "left").select("truth", "predicted", F.coalesce("n", F.lit(0)).alias("n"))


def normalised_confusion(matrix: DataFrame) -> DataFrame:
    """Each row of a confusion matrix as shares; a row without samples is 0."""
    total = F.sum("n").over(Window.partitionBy("truth"))
    return matrix.withColumn("share", F.coalesce(F.try_divide(F.col("n"), total), F.lit(0.0))).drop("n")


def trace_accuracy(matrix: DataFrame) -> DataFrame:
    return matrix.agg(F.try_divide(F.sum(F.when(F.col("truth") == F.col("predicted"), F.col("n"))), F.sum("n")).alias("accuracy"))


def weighted_f1(matrix: DataFrame) -> DataFrame:
    """F1 of each class weighted by its support."""
    hit = F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(0)
    truth = matrix.groupBy(F.col("truth").alias("l")).agg(F.sum("n").alias("support"), F.sum(hit).alias("tp"))
    seen = matrix.groupBy(F.col("predicted").alias("l")).agg(F.sum("n").alias("seen"))
    f1 = F.coalesce(F.try_divide(2 * F.col("tp"), F.col("support") + F.col("seen")), F.lit(0.0))
    return truth.join(seen, "l").agg(F.try_divide(F.sum(f1 * F.col("support")), F.sum("support")).alias("weighted_f1"))


def explode_lists(results: DataFrame, truth: str = "test_set", predicted: str = "predicted_set", sep: str = ",") -> DataFrame:
    """Comma-joined truths and predictions as rows; results whose lists differ in length, or without predictions, are left out."""
    a, b = F.split(F.col(truth), sep), F.split(F.col(predicted), sep)
    used = results.filter((F.length(F.coalesce(predicted, F.lit(""))) > 0) & (F.size(a) == F.size(b)))
    rest = [c for c in results.columns if c not in (truth, predicted)]
    return used.select(*rest, F.posexplode(F.arrays_zip(a.alias("truth"), b.alias("predicted"))).alias("position", "p")).select(*rest, "position", F.col("p.truth").alias("truth"), F.col("p.predicted").alias("predicted"))


def join_lists(predictions: DataFrame, by: list[str], order: str) -> DataFrame:
    """Truths and predictions of each group, in order, as comma-joined lists: a result table's rows."""
    rows = F.array_sort(F.collect_list(F.struct(order, "truth", "predicted")))
    return predictions.groupBy(*by).agg(rows.alias("r")).select(*by, F.array_join(F.transform("r", lambda x: x["truth"]), ",").alias("test_set"), F.array_join(F.transform("r", lambda x: x["predicted"]), ",").alias("predicted_set"))


def mean_by_configuration(results: DataFrame) -> DataFrame:
    """Mean accuracy, its deviation and the normal 95 % interval of the mean, per model and configuration."""
    half = 1.96 * F.stddev_samp("accuracy") / F.sqrt(F.count("*"))
    return results.groupBy("model", "configuration").agg(F.avg("accuracy").alias("mean"), F.stddev_samp("accuracy").alias("std"), (F.avg("accuracy") - half).alias("low"), (F.avg("accuracy") + half).alias("high"), F.count("*").alias("n"))


def best_configuration(results: DataFrame) -> DataFrame:
    """Per model: all columns with the threshold flag if it was run, else the best mean accuracy; ties by components, then flag."""
    means = results.groupBy("model", "n_components", "thr_features").agg(F.avg("accuracy").alias("mean_accuracy"))
    first = (F.col("n_components") == "all") & F.col("thr_features")
    n = F.row_number().over(Window.partitionBy("model").orderBy(F.when(first, 0).otherwise(1), F.desc(F.round("mean_accuracy", 12)), "n_components", "thr_features"))
    return means.withColumn("r", n).filter("r = 1").drop("r")


def preferred_configuration(results: DataFrame) -> DataFrame:
    """Per model, the rows of the configuration to report: an explicit setting of all columns, else the threshold flag, else `all`, else most components."""
    setting = F.lower(F.coalesce("component_setting", F.lit("")))
    components = F.lower(F.trim("n_components"))
    flag = F.lower(F.trim("thr_features")).isin("true", "1", "yes")
    numeric = F.when(F.rlike(components, F.lit(r"^\d+$")), components.try_cast("double"))
    by = Window.partitionBy("model")
    ranked = results.withColumn("_explicit", setting.isin("all", "all_columns")).withColumn("_any_explicit", F.bool_or("_explicit").over(by))
    step1 = ranked.filter(~F.col("_any_explicit") | F.col("_explicit"))
    step2 = step1.withColumn("_flag", flag).withColumn("_any_flag", F.bool_or("_flag").over(by)).filter(F.col("_any_explicit") | ~F.col("_any_flag") | F.col("_flag"))
    step3 = step2.withColumn("_all", components == "all").withColumn("_any_all", F.bool_or("_all").over(by)).withColumn("_n", numeric).withColumn("_top", F.max("_n").over(by))
    kept = step3.filter(F.col("_any_explicit") | F.when(F.col("_any_all"), F.col("_all")).otherwise(F.col("_top").isNull() | (F.col("_n") == F.col("_top"))))
    return kept.select(*results.columns)


def majority(rows: DataFrame, label: str = "label", fold: str = "fold") -> DataFrame:
    """Per fold, the most frequent label of all other folds (ties: the smallest) and its accuracy in the fold."""
    counts = rows.groupBy(fold, label).count()
    totals = counts.groupBy(label).agg(F.sum("count").alias("all"))
    folds = counts.select(fold).distinct()
    # folds and labels are few: every pair of them, after counting
    grid = folds.join(F.broadcast(totals), how="cross").join(counts, [fold, label], "left").withColumn("here", F.coalesce("count", F.lit(0)))
    train = grid.withColumn("train", F.col("all") - F.col("here"))
    r = F.row_number().over(Window.partitionBy(fold).orderBy(F.desc("train"), label))
    size = F.sum("here").over(Window.partitionBy(fold))
    return train.withColumn("r", r).withColumn("size", size).filter("r = 1").select(fold, F.col(label).alias("majority"), F.try_divide(F.col("here"), F.col("size")).alias("accuracy"))


def pending(planned: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Evaluations of the plan without a result."""
    return planned.join(done.select(*keys), keys, "left_anti")


def with_configuration(results: DataFrame) -> DataFrame:
    """Results with `configuration`, `configuration_name` and `learner` from current or legacy columns."""
    key = N.configuration_key(F.col("component_setting"), F.col("n_components"), F.col("thr_features"))
    return results.withColumn("configuration", key).withColumn("configuration_name", N.configuration_display(F.col("configuration"))).withColumn("learner", N.canonical_learner(F.col("model")))


def configuration_grid(component_counts: list, n_features: int, n_thresholds: int) -> list[tuple]:
    """(count or "all", threshold flag, setting) in order; counts over the number of features are skipped, both flags are run for each."""
    usable = [n for n in component_counts if n == "all" or n <= n_features]
    names = {True: "all_columns", False: "threshold_only" if n_thresholds else "all_columns"}
    return [(n, flag, names[flag] if n == "all" else f"svd_{n}") for n in usable for flag in (True, False)]
