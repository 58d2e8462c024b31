"""Explanations and summaries of predictions."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shipping import ship


def linear_attributions(long: DataFrame, weights: DataFrame) -> DataFrame:
    """Exact attributions of a linear model: weight * (value - mean of the feature). `weights` (feature, weight) is a model's."""
    mean = F.avg("value").over(Window.partitionBy("feature"))
    return long.join(F.broadcast(weights), "feature").withColumn("attribution", F.col("weight") * (F.col("value") - mean))


def mean_absolute(attributions: DataFrame) -> DataFrame:
    """(feature, importance): mean absolute attribution."""
    return attributions.groupBy("feature").agg(F.avg(F.abs("attribution")).alias("importance"))


def summary(predictions: DataFrame) -> DataFrame:
    """Per model: predictions and distinct labels among them."""
    return predictions.groupBy("model").agg(F.count("*").alias("n_predictions"), F.countDistinct("predicted").alias("n_unique"))


def confidence(scores: DataFrame, by: str = "sample_name") -> DataFrame:
    """The label with the highest probability and that probability (ties: the smaller label)."""
    r = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("probability"), "label"))
    return scores.withColumn("r", r).filter("r = 1").select(by, F.col("label").alias("predicted"), F.col("probability").alias("confidence"))


def named_classes(predictions: DataFrame, mapping: DataFrame) -> DataFrame:
    """Class index to class name; `class_<i>` where the mapping has none. `mapping` (index, name) is a model's."""
    return predictions.join(F.broadcast(mapping), "index", "left").withColumn("name", F.coalesce("name", F.concat(F.lit("class_"), F.col("index").cast("string"))))


def feature_differences(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Features of a model that a table lacks, and those it has in excess."""
    missing = expected.join(actual, "feature", "left_anti").withColumn("kind", F.lit("missing"))
    extra = actual.join(expected, "feature", "left_anti").withColumn("kind", F.lit("extra"))
    return missing.union(extra)


def importance_by_column(importances: DataFrame) -> DataFrame:
    """Importances of one-hot columns `<column>_<value>` summed to their column."""
    return importances.groupBy("original").agg(F.sum("importance").alias("importance"))


def progress_fraction(events: DataFrame) -> DataFrame:
    """Overall progress of a run in percent: (phase_index - 1 + min(1, completed / total)) / phase_total."""
    part = F.least(F.lit(1.0), F.try_divide(F.col("completed"), F.col("total")))
    return events.withColumn("percent", 100 * (F.col("phase_index") - 1 + part) / F.col("phase_total"))


class Tree:
    """A decision tree as leaves: probability vector, and for every feature on the way to it the interval it needs and the share of cover that takes the way anyway."""

    def __init__(self, root):
        self.leaves: list[tuple[list[float], dict[int, tuple[float, float, float]]]] = []
        self._walk(root, {})

    def _walk(self, node, path: dict[int, tuple[float, float, float]]) -> None:
        if node.getClass().getSimpleName() == "LeafNode":
            stats = list(node.impurityStats().stats())
            total = sum(stats) or 1.0
            self.leaves.append(([s / total for s in stats], path))
            return
        split = node.split()
        feature, threshold, cover = int(split.featureIndex()), float(split.threshold()), float(node.impurityStats().count())
        low, high, share = path.get(feature, (float("-inf"), float("inf"), 1.0))
        for child, span in ((node.leftChild(), (low, min(high, threshold))), (node.rightChild(), (max(low, threshold), high))):
            part = float(child.impurityStats().count()) / cover if cover else 0.0
            self._walk(child, {**path, feature: (*span, share * part)})

    def attributions(self, x: np.ndarray, label: int) -> tuple[float, np.ndarray]:
        """Expected probability of `label`, and exact Shapley values (rows x features) of what the features add.

        For a leaf with m features on its way, the value of a coalition is a product of one factor a feature: 1 or 0 as the row
        goes that way if the feature is known, else the share of cover. Sums over coalitions by size are coefficients of a
        product of linear factors, so a leaf costs m^2 operations a row, vectorised over rows.
        """
        base, out = 0.0, np.zeros_like(x)
        for probabilities, path in self.leaves:
            v, m = probabilities[label], len(path)
            shares = np.array([s for _, _, s in path.values()])
            base += v * float(shares.prod())
            if not v:
                continue
            known = np.stack([(x[:, f] > lo) & (x[:, f] <= hi) for f, (lo, hi, _) in path.items()], axis=1).astype(float) if m else np.ones((len(x), 0))
            weights = np.array([math.factorial(s) * math.factorial(m - s - 1) / math.factorial(m) for s in range(m)])
            for j, f in enumerate(path):
                poly = np.zeros((len(x), m))
                poly[:, 0] = 1.0
                for k in range(m):
                    if k != j:
                        shifted = np.concatenate([np.zeros((len(x), 1)), poly[:, :-1]], axis=1)
                        poly = poly * shares[k] + shifted * known[:, k : k + 1]
                out[:, f] += v * (known[:, j] - shares[j]) * (poly @ weights)
        return base, out


def tree_attributions(model, rows: DataFrame, label: int = 0, vec: str = "vec") -> DataFrame:
    """`rows` with `base_value` and `attributions` array<double>: exact path-dependent Shapley values of a forest's probability of label number `label`.

    base_value + the sum of attributions is the forest's probability. Trees go to the workers once; rows stay where they are.
    """
    ship(rows.sparkSession)
    trees = [Tree(t._call_java("rootNode")) for t in (model.trees if hasattr(model, "trees") else [model])]
    held = rows.sparkSession.sparkContext.broadcast(trees)

    @F.pandas_udf("struct<base_value:double,attributions:array<double>>")
    def shapley(column: pd.Series) -> pd.DataFrame:
        x = np.stack(column.to_list()).astype(float)
        found = [t.attributions(x, label) for t in held.value]
        total = sum(a for _, a in found) / len(found)
        return pd.DataFrame({"base_value": [sum(b for b, _ in found) / len(found)] * len(x), "attributions": list(total)})

    done = rows.withColumn("_s", shapley(F.col(vec)))
    return done.select(*rows.columns, "_s.base_value", "_s.attributions")
