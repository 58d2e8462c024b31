"""Feature tables: ten exact statistics per sample, reshaping, filters, encodings.

The long form (sample_name, feature, value) is the form all operators work on; wide tables are made at the edges only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STATISTICS = ["median", "min", "max", "mean", "q10", "q25", "q75", "q90", "std", "var"]


def statistics_of(v: Column) -> list[Column]:
    """The ten statistics of a value column; NaN is skipped, infinities aren't, quantiles interpolate linearly, ddof is 1."""
    x = F.nanvl(v.cast("double"), F.lit(None).cast("double"))
    q = F.percentile(x, F.array(*[F.lit(p) for p in (0.5, 0.1, 0.25, 0.75, 0.9)]))
    at = lambda i: F.get(q, F.lit(i))
    return [at(0).alias("median"), F.min(x).alias("min"), F.max(x).alias("max"), F.avg(x).alias("mean"), at(1).alias("q10"), at(2).alias("q25"), at(3).alias("q75"), at(4).alias("q90"), F.stddev_samp(x).alias("std"), F.var_samp(x).alias("var")]


def ten_statistics(long: DataFrame, keys: Sequence[str] = ("sample_name", "feature"), value: str = "value") -> DataFrame:
    """One shuffle for all ten: one row per key, one column per statistic."""
    return long.groupBy(*keys).agg(*statistics_of(F.col(value)))


def melt(wide: DataFrame, keys: Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    """Wide to long: (keys, feature, value double)."""
    columns = [c for c in wide.columns if c not in keys] if columns is None else list(columns)
    return wide.select(*keys, *[F.col(f"`{c}`").cast("double").alias(c) for c in columns]).unpivot(list(keys), [F.col(f"`{c}`") for c in columns], "feature", "value")


def pivot(long: DataFrame, features: Sequence[str], key: str = "sample_name") -> DataFrame:
    """Long to wide with the features named in advance; two values for one cell are an error."""
    once = F.when(F.count("value") > 1, F.raise_error(F.lit("more than one value for a cell"))).otherwise(F.first("value"))
    return long.groupBy(key).pivot("feature", list(features)).agg(once)


def statistic_rows(stats: DataFrame, keys: Sequence[str] = ("sample_name", "feature")) -> DataFrame:
    """Statistics as rows: (keys without feature, feature `<feature>-<statistic>`, value)."""
    rest = [k for k in keys if k != "feature"]
    rows = stats.unpivot(list(keys), STATISTICS, "statistic", "value")
    return rows.select(*rest, F.concat_ws("-", "feature", "statistic").alias("feature"), "value")


def drop_artifacts(frame: DataFrame) -> tuple[DataFrame, list[str]]:
    """Without columns left by exported indexes, and their names."""
    gone = [c for c in frame.columns if c.startswith("Unnamed:")]
    return frame.select(*[F.col(f"`{c}`") for c in frame.columns if c not in gone]), gone


# fixed values: columns of a feature table that are no features
METADATA = ("label", "date", "sampleName", "sample_name", "noPos")


def feature_columns(frame: DataFrame, target: str | None = None) -> list[str]:
    """Columns that are features: neither the target, nor about the sample, nor left by an exported index."""
    return [c for c in frame.columns if c not in METADATA and c != target and not c.startswith("Unnamed:")]


def without_counts(long: DataFrame) -> DataFrame:
    """Without features made of counts: the second pass of a benchmark."""
    return long.filter(~F.contains("feature", F.lit("counts")))


def drop_artifact_rows(long: DataFrame) -> DataFrame:
    return long.filter(~F.startswith("feature", F.lit("Unnamed:")))


def keep_measured(long: DataFrame, n_features: int, key: str = "sample_name", limit: float = 0.8) -> DataFrame:
    """Rows of samples of which less than `limit` of the cells are empty; the label counts as a cell."""
    empty = F.sum(F.when(F.col("value").isNull() | F.isnan("value"), 1).otherwise(0)).over(Window.partitionBy(key))
    held = F.count("*").over(Window.partitionBy(key))
    return long.withColumn("_gone", (empty + (n_features - held)) / F.lit(n_features + 1.0)).filter(F.col("_gone") < limit).drop("_gone")


def union_ragged(*frames: DataFrame) -> DataFrame:
    """UNION ALL by name; columns a frame lacks are null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def first_rows(frame: DataFrame, by: Sequence[str], order: Sequence[str | Column], most: int = 100_000) -> DataFrame:
    """At most `most` rows of each file or group, in the order given."""
    n = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return frame.withColumn("_n", n).filter(F.col("_n") <= most).drop("_n")


def label_codes(frame: DataFrame, label: str) -> DataFrame:
    """Sorted distinct labels numbered from 0: few rows, joined back by broadcast."""
    codes = frame.select(label).filter(F.col(label).isNotNull()).distinct().withColumn("code", (F.row_number().over(Window.orderBy(label)) - 1).cast("int"))
    return frame.join(F.broadcast(codes), label)


def one_hot(frame: DataFrame, column: str, values: Sequence[str]) -> DataFrame:
    """One 0/1 column `<column>_<value>` per value in place of the column."""
    dummies = [F.when(F.col(column) == v, 1).otherwise(0).alias(f"{column}_{v}") for v in values]
    return frame.select(*[F.col(f"`{c}`") for c in frame.columns if c != column], *dummies)


def one_hot_where_useful(frame: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One-hot columns for text columns with fewer values than rows; other text columns go. One pass counts, one lists the values kept."""
    counts = frame.agg(F.count("*").alias("_rows"), *[F.countDistinct(c).alias(c) for c in columns]).first()
    for c in columns:
        if counts[c] < counts["_rows"]:
            values = [r[0] for r in frame.select(c).filter(F.col(c).isNotNull()).distinct().orderBy(c).collect()]
            frame = one_hot(frame, c, values)
        else:
            frame = frame.drop(c)
    return frame


def replicate(frame: DataFrame, times: int) -> DataFrame:
    """Every row `times` times, numbered from 1."""
    return frame.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(times))))


def align(long: DataFrame, expected: DataFrame, key: str = "sample_name") -> DataFrame:
    """Scores of exactly the expected features for every sample: missing ones 0, others dropped. `expected` is a model's list of features."""
    samples = long.select(key).distinct()
    wanted = samples.join(F.broadcast(expected.select("feature", "position")), how="cross")
    return wanted.join(long.select(key, "feature", "value"), [key, "feature"], "left").select(key, "feature", "position", F.coalesce("value", F.lit(0.0)).alias("value"))
