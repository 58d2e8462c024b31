"""Reports on names and tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import names as N
from ..functions import numbers as X


def image_names(files: DataFrame, column: str, show: int = 100) -> DataFrame:
    """Valid names counted by year and label, and the first invalid ones. The list kept per group is bounded: each task and the total keep `show` names."""
    base = N.stem(F.col(column))
    ok = N.is_image_name(base)
    rows = files.select(base.alias("b"), ok.alias("ok"))
    counts = rows.groupBy(F.when(F.col("ok"), F.substring(N.image_field(F.col("b"), "date"), 5, 4)).alias("year"), F.when(F.col("ok"), N.image_field(F.col("b"), "label")).alias("label"), "ok").agg(F.count("*").alias("n"))
    first = rows.filter(~F.col("ok")).orderBy("b").limit(show).agg(F.array_join(F.array_sort(F.collect_list("b")), ",").alias("first_invalid"))
    return counts.join(F.broadcast(first), how="cross").select("year", "label", "ok", "n", F.when(~F.col("ok"), F.col("first_invalid")).alias("first_invalid"))


def cell_report(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Empty, infinite and unreadable cells of text columns: one pass, one row per column."""
    long = rows.select(*columns).unpivot([], list(columns), "feature", "value")
    empty = F.col("value").isNull() | (F.trim("value") == "")
    number = X.as_number(F.col("value"))
    return long.groupBy("feature").agg(F.count_if(empty).alias("empty_cells"), F.count_if(F.abs(number) == X.INF).alias("infinite_cells"), F.count_if(~empty & number.isNull()).alias("bad_cells"))


def duplicates(rows: DataFrame, keys: Sequence[str], label: str) -> DataFrame:
    """Rows that share their keys with another, and rows without a usable label."""
    counted = rows.groupBy(*keys).count()
    return counted.agg(F.coalesce(F.sum(F.when(F.col("count") > 1, F.col("count"))), F.lit(0)).alias("duplicate_rows"), F.coalesce(F.sum(F.when(~N.has_label(F.col(label)), F.col("count"))), F.lit(0)).alias("unlabelled_rows"))


def drop_unlabelled(frame: DataFrame, label: str = "label") -> DataFrame:
    """Without rows whose label is null or the word missing."""
    return frame.filter(F.col(label).isNotNull() & (F.lower(F.trim(F.col(label).cast("string"))) != "missing"))


def require_labels(frame: DataFrame, label: str = "label", key: str = "sample_name") -> DataFrame:
    """`frame`, or an error that names up to ten rows without a label and how many there are."""
    bad = frame.filter(F.col(label).isNull() | (F.lower(F.trim(F.col(label).cast("string"))) == "missing"))
    some = [r[0] for r in bad.select(key).limit(10).collect()]
    if some:
        raise ValueError(f"{bad.count()} rows have no label: {', '.join(map(str, some))}")
    return frame


def require_columns(frame: DataFrame, columns: Sequence[str], name: str = "table") -> DataFrame:
    missing = [c for c in columns if c not in frame.columns]
    if missing:
        raise ValueError(f"{name}: missing columns {missing}")
    return frame
