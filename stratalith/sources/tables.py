"""Measurement files in and out: tab-separated tables, per-image namespace files, JSON reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names as N
from ..operators import features as A


def read_tsv(spark: SparkSession, path: str, schema: str | None = None, sep: str = "\t") -> DataFrame:
    """A table with a header. Infinities are read as numbers; give the schema where it is known, inference reads the data twice."""
    reader = spark.read.options(sep=sep, header=True, positiveInf="inf", negativeInf="-inf", nanValue="nan")
    return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)


def header(spark: SparkSession, path: str, sep: str = "\t") -> list[str]:
    """Column names only: one line is read."""
    return spark.read.options(sep=sep, header=True).csv(path).schema.fieldNames()


def read_namespace(spark: SparkSession, path: str, namespace: str, schema: str | None = None, most: int = 100_000) -> DataFrame:
    """All per-image files of one namespace below `path`, as one table with `sampleName`; at most `most` rows a file, in file order."""
    rows = read_tsv(spark, path, schema).select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"))
    mine = rows.filter(N.namespace_of(F.col("_file")) == namespace)
    counted = mine.withColumn("_row", F.monotonically_increasing_id())
    capped = A.first_rows(counted, ["_file"], ["_block", "_row"], most)
    base = F.substring_index("_file", "/", -1)
    return capped.withColumn("sampleName", N.sample_from_file(base)).drop("_file", "_block", "_row")


def read_traits(spark: SparkSession, path: str) -> DataFrame:
    """A comma-separated table of + and - as 1 and 0; other cells stay."""
    rows = spark.read.options(header=True).csv(path)
    return rows.select(*[F.when(F.col(f"`{c}`") == "+", "1").when(F.col(f"`{c}`") == "-", "0").otherwise(F.col(f"`{c}`")).alias(c) for c in rows.columns])


def read_split(spark: SparkSession, path: str, samples: DataFrame, sep: str = "\t") -> DataFrame:
    """(example, part) with part tr or te; an unknown example or part is an error."""
    rows = spark.read.options(header=True, sep=sep).csv(path).toDF("example", "part")
    unknown = [r[0] for r in rows.join(samples.select(F.col("sample_name").alias("example")), "example", "left_anti").limit(5).collect()]
    if unknown:
        raise ValueError(f"unknown examples: {unknown}")
    if not rows.filter(~F.coalesce(F.col("part").isin("tr", "te"), F.lit(False))).isEmpty():
        raise ValueError("a part is neither tr nor te")
    return rows


def write_tsv(frame: DataFrame, path: str, sep: str = "\t") -> None:
    """Parts of a table with headers; infinities and NaN as text."""
    texts = [F.when(F.isnan(F.col(f"`{c}`")), "nan").when(F.col(f"`{c}`") == float("inf"), "inf").when(F.col(f"`{c}`") == float("-inf"), "-inf").otherwise(F.col(f"`{c}`").cast("string")).alias(c) if t in ("double", "float") else F.col(f"`{c}`") for c, t in frame.dtypes]
    frame.select(*texts).write.mode("overwrite").options(sep=sep, header=True).csv(path)


def write_report(frame: DataFrame, path: str) -> None:
    """Rows as JSON lines, nulls kept."""
    frame.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def union_files(frames: Sequence[DataFrame]) -> DataFrame:
    return A.union_ragged(*frames)
