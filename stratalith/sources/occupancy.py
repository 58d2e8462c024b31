"""Occupancy profiles in text: blocks that begin with an image name and hold a distance and a percent line with decimal commas."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..shipping import ship


def _numbers(line: Column) -> Column:
    return F.transform(F.slice(F.split(line, "\t"), 3, 1 << 20), lambda x: F.replace(x, F.lit(","), F.lit(".")).try_cast("double"))


def parse_blocks(lines: DataFrame) -> DataFrame:
    """(file, block, name, position, full_name, distance, percent) of lines (file, line_no, line): a block runs from one image name to the next."""
    head = F.contains("line", F.lit("Image name:"))
    block = F.sum(head.cast("int")).over(Window.partitionBy("file").orderBy("line_no"))
    used = lines.filter(head | F.contains("line", F.lit("Distance (")) | F.contains("line", F.lit("Percent:")))
    rows = used.withColumn("block", block).withColumn("head", head)
    parts = F.split(F.get(F.split(F.get(F.split("line", "\t"), F.lit(1)), " "), F.lit(2)), "_")
    kind = F.when(F.col("head"), 0).when(F.contains("line", F.lit("Distance (")), 1).otherwise(2)
    rows = rows.withColumn("kind", kind).groupBy("file", "block").agg(*[F.max(F.when(F.col("kind") == i, F.col("line"))).alias(f"line{i}") for i in range(3)]).filter("block > 0")
    name = rows.withColumn("line", F.col("line0")).withColumn("p", parts)
    return name.select("file", "block", F.concat_ws("_", F.get("p", F.lit(0)), F.get("p", F.lit(6))).alias("name"), F.get("p", F.lit(7)).alias("position"), F.array_join("p", "-").alias("full_name"), _numbers(F.col("line1")).alias("distance"), _numbers(F.col("line2")).alias("percent"))


def read_occupancy(spark: SparkSession, path: str) -> DataFrame:
    """Blocks of cp1251 text files; each file is one row until its lines are numbered, as blocks are told by order. Spark's decode() doesn't know cp1251."""

    def run(batches):
        for batch in batches:
            for name, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                lines = raw.as_py().decode("cp1251", "replace").splitlines()
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(lines)), pa.array(range(len(lines)), pa.int64()), pa.array(lines, pa.string())], names=["file", "line_no", "line"])

    ship(spark)
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return parse_blocks(files.mapInArrow(run, "file string, line_no long, line string"))
