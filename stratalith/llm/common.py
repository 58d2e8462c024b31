"""Shared pieces of the training-data operators: Arrow row mapping, scratch tables, connected components."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship

#: bytes.translate table: ASCII letters to lower case, every other ASCII character that is no digit to a space.
WORD_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def split_tokens(raw: bytes) -> list[bytes]:
    """Words `[^\\x20\\x09-\\x0D]+` of UTF-8 text, A-Z lower-cased (bytes methods touch ASCII only)."""
    return raw.lower().split()


def split_words(raw: bytes) -> list[bytes]:
    """Words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of UTF-8 text, A-Z lower-cased."""
    return raw.translate(WORD_TABLE).split()


def binary_values(column: pa.Array) -> Iterator[bytes | None]:
    """UTF-8 bytes of a string column, one row at a time, so that one batch of very long texts isn't copied at once."""
    column = column.cast(pa.binary())
    for i in range(len(column)):
        yield column[i].as_py()


def text_values(column: pa.Array) -> Iterator[str | None]:
    for i in range(len(column)):
        yield column[i].as_py()


def prepare(spark: SparkSession) -> None:
    """The package for the workers, and Arrow batches that stay small with long texts, unless the session's creator has set their size."""
    ship(spark)
    if not spark.sparkContext.getConf().contains(_BATCH_ROWS) and int(spark.conf.get(_BATCH_ROWS)) == 10_000:
        spark.conf.set(_BATCH_ROWS, "1000")


_BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def map_batches(df: DataFrame, columns: list[str], fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Send only `columns` through Arrow to `fn`, batch by batch; nothing is kept between batches."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield from fn(batch)

    prepare(df.sparkSession)
    return df.select(*[F.col(f"`{c}`") for c in columns]).mapInArrow(run, schema)


def scratch_root(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir; a temporary one only where it is unset and Spark is local (tests)."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    current = sc._jsc.sc().getCheckpointDir()
    if named:
        if current.isEmpty():
            sc.setCheckpointDir(named)
        return named
    if current.isEmpty():
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="stratalith-"))
        current = sc._jsc.sc().getCheckpointDir()
    return current.get()


_left: list[DataFrame] = []


@atexit.register
def _drop_left() -> None:
    """What results may still have read goes with the session."""
    with contextlib.suppress(Exception):
        drop_scratch(*_left)


def scratch_table(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as Parquet in the shared scratch folder and read it back: cut lineage that outlives any executor."""
    spark = df.sparkSession
    path = f"{scratch_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    _left.append(out)
    return out


def _place(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, files = _place(spark, path)
    return files.exists(p)


def remove(spark: SparkSession, path: str) -> None:
    p, files = _place(spark, path)
    files.delete(p, True)


def drop_scratch(*tables: DataFrame | None) -> None:
    """Delete scratch tables that nothing reads any more."""
    for t in tables:
        _left[:] = [x for x in _left if x is not t]
        path = getattr(t, "_scratch_path", None)
        if path:
            remove(t.sparkSession, path)


@contextlib.contextmanager
def scratch_scope():
    """Scratch tables written inside are deleted behind: for results that have been written themselves."""
    before = list(_left)
    yield
    drop_scratch(*[t for t in _left if not any(t is x for x in before)])


def sized(table: DataFrame, most_rows: int = 500_000) -> DataFrame:
    """A scratch table of a few numbers a row, marked for broadcast only if it was counted and is small; shuffled otherwise."""
    return F.broadcast(table) if table.count() <= most_rows else table


def connected_components(edges: DataFrame, max_rounds: int = 60, heavy_degree: int = 200, most_heavy: int = 100_000) -> DataFrame:
    """Smallest node reachable from each node of `edges` (src, dst): alternating large-star and small-star rounds.

    Every round is two aggregations and joins on the edges that are left, so no component is ever collected; each round is cut by a
    scratch table. Nodes of more than `heavy_degree` edges get their least neighbour by broadcast, so that no task holds a star's
    edges; of E edges at most `most_heavy` nodes can have more than 2 E / most_heavy, which the degree is raised to. Returns (node, component),
    nodes of `edges` only.
    """

    def stars(e: DataFrame, large: bool, degree: int) -> DataFrame:
        both = e.select(F.col("src").alias("u"), F.col("dst").alias("v")).union(e.select(F.col("dst").alias("u"), F.col("src").alias("v"))) if large else e.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
        heavy = F.broadcast(least.filter(F.col("n") > degree).select("u", "m"))
        joined = both.join(heavy.select("u"), "u", "left_anti").join(least.filter(F.col("n") <= degree).select("u", "m"), "u").union(both.join(heavy, "u"))
        if large:
            out = joined.filter("v > u").select(F.col("v").alias("src"), F.col("m").alias("dst"))
        else:
            out = joined.select(F.col("v").alias("src"), F.col("m").alias("dst")).union(least.select(F.col("u").alias("src"), F.col("m").alias("dst")))
        return out.filter("src <> dst").distinct()

    now = scratch_table(edges.filter("src <> dst").select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct(), "cc")
    fingerprint, n = None, now.count()
    for _ in range(max_rounds):
        degree = max(heavy_degree, -(-2 * n // most_heavy))
        half = scratch_table(stars(now, True, degree), "cc")
        after = scratch_table(stars(half, False, degree), "cc")
        seen = after.agg(F.count("*"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first()
        drop_scratch(now, half)
        now, n = after, seen[0]
        if tuple(seen) == fingerprint:
            break
        fingerprint = tuple(seen)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("src").alias("node"), F.col("dst").alias("component")).union(now.select(F.col("dst").alias("node"), F.col("dst").alias("component"))).distinct()
