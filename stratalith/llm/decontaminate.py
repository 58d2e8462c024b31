"""Benchmark decontamination: a broadcast hash set of normalised benchmark word windows, scanned over every document.

Each benchmark item becomes windows of `n` consecutive words (an item with fewer words is one window). Words are numbered by the benchmark's
vocabulary, windows are a sorted array of 64-bit hashes of their numbers. Workers map document words to numbers, so that only runs of
benchmark words can be a window; those are looked up in the hashes, and every hit is verified number by number. The hash set of one block
of items is bounded by `block_bytes` of their texts; a larger benchmark is taken block by block, and the blocks' hits are
united per document, so the result is the same at any size.

Defined results: null or wordless text has no words and is never hit; null or wordless items give no window; repeated
items and repeated documents are each handled as rows of their own (window owners are item ids). Other columns, whatever their names, are kept as
they are or not read.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binary_values, map_batches, scratch_table, split_words

_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def window_hashes(ids: np.ndarray, size: int) -> np.ndarray:
    """64-bit hashes of all windows of `size` word numbers."""
    total = np.zeros(len(ids) - size + 1, np.uint64)
    for k in range(size):
        total = (total ^ ids[k : len(ids) - size + 1 + k].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        total ^= total >> np.uint64(29)
    return total


class WindowSet:
    """Windows of one block of items: the vocabulary, all items' word numbers, and by window length sorted hashes with places and owners."""

    def __init__(self, items: list[tuple[object, bytes | None]], n: int):
        self.vocabulary: dict[bytes, int] = {}
        self.names = [str(item_id) for item_id, _ in items]
        found: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
        parts, at = [], 0
        for owner, (_, raw) in enumerate(items):
            ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in split_words(raw or b"")], np.int32)
            size = min(n, len(ids))
            if size:
                hashes = window_hashes(ids, size)
                found.setdefault(size, []).append((hashes, np.arange(at, at + len(hashes), dtype=np.int64), np.full(len(hashes), owner, np.int32)))
                parts.append(ids)
                at += len(ids)
        self.words = np.concatenate(parts) if parts else np.zeros(0, np.int32)
        self.by_length = {}
        for size, some in found.items():
            hashes, places, owners = (np.concatenate(x) for x in zip(*some, strict=True))
            order = np.argsort(hashes, kind="stable")
            self.by_length[size] = hashes[order], places[order], owners[order]

    def scan(self, raw: bytes) -> tuple[int, list[tuple[int, int]], set[str]]:
        """Number of words, merged hit runs of words (start, end), and the items with an occurring window."""
        words = split_words(raw)
        if not words or not self.by_length:
            return len(words), [], set()
        get = self.vocabulary.get
        ids = np.fromiter((get(w, 0) for w in words), dtype=np.int32, count=len(words))
        known = np.concatenate(([0], np.cumsum(ids > 0)))
        spans, items = [], set()
        for size, (hashes, places, owners) in self.by_length.items():
            if len(words) < size:
                continue
            asked = np.flatnonzero(known[size:] - known[:-size] == size)
            if not len(asked):
                continue
            wanted = window_hashes(ids, size)[asked]
            low, high = np.searchsorted(hashes, wanted, "left"), np.searchsorted(hashes, wanted, "right")
            for i, a, b in zip(asked[high > low].tolist(), low[high > low].tolist(), high[high > low].tolist(), strict=True):
                mine = ids[i : i + size]
                same = [k for k in range(a, b) if np.array_equal(self.words[places[k] : places[k] + size], mine)]
                if same:
                    spans.append((i, i + size))
                    items.update(self.names[owners[k]] for k in same)
        runs = united(spans)
        return len(words), runs, items


def item_blocks(benchmark: DataFrame, id_col: str, text_col: str, block_bytes: int) -> tuple[DataFrame, int]:
    """The benchmark with a block number, and how many blocks keep each near `block_bytes`."""
    total = benchmark.agg(F.sum(F.octet_length(text_col) + 64)).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    return benchmark.select(F.col(id_col).alias("item_id"), F.col(text_col).cast("binary").alias("raw"), F.pmod(F.xxhash64(text_col, id_col), F.lit(blocks)).alias("block")), blocks


def scan_benchmark(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", n: int = 10, block_bytes: int = 4 << 20) -> DataFrame:
    """One row per document: id_col, n_words, runs array<struct<start,end>> (hit words), items array<string>.

    Only the id and the text of `docs` are read. With one block no shuffle is needed; with more, hits
    of all blocks are united by document row id.
    """
    blocked, blocks = item_blocks(benchmark, item_col, item_text_col, block_bytes)

    def one(source: DataFrame, key: str, block: int) -> DataFrame:
        rows = blocked.filter(F.col("block") == block).select("item_id", "raw").collect()
        held = source.sparkSession.sparkContext.broadcast(WindowSet([(r[0], bytes(r[1]) if r[1] is not None else None) for r in rows], n))
        run_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

        def fn(batch):
            found = [held.value.scan(raw or b"") for raw in binary_values(batch.column(1))]
            runs = [[{"start": s, "end": e} for s, e in x[1]] for x in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0] for x in found], pa.int64()), pa.array(runs, run_type), pa.array([sorted(x[2]) for x in found], pa.list_(pa.string()))], names=[key, "n_words", "runs", "items"])

        kind = source.schema[key].dataType.simpleString()
        return map_batches(source, [key, text_col], fn, f"`{key}` {kind}, n_words long, runs array<struct<start:long,end:long>>, items array<string>")

    if blocks == 1:
        return one(docs, id_col, 0)
    # rows are numbered once and kept, so that every block sees the same numbers
    kept = scratch_table(docs.select(F.col(id_col).alias("old"), text_col).withColumn("row", F.monotonically_increasing_id()), "decon")
    parts = [one(kept, "row", b) for b in range(blocks)]
    union = parts[0]
    for p in parts[1:]:
        union = union.union(p)
    merged = union.groupBy("row").agg(F.max("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_list("runs"))).alias("runs"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    # overlapping runs of different blocks become one
    merged = merged.withColumn("runs", F.expr("""aggregate(runs, cast(array() as array<struct<start:bigint,end:bigint>>), (a, r) ->
        CASE WHEN size(a) > 0 AND r.start <= element_at(a, -1).end
             THEN concat(slice(a, 1, size(a) - 1), array(named_struct('start', element_at(a, -1).start, 'end', greatest(r.end, element_at(a, -1).end))))
             ELSE concat(a, array(r)) END)"""))
    return merged.join(kept.select("row", F.col("old").alias(id_col)), "row").select(id_col, "n_words", "runs", "items")


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", n: int = 10, mode: str = "documents", block_bytes: int = 4 << 20) -> DataFrame:
    """`docs` without benchmark text: mode "documents" drops every hit document, "spans" cuts the hit words out of the text.

    All columns of `docs` are returned as they are (in "spans" mode only `text_col` changes: from the first byte
    of a hit run's first word to the last byte of its last). Blocks of a large benchmark are looked for one after the other, all in the text as it
    was: their runs are united, and the text is cut once.
    """
    if mode not in ("documents", "spans"):
        raise ValueError("mode must be 'documents' or 'spans'")
    blocked, blocks = item_blocks(benchmark, item_col, item_text_col, block_bytes)
    at, columns = docs.columns.index(text_col), docs.columns
    beside = next(c for c in (f"_runs{i}" for i in range(len(columns) + 1)) if c not in columns)
    kind = "array<struct<start:bigint,end:bigint>>"
    out = docs if mode == "documents" else docs.withColumn(beside, F.array().cast(kind))
    for block in range(blocks):
        rows = blocked.filter(F.col("block") == block).select("item_id", "raw").collect()
        held = docs.sparkSession.sparkContext.broadcast(WindowSet([(r[0], bytes(r[1]) if r[1] is not None else None) for r in rows], n))

        def drop(batch, held=held):
            yield batch.filter(pa.array([not held.value.scan(raw or b"")[1] for raw in binary_values(batch.column(at))], pa.bool_()))

        def look(batch, held=held):
            runs = [old.as_py() + [{"start": s, "end": e} for s, e in held.value.scan(raw or b"")[1]] for old, raw in zip(batch.column(len(columns)), binary_values(batch.column(at)), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(runs, batch.schema.field(len(columns)).type)], schema=batch.schema)

        out = map_batches(out, out.columns, drop if mode == "documents" else look, out.schema)
    if mode == "documents":
        return out

    def cut(batch):
        runs = [united([(r["start"], r["end"]) for r in found.as_py()]) for found in batch.column(len(columns))]
        texts = [raw if not r else cut_runs(raw, r) for raw, r in zip(binary_values(batch.column(at)), runs, strict=True)]
        cols = list(batch.columns[:-1])
        cols[at] = pa.array(texts, pa.binary()).cast(batch.schema.field(at).type)
        yield pa.RecordBatch.from_arrays(cols, names=columns)

    return map_batches(out, out.columns, cut, docs.schema)


def united(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs (start, end) in order, those that overlap or touch as one."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(runs):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def cut_runs(raw: bytes, runs: list[tuple[int, int]]) -> bytes:
    """`raw` without the words of `runs` and what stands between them."""
    places = [m.span() for m in _WORD.finditer(raw)]
    kept, at = [], 0
    for s, e in runs:
        kept.append(raw[at : places[s][0]])
        at = places[e - 1][1]
    return b"".join([*kept, raw[at:]])


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts and the item digest of scan_benchmark's rows."""
    return found.select(
        id_col,
        "n_words",
        F.expr("aggregate(runs, 0L, (a, r) -> a + r.end - r.start)").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        (F.size("runs") > 0).alias("contaminated"),
    )


def empty_digest() -> str:
    """items_sha256 of a document without items."""
    return hashlib.sha256(b"").hexdigest()
