"""Exact duplicates: an index of the texts seen before as minimal perfect hashes, held against every new batch.

Texts are equal when their SHA-256 after replacing runs of `[\\x20\\x09-\\x0D]` by one space is. The index is a table of one row a bucket of
digests: a minimal perfect hash (bit arrays by level; a digest's slot is the rank of its first bit that no other digest took) and, slot by
slot, the full digest, the locator of the row that stays (its id and row number) and the number of rows. A digest of a new batch gives a slot in any
case, so the slot's digest is compared byte by byte: equal ones are repeats of the slot's row, all others are new and grouped among themselves.

Only digests and numbers are shuffled, never texts, and rows of one digest are summed up before each shuffle, so a group of copies of any size is one row a
task. Buckets hold some `bucket_digests` different digests, dealt evenly, as SHA-256 is even. At the end each row looks up its group's
result; digests with a thousandth of all rows or more (a thousand at most) are looked up by broadcast, so no task gets one group's rows.

Defined results: a null text is the empty text; a null id is larger than all others; of rows equal in id and text, one stays (the first of the table
as read); an empty table gives an empty table. Other columns, whatever their names, are not read, but `remove_repeats` keeps them. Ids are cast to long.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import prepare, scratch_table

SPACES = r"[\x20\x09-\x0D]+"

INDEX = "bucket int, n long, sizes array<int>, bits binary, digests binary, ids array<long>, locs array<long>, counts array<long>"
GROUPS = "digest binary, keep_id long, keep_loc long, size long, known boolean"

_LOAD = 2.0  # bits a digest that is still to be placed
_LEVELS = 400
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


class PerfectHash:
    """Minimal perfect hash of distinct 32-byte digests: slots 0 to n - 1."""

    def __init__(self, sizes: list[int], bits: np.ndarray):
        self.sizes, self.bits = sizes, bits
        self.starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.rank = np.concatenate([[0], np.cumsum(bits)]).astype(np.int64)

    @staticmethod
    def _place(words: np.ndarray, level: int, size: int) -> np.ndarray:
        """A bit of the level for each digest, from all its words; another level is another function."""
        h = np.full(len(words), (level + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF, np.uint64)
        for k in range(4):
            h = (h ^ words[:, k]) * _MIX[k]
            h ^= h >> np.uint64(32)
        return (h % np.uint64(size)).astype(np.int64)

    @classmethod
    def of(cls, words: np.ndarray) -> PerfectHash:
        """Level by level: digests alone on their bit keep it, the others go on to the next level."""
        sizes, levels = [], []
        left = words
        while len(left):
            if len(sizes) == _LEVELS:
                raise ValueError("digests of one index must be distinct")
            size = max(8, int(len(left) * _LOAD))
            place = cls._place(left, len(sizes), size)
            alone = np.bincount(place, minlength=size) == 1
            sizes.append(size)
            levels.append(alone)
            left = left[~alone[place]]
        return cls(sizes, np.concatenate(levels) if levels else np.zeros(0, bool))

    def slots(self, words: np.ndarray) -> np.ndarray:
        """The slot of each digest; of one that isn't in the hash any slot, or -1."""
        out = np.full(len(words), -1, np.int64)
        at = np.arange(len(words))
        for level, size in enumerate(self.sizes):
            if not len(at):
                break
            place = self.starts[level] + self._place(words[at], level, size)
            hit = self.bits[place]
            out[at[hit]] = self.rank[place[hit]]
            at = at[~hit]
        return out


def _words(digests: pa.Array) -> np.ndarray:
    """32-byte digests as rows of four numbers."""
    return np.frombuffer(b"".join(digests.cast(pa.binary()).to_pylist()), np.uint64).reshape(-1, 4)


def _build(table: pa.Table) -> pa.Table:
    """One bucket's digests and winners as a row of the index."""
    columns = table.combine_chunks()
    words = _words(columns["digest"])
    hashed = PerfectHash.of(words)
    order = np.argsort(hashed.slots(words))
    taken = columns.take(pa.array(order))
    row = {
        "bucket": [columns["bucket"][0].as_py()],
        "n": [len(words)],
        "sizes": [hashed.sizes],
        "bits": [np.packbits(hashed.bits).tobytes()],
        "digests": [words[order].tobytes()],
        "ids": [taken["keep_id"].to_pylist()],
        "locs": [taken["keep_loc"].to_pylist()],
        "counts": [taken["size"].to_pylist()],
    }
    return pa.table(row, schema=pa.schema([("bucket", pa.int32()), ("n", pa.int64()), ("sizes", pa.list_(pa.int32())), ("bits", pa.binary()), ("digests", pa.binary()), ("ids", pa.list_(pa.int64())), ("locs", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64()))]))


def _probe(batch: pa.Table, index: pa.Table) -> pa.Table:
    """All groups of one bucket: those of the index with the batch's rows added, and those the index doesn't know."""
    batch, index = batch.combine_chunks(), index.combine_chunks()
    new = _words(batch["digest"])
    old, slot = np.zeros((0, 4), np.uint64), np.full(len(new), -1, np.int64)
    old_ids, old_locs, old_counts = [], [], []
    if len(index):
        row = index.slice(0, 1).to_pylist()[0]
        total = sum(row["sizes"])
        hashed = PerfectHash(row["sizes"], np.unpackbits(np.frombuffer(row["bits"], np.uint8), count=total).astype(bool))
        old = np.frombuffer(row["digests"], np.uint64).reshape(-1, 4)
        old_ids, old_locs, old_counts = row["ids"], row["locs"], row["counts"]
        slot = hashed.slots(new)
    member = slot >= 0
    member[member] = (old[slot[member]] == new[member]).all(axis=1)  # the full digest decides
    ids, locs, sizes = (batch[c].to_pylist() for c in ("keep_id", "keep_loc", "size"))
    for i in np.flatnonzero(member):
        s = slot[i]
        old_counts[s] += sizes[i]
        if (ids[i] is None, ids[i] or 0, locs[i]) < (old_ids[s] is None, old_ids[s] or 0, old_locs[s]):
            old_ids[s], old_locs[s] = ids[i], locs[i]
    fresh = np.flatnonzero(~member)
    words = np.concatenate([old, new[fresh]])
    raw = words.tobytes()
    return pa.table(
        {
            "digest": pa.array([raw[32 * i : 32 * i + 32] for i in range(len(words))], pa.binary()),
            "keep_id": pa.array(old_ids + [ids[i] for i in fresh], pa.int64()),
            "keep_loc": pa.array(old_locs + [locs[i] for i in fresh], pa.int64()),
            "size": pa.array(old_counts + [sizes[i] for i in fresh], pa.int64()),
            "known": pa.array([True] * len(old) + [False] * len(fresh), pa.bool_()),
        }
    )


def text_digest(text_col: str = "text") -> Column:
    """SHA-256 of the normalised text, 32 bytes."""
    return F.unhex(F.sha2(F.regexp_replace(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), SPACES, " "), 256))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, loc, digest) of every row as a scratch table: texts are read once, and row numbers stay as written."""
    return scratch_table(docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.monotonically_increasing_id().alias("loc"), text_digest(text_col).alias("digest")), "prints")


def _winners(prints: DataFrame, buckets: int) -> DataFrame:
    """(bucket, digest, keep_id, keep_loc, size) of the distinct digests."""
    first = F.min(F.struct(F.col("id").isNull().alias("none"), F.col("id"), F.col("loc"))).alias("w")
    found = prints.groupBy("digest").agg(first, F.count("*").alias("size"))
    return found.select(F.pmod(F.xxhash64("digest"), F.lit(buckets)).cast("int").alias("bucket"), "digest", F.col("w.id").alias("keep_id"), F.col("w.loc").alias("keep_loc"), "size")


def bucket_count(rows: int, bucket_digests: int = 200_000) -> int:
    """Buckets for so many rows; some more than needed for small tables, so that all tasks get some."""
    return max(64, -(-rows // bucket_digests))


def build_index(prints: DataFrame, buckets: int) -> DataFrame:
    """The index over all distinct digests of `prints`, one row a bucket. To be kept, write it; `buckets` goes with it."""
    prepare(prints.sparkSession)
    return _winners(prints, buckets).groupBy("bucket").applyInArrow(_build, INDEX)


def look_up(prints: DataFrame, index: DataFrame, buckets: int) -> DataFrame:
    """Groups of the index and of a batch together: (digest, keep_id, keep_loc, size, known); known: the index has the digest."""
    prepare(prints.sparkSession)
    return _winners(prints, buckets).groupBy("bucket").cogroup(index.groupBy("bucket")).applyInArrow(_probe, GROUPS)


def _is_history(id_col: str) -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 2 == 0


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", history: Column | None = None, bucket_digests: int = 200_000) -> DataFrame:
    """One row for each row: id, keep_id, group_size, kept, text_sha256.

    `history` tells of (`id`, `loc`) which rows make the index, the others are the batch held against it; the result is the same
    whatever it says. By default a checksum of the id deals both halves.
    """
    prints = fingerprints(docs, id_col, text_col)
    rows = prints.count()
    buckets = bucket_count(rows, bucket_digests)
    past = F.coalesce(_is_history("id") if history is None else history, F.lit(False))
    index = scratch_table(build_index(prints.filter(past), buckets), "digests")
    groups = scratch_table(look_up(prints.filter(~past), index, buckets), "groups")
    heavy = F.col("size") > max(1000, rows // 1000)  # fewer than 1,000 groups
    many = F.broadcast(groups.filter(heavy))
    few = groups.filter(~heavy)
    both = prints.join(many, "digest").unionByName(prints.join(many.select("digest"), "digest", "left_anti").join(few, "digest"))
    return both.select(F.col("id").alias(id_col), "keep_id", F.col("size").alias("group_size"), (F.col("loc") == F.col("keep_loc")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def remove_repeats(batch: DataFrame, index: DataFrame, buckets: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The batch's rows, all columns as they are, whose text the index doesn't know; of equal new texts the rows with the least id.

    Rows equal in both id and text stay or go together. Texts are shuffled once, as rows have no other key than their digest.
    """
    prints = fingerprints(batch, id_col, text_col)
    groups = scratch_table(look_up(prints, index, buckets).filter("NOT known").select(F.col("digest").alias("_digest"), F.col("keep_id").alias("_keep")), "groups")
    row = F.struct(*[F.col(f"`{c}`") for c in batch.columns]).alias("_row")
    rows = batch.select(text_digest(text_col).alias("_digest"), F.col(f"`{id_col}`").cast("long").alias("_id"), row)
    return rows.join(groups, "_digest").filter(F.col("_id").eqNullSafe(F.col("_keep"))).select("_row.*")
