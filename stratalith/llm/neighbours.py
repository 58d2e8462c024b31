"""Approximate nearest neighbours by inner product: balanced posting lists with replicated boundary vectors.

Largest inner product becomes smallest distance by one more component (sqrt(M^2 - |x|^2), M the largest norm). Centroids are fitted on a
bounded sample by k-means with a penalty for full clusters; every vector is then posted to its nearest list and, if it lies near a boundary, to up
to `copies` lists that aren't hidden behind one taken already. Centroids are searched by best-first walks on an in-memory graph
of them, with a beam that widens while all of it lies within reach. A query reads the lists whose centroids are at most `ratio` times as far as its
nearest one; the ratio is calibrated on the sample, so that its own brute-force neighbours are found with `recall`.

The number of lists follows the number of vectors: one for `list_rows` vectors. Up to `top_lists` they are one level. Beyond that, each of `top_lists`
cells has an index of its own, of as many lists as its vectors need, fitted in a task on a bounded sample of the cell; a query picks cells, then lists
in each, by the same rule. Lists are cut into blocks of rows by hash, so neither a large list nor a vector with many copies gathers in one task; queries
of a list are cut into blocks too.

Scores are inner products of the original vectors in double precision, summed the same way for every pair. Vectors that are null, zero, of another
than the most frequent length, or hold null or non-finite components take no part. Ties go to the smaller id. Repeated ids are one candidate, with the best
of their vectors; of a repeated query id, the best score over its vectors counts. Other columns, whatever their names, are not read. An empty table
gives an empty result; a query gets fewer than `k` rows only if there are fewer candidates.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_scratch, prepare, scratch_table, sized

_STORED = "<f8"


class Index:
    """Centroids in the extended space, their graph, and the calibrated ratio."""

    def __init__(self, sample: np.ndarray, largest: float, lists: int, copies: int, boundary: float, recall: float, k: int, seed: int = 1):
        self.largest, self.copies, self.boundary = largest, copies, boundary
        rng = np.random.default_rng(seed)
        x = self.extend(sample)
        lists = max(1, min(lists, len(np.unique(x, axis=0))))
        self.centroids = self._balanced_means(rng, x, lists)
        n = len(self.centroids)
        between = self._distances(self.centroids, self.centroids)
        np.fill_diagonal(between, np.inf)
        degree = min(16, n - 1)
        self.graph = np.argsort(between, axis=1)[:, :degree] if degree else np.zeros((n, 0), np.int64)
        # a ring beside the nearest ones keeps the graph connected
        self.graph = np.concatenate([self.graph, np.roll(np.arange(n), 1)[:, None], np.roll(np.arange(n), -1)[:, None]], axis=1)
        self.entries = rng.permutation(n)[: max(1, min(8, n))]
        self.ratio = self._calibrate(rng, sample, x, recall, k)

    def extend(self, x: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(self.largest**2 - (x * x).sum(axis=1), 0.0))
        return np.concatenate([x, rest[:, None]], axis=1)

    def extend_queries(self, q: np.ndarray) -> np.ndarray:
        norms = np.sqrt((q * q).sum(axis=1))
        return np.concatenate([q * (self.largest / norms)[:, None], np.zeros((len(q), 1))], axis=1)

    @staticmethod
    def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * a @ b.T, 0.0))

    def _balanced_means(self, rng, x: np.ndarray, lists: int, rounds: int = 8) -> np.ndarray:
        c = x[rng.choice(len(x), lists, replace=False)].copy()
        penalty = np.zeros(lists)
        target = len(x) / lists
        for _ in range(rounds):
            home = np.concatenate([(self._distances(x[i : i + 4096], c) + penalty).argmin(axis=1) for i in range(0, len(x), 4096)])
            sizes = np.bincount(home, minlength=lists)
            sums = np.zeros_like(c)
            np.add.at(sums, home, x)
            full = sizes > 0
            c[full] = sums[full] / sizes[full][:, None]
            c[~full] = x[rng.choice(len(x), int((~full).sum()))]
            step = 0.05 * float(np.median(self._distances(x[:512], c).min(axis=1)))
            penalty = np.where(full, penalty + step * (np.minimum(sizes / target, 4.0) - 1.0), 0.0)
        return c

    def walk(self, x: np.ndarray, reach: float, least: int, beam: int = 32) -> tuple[np.ndarray, np.ndarray]:
        """Distances (inf: none) and centroids met, nearest first: best-first walks that go on while an unvisited one may lie within `reach` times the nearest, or among the `least` nearest."""
        n = len(self.centroids)
        beam = min(n, max(beam, 2 * least))
        met, at = self._walk(x, reach, least, beam)
        # rows whose whole beam is within reach walk again with a wider one
        full = np.flatnonzero(np.isfinite(met[:, -1]) & (met[:, -1] <= met[:, 0] * reach)) if beam < n else np.zeros(0, np.int64)
        if len(full):
            wide, places = self.walk(x[full], reach, least, beam * 4)
            more = wide.shape[1] - beam
            met, at = np.pad(met, ((0, 0), (0, more)), constant_values=np.inf), np.pad(at, ((0, 0), (0, more)), constant_values=-1)
            met[full], at[full] = wide, places
        return met, at

    def _walk(self, x: np.ndarray, reach: float, least: int, beam: int) -> tuple[np.ndarray, np.ndarray]:
        rows, n = len(x), len(self.centroids)
        first = self.entries[:beam]
        at = np.full((rows, beam), -1)
        met = np.full((rows, beam), np.inf)
        at[:, : len(first)], met[:, : len(first)] = first, self._distances(x, self.centroids[first])
        done = at < 0
        active = np.arange(rows)
        while len(active):
            open_ = np.where(done[active], np.inf, met[active])
            pick = open_.argmin(axis=1)
            nearest = open_[np.arange(len(active)), pick]
            limit = np.maximum(met[active].min(axis=1) * reach, np.partition(met[active], min(least, n, beam) - 1, axis=1)[:, min(least, n, beam) - 1])
            go = np.isfinite(nearest) & (nearest <= limit)
            active, pick = active[go], pick[go]
            if not len(active):
                break
            done[active, pick] = True
            beside = self.graph[at[active, pick]]
            far = np.sqrt(np.maximum(((x[active][:, None, :] - self.centroids[beside]) ** 2).sum(axis=2), 0.0))
            far[(beside[:, :, None] == at[active][:, None, :]).any(axis=2)] = np.inf  # in the beam already
            same = beside[:, :, None] == beside[:, None, :]
            far[(same & np.tri(beside.shape[1], k=-1, dtype=bool)[None]).any(axis=2)] = np.inf
            every, places = np.concatenate([met[active], far], axis=1), np.concatenate([at[active], beside], axis=1)
            gone = np.concatenate([done[active], ~np.isfinite(far)], axis=1)
            keep = np.argpartition(every, beam - 1, axis=1)[:, :beam]
            met[active], at[active], done[active] = (np.take_along_axis(v, keep, axis=1) for v in (every, places, gone))
        order = np.argsort(met, axis=1, kind="stable")
        return np.take_along_axis(met, order, axis=1), np.take_along_axis(at, order, axis=1)

    def homes(self, x: np.ndarray) -> list[list[int]]:
        """The lists each (extended) vector is posted to: the nearest, and near ones that no list taken before is nearer to."""
        met, order = self.walk(x, 1.0 + self.boundary, 4 * self.copies)
        out = []
        for row, near in zip(met[:, : 4 * self.copies], order[:, : 4 * self.copies].tolist(), strict=True):
            taken = [near[0]]
            for c, far in zip(near[1:], row[1:].tolist(), strict=True):
                if len(taken) == self.copies or far > (1.0 + self.boundary) * row[0] + 1e-12:
                    break
                if all(np.sqrt(((self.centroids[c] - self.centroids[t]) ** 2).sum()) > far * 0.6 for t in taken):
                    taken.append(c)
            out.append(taken)
        return out

    def _calibrate(self, rng, sample: np.ndarray, x: np.ndarray, recall: float, k: int) -> float:
        if len(self.centroids) < 2:
            return 1.0
        pool = rng.permutation(len(x))[:16384]
        asked = pool[:256]
        scores = sample[asked] @ sample[pool].T
        scores[np.arange(len(asked)), np.arange(len(asked))] = -np.inf
        best = np.argsort(-scores, axis=1)[:, : min(k, len(pool) - 1)]
        homes = self.homes(x[pool[np.unique(best)]])
        at = {p: h for p, h in zip(np.unique(best).tolist(), homes, strict=True)}
        far = self._distances(self.extend_queries(sample[asked]), self.centroids)
        far = far / far.min(axis=1, keepdims=True)
        needed = [min(far[i, c] for c in at[p]) for i, row in enumerate(best.tolist()) for p in row]
        return float(np.quantile(needed, recall)) * 1.005 if needed else 1.0

    def lists_for(self, q: np.ndarray, sizes: np.ndarray, enough: int) -> list[list[int]]:
        """Lists within the ratio; more of the nearest ones while they hold fewer than `enough` postings."""
        met, order = self.walk(self.extend_queries(q), self.ratio, 1)
        out = []
        for i in range(len(q)):
            taken = order[i][met[i] <= self.ratio * met[i, 0] + 1e-12].tolist()
            if sizes[taken].sum() < enough:
                d = self._distances(self.extend_queries(q[i : i + 1]), self.centroids)[0]
                near = np.argsort(d)
                taken = near[: int(np.searchsorted(np.cumsum(sizes[near]), enough)) + 1].tolist()
            out.append(taken)
        return out


def valid_vectors(vectors: DataFrame, id_col: str, vec_col: str) -> tuple[DataFrame, int]:
    """(id, vec array<double>) of vectors that take part, and their length."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec")).filter(F.col("id").isNotNull() & F.col("vec").isNotNull())
    finite = F.forall("vec", lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) != float("inf")), F.lit(False))) & F.exists("vec", lambda v: v != 0)
    rows = rows.filter(finite)
    lengths = rows.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return (rows.filter(F.size("vec") == lengths[0]["n"]), lengths[0]["n"]) if lengths else (rows, 0)


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _posted(part: pa.RecordBatch, lists: list[list[int]], x: np.ndarray, base: int = 0) -> pa.RecordBatch:
    """One row (list, id, raw) for each list of each vector."""
    row = np.repeat(np.arange(len(x)), [len(h) for h in lists])
    raw = [v.tobytes() for v in x.astype(_STORED)]
    return pa.RecordBatch.from_arrays([pa.array([base + c for h in lists for c in h], pa.int64()), part.column("id").take(pa.array(row)), pa.array([raw[i] for i in row.tolist()], pa.binary())], names=["list", "id", "raw"])


_POSTED = "list long, id long, raw binary"
#: Lists of a cell are numbered from its own number times this.
_CELL = 1 << 32


def _in_blocks(postings: DataFrame, counts: DataFrame, block_rows: int) -> DataFrame:
    """`postings` with a block b of their list, of at most about `block_rows` rows."""
    blocks = counts.select("list", F.ceil(F.col("n") / block_rows).cast("int").alias("blocks"))
    return postings.join(sized(blocks), "list").withColumn("b", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))


def _cells(postings: DataFrame, counts: DataFrame, d: int, largest: float, list_rows: int, block_rows: int, sample_rows: int, copies: int, boundary: float, recall: float, k: int) -> tuple[DataFrame, DataFrame]:
    """An index for every cell, (list, index binary), fitted on a hash sample of its postings, and the postings dealt to the cells' lists."""

    def fit(table: pa.Table) -> pa.Table:
        x = np.frombuffer(b"".join(table["raw"].to_pylist()), _STORED).reshape(-1, d)
        lists = max(1, min(-(-table["n"][0].as_py() // list_rows), len(x) // 8))
        made = Index(np.array(x), largest, lists, min(copies, 2), boundary, recall, k)
        return pa.table({"list": table["list"][:1], "index": pa.array([pickle.dumps(made)], pa.binary())})

    sampled = postings.join(sized(counts), "list").filter(F.pmod(F.xxhash64("id", F.lit(7)), F.lit(1_000_003)) < F.lit(1_000_003.0) * sample_rows / F.col("n")).select("list", "n", "raw")
    cells = scratch_table(sampled.groupBy("list").applyInArrow(fit, "list long, index binary"), "cells")

    def deal(left: pa.Table, index: pa.Table) -> pa.Table:
        made: Index = pickle.loads(index["index"][0].as_py()) if index.num_rows else None  # noqa: S301 (our own bytes)
        x = np.frombuffer(b"".join(left["raw"].to_pylist()), _STORED).reshape(-1, d)
        cell = left["list"][0].as_py() if left.num_rows else 0
        parts = left.combine_chunks().to_batches(max_chunksize=1024)
        out, at = [], 0
        for part in parts:
            rows = x[at : at + part.num_rows]
            out.append(_posted(part, made.homes(made.extend(rows)) if made else [[0]] * len(rows), rows, (cell + 1) * _CELL))
            at += part.num_rows
        return pa.Table.from_batches(out, pa.schema([("list", pa.int64()), ("id", pa.int64()), ("raw", pa.binary())]))

    dealt = _in_blocks(postings, counts, block_rows)
    copies_of = cells.join(counts.select("list", F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / block_rows).cast("int") - 1)).alias("b")), "list")
    return cells, scratch_table(dealt.select("list", "b", "id", "raw").groupBy("list", "b").cogroup(copies_of.select("list", "b", "index").groupBy("list", "b")).applyInArrow(deal, _POSTED), "postings")


def _ask_cells(asked: DataFrame, cells: DataFrame, counts: DataFrame, d: int, block_rows: int, enough: int) -> DataFrame:
    """Queries of cells as queries of the cells' lists."""
    sizes = counts.groupBy((F.floor(F.col("list") / _CELL) - 1).alias("list")).agg(F.map_from_entries(F.collect_list(F.struct((F.col("list") % _CELL).cast("int").alias("at"), "n"))).alias("sizes"))
    wanted = asked.groupBy("list").agg(F.count("*").alias("n"))
    tools = cells.join(sizes, "list").join(wanted.select("list", F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / block_rows).cast("int") - 1)).alias("b")), "list")

    def pick(left: pa.Table, tool: pa.Table) -> pa.Table:
        shape = pa.schema([("list", pa.int64()), ("id", pa.int64()), ("raw", pa.binary())])
        if not left.num_rows or not tool.num_rows:
            return pa.Table.from_batches([], shape)
        made: Index = pickle.loads(tool["index"][0].as_py())  # noqa: S301 (our own bytes)
        size = np.zeros(len(made.centroids), np.int64)
        for at, n in tool["sizes"][0].as_py():
            size[at] = n
        part = left.select(["id"]).combine_chunks().to_batches()[0]
        x = np.frombuffer(b"".join(left["raw"].to_pylist()), _STORED).reshape(-1, d)
        return pa.Table.from_batches([_posted(part, made.lists_for(x, size, enough), x, (left["list"][0].as_py() + 1) * _CELL)], shape)

    dealt = _in_blocks(asked, wanted, block_rows)
    return dealt.select("list", "b", "id", "raw").groupBy("list", "b").cogroup(tools.select("list", "b", "index", "sizes").groupBy("list", "b")).applyInArrow(pick, _POSTED)


def nearest(vectors: DataFrame, queries: Callable[[Column], Column], id_col: str = "vec_id", vec_col: str = "embedding", k: int = 20, list_rows: int = 4096, block_rows: int = 4096, sample_rows: int = 65_536, top_lists: int = 4096, copies: int = 4, boundary: float = 0.1, recall: float = 0.98, figures: dict | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the `k` nearest found of every row of `vectors` for whose id `queries` holds.

    `figures` takes up the number of lists, of postings, of lists asked, and of pairs compared.
    """
    prepare(vectors.sparkSession)
    rows, d = valid_vectors(vectors, id_col, vec_col)
    spark = vectors.sparkSession
    shape = "query_id long, rank int, vec_id long, score double"
    if not d:
        return spark.createDataFrame([], shape)
    n, squared = rows.agg(F.count("*"), F.max(F.aggregate("vec", F.lit(0.0), lambda a, v: a + v * v))).first()
    share = min(1.0, sample_rows / n)
    picked = rows.filter(F.pmod(F.xxhash64("id"), F.lit(1_000_003)) < int(share * 1_000_003) + (share >= 1)).select("vec").toArrow()["vec"].combine_chunks()
    sample = np.array(_matrix(picked, d)) if len(picked) else np.array(_matrix(rows.select("vec").limit(1).toArrow()["vec"].combine_chunks(), d))
    lists, largest = max(8, n // list_rows), float(np.sqrt(squared)) * (1 + 1e-12)
    index = spark.sparkContext.broadcast(Index(sample, largest, min(top_lists, lists), copies, boundary, recall, k))
    enough = copies * (k + 1)

    def post(batches):
        for batch in batches:
            for part in (batch.slice(i, 1024) for i in range(0, batch.num_rows, 1024)):
                x = _matrix(part.column(1), d)
                yield _posted(part, index.value.homes(index.value.extend(x)), x)

    def counted(of: DataFrame) -> DataFrame:
        return scratch_table(of.groupBy("list").agg(F.count("*").alias("n"), F.countDistinct("id").alias("ids")), "counts")

    postings = scratch_table(rows.mapInArrow(post, _POSTED), "postings")
    counts = counted(postings)
    # at most top_lists rows
    different = {r["list"]: r["ids"] for r in counts.collect()}
    sizes = np.array([different.get(c, 0) for c in range(len(index.value.centroids))])

    def ask(batches):
        for batch in batches:
            for part in (batch.slice(i, 1024) for i in range(0, batch.num_rows, 1024)):
                x = _matrix(part.column(1), d)
                yield _posted(part, index.value.lists_for(x, sizes, enough), x)

    asked = scratch_table(rows.filter(queries(F.col("id"))).mapInArrow(ask, _POSTED), "asked")
    if lists > top_lists:
        cells, fine = _cells(postings, counts.select("list", "n"), d, largest, list_rows, block_rows, sample_rows, copies, boundary, recall, k)
        fine_counts = counted(fine)
        fine_asked = scratch_table(_ask_cells(asked, cells, fine_counts.select("list", F.col("ids").alias("n")), d, block_rows, enough), "asked")
        drop_scratch(postings, counts, asked, cells)
        postings, counts, asked = fine, fine_counts, fine_asked
    wanted = asked.groupBy("list").agg(F.count("*").alias("m"))
    if figures is not None:
        pairs = counts.join(wanted, "list", "left").agg(F.count("*"), F.sum("n"), F.sum("m"), F.sum(F.col("n") * F.col("m"))).first()
        figures.update(zip(("lists", "postings", "asked", "pairs"), (x or 0 for x in pairs), strict=True))
    blocks = sized(counts.join(wanted, "list").select("list", F.ceil(F.col("n") / block_rows).cast("int").alias("blocks"), F.ceil(F.col("m") / block_rows).cast("int").alias("asks")))
    left = postings.join(blocks, "list").withColumn("b", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).withColumn("a", F.explode(F.sequence(F.lit(0), F.col("asks") - 1))).select("list", "b", "a", "id", "raw")
    right = asked.join(blocks, "list").withColumn("a", F.pmod(F.xxhash64("id"), F.col("asks")).cast("int")).withColumn("b", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("list", "b", "a", "id", "raw")

    def search(held: pa.Table, query: pa.Table) -> pa.Table:
        out: list[list] = [[], [], []]
        if held.num_rows and query.num_rows:
            ids = held["id"].to_numpy()
            first = np.unique(ids, return_index=True)[1]
            x = np.frombuffer(b"".join(held["raw"].to_pylist()), _STORED).reshape(-1, d)
            asking = query["id"].to_numpy()
            for i in range(0, len(asking), 256):
                some = asking[i : i + 256]
                q = np.frombuffer(b"".join(query["raw"].slice(i, 256).to_pylist()), _STORED).reshape(-1, d)
                rough = q @ x.T
                rough[ids[None, :] == some[:, None]] = -np.inf
                for j in range(len(some)):
                    line = rough[j]
                    # k different ids reach at least this
                    lead = line[first]
                    top = np.argpartition(-lead, min(k, len(lead)) - 1)[:k]
                    worst = lead[top].min()
                    near = np.flatnonzero(line >= (worst - 1e-9 * max(1.0, abs(worst)) if np.isfinite(worst) else np.finfo(float).min))
                    score = (x[near] * q[j]).sum(axis=1)
                    best = np.lexsort((ids[near], -score))
                    best = best[np.sort(np.unique(ids[near][best], return_index=True)[1])[:k]]
                    out[0] += [int(some[j])] * len(best)
                    out[1] += ids[near][best].tolist()
                    out[2] += score[best].tolist()
        return pa.table({"query_id": pa.array(out[0], pa.int64()), "vec_id": pa.array(out[1], pa.int64()), "score": pa.array(out[2], pa.float64())})

    found = left.groupBy("list", "b", "a").cogroup(right.groupBy("list", "b", "a")).applyInArrow(search, "query_id long, vec_id long, score double")
    # one row for the repeats of an id and its postings in several lists
    by_query = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    different_ids = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return different_ids.withColumn("rank", F.row_number().over(by_query)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
