"""Exact near-duplicate components: n-gram Jaccard join by T-occurrence search (DivideSkip) inside candidate groups.

1. Every document becomes the set of its `n`-word shingles (64-bit hashes). A set with a partner shares at least J of its shingles with it, so sets of
   which fewer than J occur in any other row have none. Tasks send packed shingles to buckets whose number follows the bytes of texts, each shingle once
   for some million; buckets tell which occur again, packed for those who add up (in 32 bits beside the bucket's: a collision keeps a set that could go, never the reverse).
2. Candidate groups of the sets that are left. Copies of one set within a task are replaced by one of them at once. Two sets with Jaccard >= J and sizes in neighbouring size classes differ in at most k shingles, k known from the class
   limits; dealing shingles by hash into k+1+spare parts leaves more than `spare` parts equal. Each set sends a hash of each part (parts
   without shingles only if the set has more of them than `spare`); sets with an equal part are joined in a star around the least of
   them while the sorted parts stream by, so no group is held or paired. No link can be missed; a passage that many documents share rarely
   fills a whole part of about eight random shingles. Components of these edges are the candidate groups, of different sets only.
   Groups too large for one block are dealt anew by rare shingles: with all shingles of a group in one order, by how many of its sets hold them, linked sets
   share one of the first a - ceil(J a) + 1 of each (a its size), so sets joined by passages that many others hold part. Counts come from buckets of
   hashes; every chunk of sets sends a shingle once, with its count, and gets one byte back for it.
3. T-occurrence search. In a candidate group the sets are indexed by shingle. A set of size a looks for partners that share at least
   T = ceil(J (a + b) / (1 + J)) shingles: its T-1 longest lists are put aside, the short rest is merged with counts, and what is left is
   probed in the long lists by binary search until it has T or can't reach it. Partners in the same component already are skipped.
   Groups of over `block` sets or `block_shingles` shingles are dealt into blocks; after rounds of joins in shuffled blocks, only pairs of blocks that
   still hold different components and sizes near enough are compared, each pair of blocks once, until all are.
4. Components of the links found, carried to copies.

Defined results: null text and text without words have an empty set, link with nothing and are their own component; a text with fewer than
`n` words is one shingle; repeated rows of an id are united under that id (sizes are the largest). An empty table gives an empty result. Ids are whole
numbers, or texts of such (others fail in the cast); rows without an id are in no result of the join, and stay in `keep_first`. Other columns are kept as they
are, whatever their names.
"""

from __future__ import annotations

import uuid
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binary_values, connected_components, drop_scratch, prepare, scratch_table, sized, split_tokens

_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
#: Bytes of words whose hashes a worker remembers, and the longest word among them.
_KEPT_BYTES, _LONGEST = 2 << 20, 64
#: Parts whose first set a task remembers.
_KEPT_PARTS = 250_000


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Sorted distinct shingle hashes of texts; remembers word hashes."""

    def __init__(self, n: int):
        self.n, self.words, self.held = n, {}, 0

    def __call__(self, raw: bytes | None) -> np.ndarray:
        words = split_tokens(raw or b"")
        if not words:
            return np.empty(0, np.uint64)
        if len(words) < self.n:
            return np.array([xxhash.xxh64_intdigest(b" ".join(words), 1)], np.uint64)
        known = self.words
        try:
            ids = [known[w] for w in words]
        except KeyError:
            if self.held > _KEPT_BYTES:
                known.clear()
                self.held = 0
            more: dict[bytes, int] = {}
            for w in words:
                if w not in known:
                    if len(w) > _LONGEST or self.held > 2 * _KEPT_BYTES:
                        more[w] = xxhash.xxh64_intdigest(w)
                    else:
                        known[w] = xxhash.xxh64_intdigest(w)
                        self.held += len(w)
            ids = [known[w] if w in known else more[w] for w in words]
        h = np.array(ids, np.uint64)
        size = len(words) - self.n + 1
        total = np.zeros(size, np.uint64)
        for i in range(self.n):
            total = _mix(total * _A + h[i : i + size] + _B)
        return np.unique(total)


class Classes:
    """Size classes for threshold J: class j holds sizes [low[j], low[j+1]), and J * size reaches one class down at most."""

    def __init__(self, threshold: Fraction, spare: int):
        self.j, self.spare, self.low = threshold, spare, [1]

    def until(self, size: int) -> None:
        while self.low[-1] <= size * 4:
            self.low.append(max(self.low[-1] + 1, -(-self.low[-1] * self.j.denominator // self.j.numerator)))

    def of(self, size: int) -> int:
        self.until(size)
        return int(np.searchsorted(self.low, size, "right")) - 1

    def parts(self, j: int) -> tuple[int, int]:
        """For pairs in classes j and j+1: parts to deal into, and the largest number of differing shingles."""
        self.until(self.low[min(j, len(self.low) - 1)])
        top = self.low[j + 2] - 1
        k = int(2 * top * (1 - self.j) / (1 + self.j))
        return (1, 0) if k == 0 else (k + 1 + self.spare, k)


def part_hashes(shingles: np.ndarray, classes: Classes) -> np.ndarray:
    """Hashes of the parts of a set, for its own pair of classes and the one below."""
    own = classes.of(len(shingles))
    out = []
    for j in (own - 1, own):
        if j < 0:
            continue
        m, k = classes.parts(j)
        home = (_mix(shingles ^ np.uint64(j + 1)) % np.uint64(m)).astype(np.int64)
        order = np.argsort(home, kind="stable")
        counts = np.bincount(home, minlength=m)
        sums = np.zeros(m, np.uint64)
        full = np.flatnonzero(counts)
        starts = np.concatenate(([0], np.cumsum(counts[full])[:-1]))
        sums[full] = np.add.reduceat(_mix(shingles + _C)[order], starts)
        send = full if m - len(full) < m - k else np.arange(m)
        out.append(_mix(sums[send] * _A + _mix(send.astype(np.uint64) * np.uint64(1_000_003) + np.uint64(j)) + counts[send].astype(np.uint64)))
    return np.concatenate(out)


def fingerprints(docs: DataFrame, id_col: str, text_col: str, n: int, threshold: Fraction, spare: int) -> DataFrame:
    """(doc, size, stand_in, root, parts, near, digest): parts only for the first of equal sets in a task, which stands in for the others; no digest of an empty set.

    A task sends each part once; later sets with an equal part are joined with the one that sent it (`near`) at once. What a task has joined
    already sends its parts under one name (`root`), so near copies of one template are one sender a task, however many parts they differ in.
    """

    def run(batches):
        shingle, classes, seen, leads, up = Shingler(n), Classes(threshold, spare), {}, {}, {}
        none = np.empty(0, np.int64)

        def root_of(x):
            while (above := up.get(x, x)) != x:
                up[x] = x = up.get(above, above)
            return x

        for batch in batches:
            docs_, sizes, stands, roots, near, parts, digests = batch.column(0).to_pylist(), [], [], [], [], [], []
            for doc, raw in zip(docs_, binary_values(batch.column(1)), strict=True):
                s = shingle(raw)
                sizes.append(len(s))
                digests.append(xxhash.xxh128_digest(s.tobytes()) if len(s) else None)
                first = seen.setdefault(digests[-1], doc) if len(s) else doc
                stands.append(first)
                mine, beside, joined = none, set(), []
                if len(s) and first == doc:
                    mine = part_hashes(s, classes).view(np.int64)
                    new = []
                    for part in mine.tolist():
                        sender = leads.setdefault(part, doc)
                        new.append(sender == doc)
                        if sender != doc:
                            beside.add(sender)
                    for sender in sorted(beside):
                        a, b = root_of(doc), root_of(sender)
                        if a != b:
                            up[a] = b
                            joined.append(sender)
                    if beside:
                        mine = mine[new]
                roots.append(root_of(doc))
                if len(leads) > _KEPT_PARTS:
                    leads.clear()
                    up.clear()
                near.append(joined)
                parts.append(mine)
                if len(seen) > 250_000:
                    seen.clear()
            offsets = pa.array(np.concatenate(([0], np.cumsum([len(x) for x in parts]))).astype(np.int32))
            lists = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(parts), pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(stands, pa.int64()), pa.array(roots, pa.int64()), lists, pa.array(near, pa.list_(pa.int64())), pa.array(digests, pa.binary())], names=["doc", "size", "stand_in", "root", "parts", "near", "digest"])

    def whole(batches):
        yield from run(b for b in batches if b.num_rows)

    return docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text")).mapInArrow(whole, "doc long, size long, stand_in long, root long, parts array<long>, near array<long>, digest binary")


def first_of_equal(prints: DataFrame) -> DataFrame:
    """(doc, first) of the sets that stand in for a task's equal ones: the least such document of the whole table."""
    heads = prints.filter("size > 0 and stand_in = doc").select("doc", "digest")
    return heads.join(heads.groupBy("digest").agg(F.min("doc").alias("first")), "digest").select("doc", "first").distinct()


def forest(edges: np.ndarray) -> np.ndarray:
    """Edges from every node to the least of its component, in place of rows (node, node) that join the same components."""
    nodes, at = np.unique(edges, return_inverse=True)
    at = at.reshape(-1, 2)
    up = np.arange(len(nodes))
    while True:
        ends = np.sort(up[at], axis=1)
        at = at[ends[:, 0] != ends[:, 1]]
        if not len(at):
            break
        np.minimum.at(up, ends[:, 1], ends[:, 0])
        while (up[up] != up).any():
            up = up[up]
    below = up != np.arange(len(nodes))
    return np.stack([nodes[below], nodes[up[below]]], axis=1)


def star_edges(prints: DataFrame) -> DataFrame:
    """Edges that join every set with the least set with an equal part: a task's as a forest, so that it sends no more of them than it saw sets."""
    parts = prints.filter(F.size("parts") > 0).select(F.col("root").alias("doc"), F.explode("parts").alias("part"))
    dealt = parts.repartition(F.col("part")).sortWithinPartitions("part", "doc")

    def run(batches):
        held, rows, kept = None, [], 0
        for batch in batches:
            part, doc = (batch.column(i).to_numpy() for i in range(2))
            if not len(part):
                continue
            new = np.concatenate(([held is None or part[0] != held[0]], part[1:] != part[:-1]))
            at = np.maximum.accumulate(np.where(new, np.arange(len(doc)), -1))
            lead = np.where(at >= 0, doc[at], held[1] if held else 0)
            held = (part[-1], lead[-1])
            other = lead != doc
            rows.append(np.stack([doc[other], lead[other]], axis=1))
            kept += len(rows[-1])
            if kept > 1_000_000:
                rows = [forest(np.concatenate(rows))]
                kept = 0
                if len(rows[0]) > 500_000:
                    yield pa.RecordBatch.from_arrays([pa.array(rows[0][:, 0]), pa.array(rows[0][:, 1])], names=["src", "dst"])
                    rows = []
        if rows:
            out = forest(np.concatenate(rows))
            for i in range(0, len(out), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(out[i : i + 50_000, 0]), pa.array(out[i : i + 50_000, 1])], names=["src", "dst"])

    return dealt.select("part", "doc").mapInArrow(run, "src long, dst long").union(prints.filter(F.size("near") > 0).select("doc", F.explode("near")))


_COUNTS = {"bucket": pa.int32(), "whole": pa.bool_(), "keys": pa.binary(), "docs": pa.binary(), "runs": pa.binary(), "many": pa.binary()}


def _packed(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """A binary column: row i holds values[offsets[i] : offsets[i + 1]]."""
    at = (offsets * values.dtype.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(values))])


def _unpacked(column: pa.ChunkedArray, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def _again(keys: np.ndarray) -> np.ndarray:
    """Whether each key occurs more than once among `keys`."""
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    out = np.zeros(len(keys), bool)
    out[order[1:]] |= same
    out[order[:-1]] |= same
    return out


def _deal(docs: list[int], sets: list[np.ndarray], buckets: int) -> pa.RecordBatch:
    """Rows for the buckets: shingles of one set alone (`keys`, in runs of `docs`), those of several (`many`, once each); one row of all sets, with sizes and how many shingles are of several."""
    ids, sizes, flat = np.array(docs, np.int64), np.array([len(x) for x in sets], np.int64), np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), sizes)
    again = _again(flat)
    home = ((flat >> np.uint64(32)) % np.uint64(buckets)).astype(np.uint16 if buckets <= 1 << 16 else np.int64)
    order = np.argsort(home, kind="stable")
    lone = order[~again[order]]
    shared = np.unique(flat[again])
    shared_home = ((shared >> np.uint64(32)) % np.uint64(buckets)).astype(home.dtype)
    by = np.argsort(shared_home, kind="stable")
    present = np.unique(home)
    bounds = lambda homes: np.append(np.searchsorted(homes, present), len(homes))
    homes, owners = home[lone], owner[lone]
    new = np.ones(len(lone), bool)
    new[1:] = (homes[1:] != homes[:-1]) | (owners[1:] != owners[:-1])
    starts = np.flatnonzero(new)
    runs = np.diff(np.append(starts, len(lone))).astype(np.uint32)
    low = lambda x: x.astype(np.uint32)
    one = lambda x: _packed(x, np.array([0, len(x)]))
    dealt = [pa.array(present.astype(np.int32)), pa.array(np.zeros(len(present), bool)), _packed(low(flat[lone]), bounds(homes)), _packed(ids[owners[starts]], bounds(homes[starts])), _packed(runs, bounds(homes[starts])), _packed(low(shared[by]), bounds(shared_home[by]))]
    several = np.bincount(owner[again], minlength=len(sets)).astype(np.uint32)
    everything = [pa.array([int(xxhash.xxh32_intdigest(ids.tobytes())) % buckets], pa.int32()), pa.array([True]), one(np.empty(0, np.uint32)), one(ids), one(sizes.astype(np.uint32)), one(several)]
    return pa.RecordBatch.from_arrays([pa.concat_arrays(pair) for pair in zip(dealt, everything, strict=True)], names=list(_COUNTS))


def _united(doc: np.ndarray, size: np.ndarray, least: np.ndarray, repeated: np.ndarray) -> tuple[np.ndarray, ...]:
    """One entry for each document: the largest size, the least above 0 (0: none), the sum of repeated shingles."""
    ids, at = np.unique(doc, return_inverse=True)
    most, low, added = np.zeros(len(ids), np.int64), np.full(len(ids), np.iinfo(np.int64).max), np.zeros(len(ids), np.int64)
    np.maximum.at(most, at, size)
    np.minimum.at(low, at[least > 0], least[least > 0])
    np.add.at(added, at, repeated)
    return ids, most, np.where(low == np.iinfo(np.int64).max, 0, low), added


def repeated_shingles(docs: DataFrame, id_col: str, text_col: str, n: int, bucket_bytes: int = 32 << 20, flush: int = 1 << 20) -> DataFrame:
    """(doc, size, least, repeated) of every id: largest and least size above 0 of its rows, and shingles of its rows that occur in another row.

    A bucket answers with one packed row for each owner of documents (as many as buckets, by a hash of the id), not with a row a document.
    """

    def run(batches):
        shingle, ids, sets, held = Shingler(n), [], [], 0
        for batch in batches:
            for doc, raw in zip(batch.column(0).to_pylist(), binary_values(batch.column(1)), strict=True):
                ids.append(doc)
                sets.append(shingle(raw))
                held += len(sets[-1]) + 1
                if held >= flush:
                    yield _deal(ids, sets, buckets)
                    ids, sets, held = [], [], 0
        if ids:
            yield _deal(ids, sets, buckets)

    def merge(table: pa.Table) -> pa.Table:
        whole = table.filter(table["whole"])
        table = table.filter(pa.compute.invert(table["whole"]))
        keys, runs = _unpacked(table["keys"], np.uint32), _unpacked(table["runs"], np.uint32).astype(np.int64)
        again = _again(np.concatenate([keys, _unpacked(table["many"], np.uint32)]))[: len(keys)]
        counts = np.add.reduceat(again.astype(np.int64), np.cumsum(runs) - runs) if len(runs) else np.empty(0, np.int64)
        some = counts > 0
        ids = np.concatenate([_unpacked(whole["docs"], np.int64), _unpacked(table["docs"], np.int64)[some]])
        sizes = np.concatenate([_unpacked(whole["runs"], np.uint32).astype(np.int64), np.zeros(int(some.sum()), np.int64)])
        doc, size, least, repeated = _united(ids, sizes, sizes, np.concatenate([_unpacked(whole["many"], np.uint32).astype(np.int64), counts[some]]))
        home = (_mix(doc.view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(home, kind="stable")
        present = np.unique(home)
        at = np.append(np.searchsorted(home[order], present), len(home))
        return pa.table([pa.array(present.astype(np.int32)), *[_packed(x[order], at) for x in (doc, size, least, repeated)]], names=["owner", *totals])

    def total(table: pa.Table) -> pa.Table:
        doc, size, least, repeated = _united(*[_unpacked(table[x], np.int64) for x in totals])
        return pa.table({"doc": doc, "size": size, "least": pa.array(least, mask=least == 0), "repeated": repeated})

    totals = ["doc", "size", "least", "repeated"]
    texts = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    weight = texts.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 16)).first()[0] or 0
    buckets = max(8, -(-weight // bucket_bytes))
    shape = "bucket int, whole boolean, keys binary, docs binary, runs binary, many binary"
    found = texts.mapInArrow(run, shape).groupBy("bucket").applyInArrow(merge, "owner int, doc binary, size binary, least binary, repeated binary")
    return found.groupBy("owner").applyInArrow(total, "doc long, size long, least long, repeated long")


class Search:
    """T-occurrence search over a block of sets, with union-find over what is linked."""

    def __init__(self, docs: list[int], sets: list[np.ndarray], labels: list[int], threshold: Fraction):
        order = sorted(range(len(docs)), key=lambda i: (len(sets[i]), docs[i]))
        self.docs, self.sets, self.labels = [docs[i] for i in order], [sets[i] for i in order], [labels[i] for i in order]
        self.j = threshold
        self.up = list(range(len(docs)))
        first: dict[int, int] = {}
        for i, label in enumerate(self.labels):
            self.union(i, first.setdefault(label, i))
        self.sizes = np.array([len(s) for s in self.sets])
        self.lists: dict[int, np.ndarray] = {}
        if docs:
            flat = np.concatenate(self.sets)
            owner = np.repeat(np.arange(len(docs)), self.sizes)
            by = np.argsort(flat, kind="stable")
            keys, starts = np.unique(flat[by], return_index=True)
            ends = np.append(starts[1:], len(flat))
            owner = owner[by]
            self.index = (keys, starts, ends, owner)

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def union(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)

    def need(self, a: int, b: np.ndarray) -> np.ndarray:
        """Overlap that sizes a and b must reach."""
        p, q = self.j.numerator, self.j.numerator + self.j.denominator
        return -(-p * (a + b) // q)

    def run(self) -> None:
        """Link every set with the smaller ones (in order of size) that it reaches the threshold with, unless linked already."""
        keys, starts, ends, owner = self.index
        roots = np.array([self.find(i) for i in range(len(self.docs))])
        for a in range(1, len(self.docs)):
            size = int(self.sizes[a])
            least = -(-size * self.j.numerator // self.j.denominator)
            begin = int(np.searchsorted(self.sizes, least))
            if begin >= a:
                continue
            at = np.searchsorted(keys, self.sets[a])
            lo, hi = starts[at], ends[at]
            order = np.argsort(hi - lo, kind="stable")
            lo, hi = lo[order], hi[order]
            t = int(self.need(size, np.array([least]))[0])
            short = size - t + 1  # so that the t - 1 longest lists are put aside
            merged = np.sort(np.concatenate([owner[x:y] for x, y in zip(lo[:short], hi[:short], strict=True)]), kind="stable")
            merged = merged[np.searchsorted(merged, begin) : np.searchsorted(merged, a)]
            if not len(merged):
                continue
            found, counts = np.unique(merged, return_counts=True)
            mine = roots[a]
            other = roots[found] != mine
            found, counts = found[other], counts[other]
            required = self.need(size, self.sizes[found])
            left = size - short
            for x, y in zip(lo[short:], hi[short:], strict=True):
                if not len(found):
                    break
                long_list = owner[x:y]
                place = np.searchsorted(long_list, found)
                counts = counts + (long_list[np.minimum(place, len(long_list) - 1)] == found)
                left -= 1
                alive = counts + left >= required
                if not alive.all():
                    found, counts, required = found[alive], counts[alive], required[alive]
            for b in found[counts >= required].tolist():
                self.union(a, b)
            if len(found):
                mine = self.find(a)
                touched = np.isin(roots, np.unique(np.append(roots[found], roots[a])))
                roots[touched] = [self.find(int(r)) for r in roots[touched]]

    def links(self) -> list[tuple[int, int]]:
        """(document, least document of its component)."""
        least: dict[int, int] = {}
        for i, d in enumerate(self.docs):
            r = self.find(i)
            least[r] = min(least.get(r, d), d)
        return [(d, least[self.find(i)]) for i, d in enumerate(self.docs)]


def search_groups(members: DataFrame, keys: list[str], n: int, threshold: Fraction) -> DataFrame:
    """Search each group of `members` (keys, doc, label, text): (doc, label), label the least document it is linked with."""
    p, q = threshold.numerator, threshold.denominator

    def one(table: pa.Table) -> pa.Table:
        shingle, seen, docs, sets, labels, out = Shingler(n), {}, [], [], [], []
        for doc, label, raw in zip(table["doc"].to_pylist(), table["label"].to_pylist(), (v for c in table["text"].chunks for v in binary_values(c)), strict=True):
            s = shingle(raw)
            key = s.tobytes()
            if key in seen and labels[seen[key]] == label:
                out.append((doc, seen[key]))
                continue
            seen[key] = len(docs)
            docs.append(doc)
            sets.append(s)
            labels.append(label)
        search = Search(docs, sets, labels, Fraction(p, q))
        search.run()
        found = dict(search.links())
        rows = list(found.items()) + [(d, min(d, found[docs[i]])) for d, i in out] + [(docs[i], min(d, found[docs[i]])) for d, i in out]
        # a copy that is less than its component's least document lowers it: an edge, for the components that follow
        return pa.table({"doc": pa.array([r[0] for r in rows], pa.int64()), "label": pa.array([r[1] for r in rows], pa.int64())})

    return members.groupBy(*keys).applyInArrow(one, "doc long, label long")


def weigh(groups: DataFrame, prints: DataFrame, block: int, block_shingles: int) -> DataFrame:
    """(doc, g, w, least, size): a set weighs as much of a block as it is of `block` sets or of `block_shingles` shingles, whichever is more; blocks weigh about one at most."""
    weight = F.greatest(F.lit(1.0 / block), F.col("size") / float(block_shingles))
    sizes = prints.groupBy("doc").agg(F.min("size").alias("least"), F.max("size").alias("size"))
    return groups.join(sizes, F.col("node") == F.col("doc")).select("doc", F.col("component").alias("g"), weight.alias("w"), "least", "size")


def _homes(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each key, and the order of keys by bucket."""
    home = ((keys >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
    return home, np.argsort(home, kind="stable")


def _byte_of(counts: np.ndarray) -> np.ndarray:
    """Counts in one byte, in the same order: exact below 128, eight steps for each doubling beyond."""
    steps = 128 + np.floor(8 * np.log2(np.maximum(counts, 128) / 128.0))
    return np.where(counts < 128, counts, np.minimum(steps, 255)).astype(np.uint8)


def rare_shingles(texts: DataFrame, shingles: int, n: int, threshold: Fraction, chunk: int = 1 << 18, bucket: int = 4 << 20) -> DataFrame:
    """(doc, root, parts, near) of `texts` (doc, g, text), as `star_edges` takes them: the first shingles of every set, of those that another set of the group g holds.

    `shingles` is the number of all, by which buckets are counted. A chunk of sets sends each shingle once and joins the sets that have one
    in common among their first at once.
    """
    p, q = threshold.numerator, threshold.denominator
    buckets = max(8, -(-shingles // bucket))

    def pack(batches):
        shingle, docs, sets, held = Shingler(n), [], [], 0

        def out():
            one = [pa.array([int.from_bytes(uuid.uuid4().bytes[:7], "big")], pa.int64())]
            one += [pa.array([x.tobytes()], pa.binary()) for x in (np.array(docs, np.int64), np.array([len(x) for x in sets], np.int64), np.concatenate(sets))]
            return pa.RecordBatch.from_arrays(one, names=["chunk", "docs", "sizes", "keys"])

        for batch in batches:
            for doc, g, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), binary_values(batch.column(2)), strict=True):
                s = shingle(raw)
                if not len(s):
                    continue
                docs.append(doc)
                sets.append(_mix(s ^ _mix(np.array([g], np.int64).view(np.uint64) + _A)))
                held += len(s)
                if held >= chunk:
                    yield out()
                    docs, sets, held = [], [], 0
        if docs:
            yield out()

    def deal(batches):
        for batch in batches:
            for i, raw in enumerate(binary_values(batch.column(1))):
                keys, counts = np.unique(np.frombuffer(raw, np.uint64), return_counts=True)
                home, order = _homes(keys, buckets)
                present, starts = np.unique(home[order], return_index=True)
                bounds = np.append(starts, len(keys))
                name = pa.array([batch.column(0)[i].as_py()] * len(present), pa.int64())
                yield pa.RecordBatch.from_arrays([name, pa.array(present), _packed(keys[order].astype(np.uint32), bounds), _packed(counts[order].astype(np.uint32), bounds)], names=["chunk", "bucket", "lows", "counts"])

    def answer(table: pa.Table) -> pa.Table:
        lows, counts = _unpacked(table["lows"], np.uint32), _unpacked(table["counts"], np.uint32)
        _, at = np.unique(lows, return_inverse=True)
        codes = _byte_of(np.bincount(at, weights=counts).astype(np.int64))[at]
        lengths = np.array([len(x) // 4 for x in table["lows"].to_pylist()])
        return pa.table({"chunk": table["chunk"], "bucket": table["bucket"], "codes": _packed(codes, np.append(0, np.cumsum(lengths)))})

    def first(table: pa.Table) -> pa.Table:
        table = table.sort_by("bucket")
        docs, sizes, keys = (_unpacked(table[c].drop_null(), kind) for c, kind in (("docs", np.int64), ("sizes", np.int64), ("keys", np.uint64)))
        different, at = np.unique(keys, return_inverse=True)
        codes = np.empty(len(different), np.uint8)
        codes[_homes(different, buckets)[1]] = _unpacked(table["codes"].drop_null(), np.uint8)
        code, owner = codes[at], np.repeat(np.arange(len(docs)), sizes)
        order = np.lexsort((keys, code, owner))
        place = np.arange(len(keys)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        order = order[(place < np.repeat(sizes + (-p * sizes) // q + 1, sizes)) & (code[order] > 1)]
        token, owner = keys[order], owner[order]
        order = np.lexsort((docs[owner], token))
        token, owner = token[order], owner[order]
        new = np.ones(len(token), bool)
        new[1:] = token[1:] != token[:-1]
        leads = docs[owner][np.maximum.accumulate(np.where(new, np.arange(len(token)), 0))] if len(token) else docs[:0]
        beside = leads != docs[owner]
        near = np.unique(np.stack([owner[beside], leads[beside]], axis=1), axis=0)
        # what is joined here sends under the name of its least set, and one edge for each set is enough
        joins = forest(np.stack([docs[near[:, 0]], near[:, 1]], axis=1)) if len(near) else np.empty((0, 2), np.int64)
        at_doc = np.argsort(docs, kind="stable")
        joined = at_doc[np.searchsorted(docs[at_doc], joins[:, 0])] if len(joins) else np.empty(0, np.int64)
        roots = docs.copy()
        roots[joined] = joins[:, 1]

        def lists(rows: np.ndarray, values: np.ndarray) -> pa.Array:
            by = np.argsort(rows, kind="stable")
            ends = np.append(0, np.cumsum(np.bincount(rows, minlength=len(docs)))).astype(np.int32)
            return pa.ListArray.from_arrays(pa.array(ends), pa.array(values[by], pa.int64()))

        return pa.table({"doc": docs, "root": roots, "parts": lists(owner[new], token[new].view(np.int64)), "near": lists(joined, joins[:, 1])})

    chunks = scratch_table(texts.select("doc", "g", "text").mapInArrow(pack, "chunk long, docs binary, sizes binary, keys binary"), "chunks")
    dealt = chunks.select("chunk", "keys").mapInArrow(deal, "chunk long, bucket long, lows binary, counts binary")
    answers = dealt.groupBy("bucket").applyInArrow(answer, "chunk long, bucket long, codes binary")
    both = chunks.withColumn("bucket", F.lit(-1).cast("long")).unionByName(answers, allowMissingColumns=True)
    rows = scratch_table(both.groupBy("chunk").applyInArrow(first, "doc long, root long, parts array<long>, near array<long>"), "rare")
    drop_scratch(chunks)
    return rows


def refined_groups(docs: DataFrame, groups: DataFrame, prints: DataFrame, id_col: str, text_col: str, n: int, threshold: Fraction, block: int, block_shingles: int) -> DataFrame:
    """Candidate groups (node, component), those too large for one block dealt anew by rare shingles, as a scratch table."""
    weighed = scratch_table(weigh(groups, prints, block, block_shingles), "weighed")
    wide = sized(scratch_table(weighed.groupBy("g").agg(F.sum("w").alias("w")).filter(F.col("w") > 1.0).select("g"), "wide"))
    chosen = scratch_table(weighed.join(wide, "g", "left_semi").select("doc", "g", "size"), "chosen")
    shingles = chosen.agg(F.sum("size")).first()[0]
    rare = found = None
    if shingles:
        texts = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text")).join(sized(chosen.select("doc", "g")), "doc")
        rare = rare_shingles(texts, shingles, n, threshold)
        found = scratch_table(star_edges(rare), "stars")
        groups = groups.join(wide, F.col("component") == F.col("g"), "left_anti").union(connected_components(found))
    out = scratch_table(groups, "groups")
    drop_scratch(weighed, wide, chosen, rare, found)
    return out


def verified_links(docs: DataFrame, groups: DataFrame, prints: DataFrame, id_col: str, text_col: str, n: int, threshold: Fraction, block: int, block_shingles: int, rounds: int = 2) -> DataFrame:
    """Edges (src, dst) that span every component of candidate `groups` (node, component), as a scratch table.

    """
    weighed = scratch_table(weigh(groups, prints, block, block_shingles), "weighed")
    wide = weighed.groupBy("g").agg(F.sum("w").alias("w")).filter(F.col("w") > 1.0).select("g", F.ceil("w").cast("int").alias("blocks"))
    texts = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("binary").alias("text"))
    members = texts.join(sized(weighed), "doc").withColumn("label", F.col("doc"))
    linked = lambda found: found.select(F.col("doc").alias("src"), F.col("label").alias("dst")).filter("src <> dst")
    if wide.isEmpty():
        edges = scratch_table(linked(search_groups(members.select("g", "doc", "label", "text"), ["g"], n, threshold)), "links")
        drop_scratch(weighed)
        return edges
    members = scratch_table(members, "members")
    narrow = members.join(wide.select("g"), "g", "left_anti").select("g", "doc", "label", "text")
    parts = [scratch_table(linked(search_groups(narrow, ["g"], n, threshold)), "links")]
    big = scratch_table(members.join(wide, "g"), "big")
    drop_scratch(members)
    labels = big.select("doc", F.col("doc").alias("label"))
    for r in range(rounds):
        dealt = big.drop("label").join(labels, "doc").withColumn("b", F.pmod(F.xxhash64(F.col("doc"), F.lit(r)), F.col("blocks"))).select("g", "b", "doc", "label", "text")
        found = scratch_table(linked(search_groups(dealt, ["g", "b"], n, threshold)).union(linked(labels)), "links")
        parts.append(found)
        after = scratch_table(big.select("doc").join(connected_components(found).withColumnRenamed("node", "doc"), "doc", "left").select("doc", F.coalesce("component", "doc").alias("label")), "labels")
        drop_scratch(labels)
        labels = after
    # groups of which more than one component is left: a block holds one large component's part, or small ones
    state = scratch_table(big.select("doc", "g", "w", "least", "size").join(labels, "doc"), "state")
    open_groups = state.groupBy("g").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi").select("g")
    placed = None
    if not open_groups.isEmpty():
        # sizes of linked sets differ by a factor of 1 / J at most, a class by a little more: only cells of one class or of neighbouring ones are compared
        step = max(float(np.log(float(1 / threshold))), 0.01) * 1.001
        level = lambda c: F.floor(F.log(F.greatest(F.col(c), F.lit(1))) / step)
        left = state.join(open_groups, "g").withColumn("level", F.explode(F.sequence(level("least"), level("size"))))
        by_label = left.groupBy("g", "level", "label").agg(F.sum("w").alias("held")).withColumn("large", F.col("held") * 2 > 1.0)
        small = by_label.groupBy("g", "level").agg(F.coalesce(F.sum(F.when(~F.col("large"), F.col("held"))), F.lit(0.0)).alias("rest"))
        cells_of = left.join(by_label, ["g", "level", "label"]).join(small, ["g", "level"]).withColumn("owner", F.when(F.col("large"), F.col("label"))).withColumn("parts", F.greatest(F.lit(1), F.ceil(F.when(F.col("large"), F.col("held")).otherwise(F.col("rest"))).cast("int"))).withColumn("part", F.pmod(F.xxhash64("doc"), F.col("parts"))).withColumn("cell", F.struct("level", F.coalesce("owner", F.lit(-1)).alias("owner"), "part"))
        placed = scratch_table(cells_of.select("g", "doc", "label", "cell"), "placed")
        cells = placed.select("g", "cell").distinct()
        pairs = cells.alias("x").join(cells.alias("y"), (F.col("x.g") == F.col("y.g")) & (F.col("x.cell") <= F.col("y.cell")) & (F.col("y.cell.level") - F.col("x.cell.level") <= 1) & ((F.col("x.cell.owner") != F.col("y.cell.owner")) | (F.col("x.cell.owner") == -1)))
        pairs = pairs.select(F.col("x.g").alias("g"), F.col("x.cell").alias("c1"), F.col("y.cell").alias("c2"))
        sides = pairs.select("g", "c1", "c2", F.explode(F.array_distinct(F.array("c1", "c2"))).alias("cell"))
        pool = sides.join(placed, ["g", "cell"]).join(big.select("doc", "text"), "doc").select("g", "c1", "c2", "doc", "label", "text")
        parts.append(scratch_table(linked(search_groups(pool, ["g", "c1", "c2"], n, threshold)), "links"))
    drop_scratch(weighed, big, labels, state, placed)
    edges = parts[0]
    for x in parts[1:]:
        edges = edges.union(x)
    every = scratch_table(edges.distinct(), "links")
    drop_scratch(*parts)
    return every


def duplicate_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 3, threshold: str | Fraction = "9/10", block: int = 2000, block_shingles: int = 2_000_000, spare: int = 1) -> DataFrame:
    """(id_col, n_shingles, component_id) of every document; links are Jaccard >= threshold on sets of n-word shingles."""
    prepare(docs.sparkSession)
    j = Fraction(threshold)
    docs = docs.filter(F.col(id_col).isNotNull())
    counted = scratch_table(repeated_shingles(docs, id_col, text_col, n), "counted")
    left = sized(counted.filter(F.col("repeated") * j.denominator >= F.col("least") * j.numerator).select(F.col("doc").alias("left")))
    prints = scratch_table(fingerprints(docs.join(left, F.col(id_col).cast("long") == F.col("left"), "left_semi"), id_col, text_col, n, j, spare), "prints")
    candidates = scratch_table(star_edges(prints), "stars")
    firsts = scratch_table(first_of_equal(prints), "firsts")
    every = connected_components(candidates).join(sized(firsts.filter("doc = first").select(F.col("doc").alias("node")).distinct()), "node", "left_semi")
    some = every.groupBy("component").agg(F.count("*").alias("sets")).filter("sets > 1").select("component")
    groups = scratch_table(every.join(some, "component", "left_semi").select("node", "component"), "groups")
    refined = refined_groups(docs, groups, prints, id_col, text_col, n, j, block, block_shingles)
    links = verified_links(docs, refined, prints, id_col, text_col, n, j, block, block_shingles)
    drop_scratch(candidates, groups, refined)
    copies = prints.filter("size > 0 and stand_in <> doc").select(F.col("doc").alias("src"), F.col("stand_in").alias("dst"))
    found = connected_components(links.select("src", "dst").union(copies).union(firsts.filter("doc <> first").select("doc", "first")))
    sizes = counted.select("doc", F.col("size").alias("n_shingles"))
    kind = docs.schema[id_col].dataType
    drop_scratch(links, firsts)
    out = sizes.join(found, F.col("doc") == F.col("node"), "left").select(F.col("doc").cast(kind).alias(id_col), "n_shingles", F.coalesce("component", "doc").alias("component_id"))
    return out


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Rows of `docs` whose id is the least of their component, unchanged (rows without an id stay)."""
    found = duplicate_components(docs, id_col, text_col, **options)
    copies = found.filter(F.col(id_col) != F.col("component_id")).select(id_col)
    return docs.join(sized(scratch_table(copies, "copies")), id_col, "left_anti").select(*docs.columns)
