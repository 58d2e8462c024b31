"""LM scoring by a hierarchical Pitman-Yor model over all training tokens.

Restaurants: every previous token, whatever its count, and the beginning of a text have a restaurant of their own; its dishes are the tokens that
follow, the end among them. All of them share one parent, the restaurant of single tokens, whose customers are their tables and whose base is uniform over the
known tokens and one unknown. Every token of every training text is a customer of its previous token's restaurant.

Seating: pairs start with one table each; then every sweep seats the parent's customers given its base, and all pairs' customers given the parent and the
other tables of their restaurant: the customers of a dish leave and are seated again one after the other (past 64 in runs of a sixteenth, moved by
their mean number of new tables, rounded at random). Draws are fixed by token or pair and sweep, however rows are dealt out. All tables of a sweep are seated given those of the
sweep before, so sweeps run in parallel. Sweeps after `burn_in` are averaged: p(w|u) = (c - d mean(t) + (strength + d mean(T_u)) mean p(w)) / (strength + c_u), which
sums to one over all tokens. Discounts are n1 / (n1 + 2 n2) of each level's counts.

Tables: tokens are 63-bit hashes; the `lexicon_size` most frequent ones are broadcast and named by their places. Counts of pairs and tokens are sorted arrays
of keys, packed by differences, one set for each of a number of buckets that follows the texts' bytes (`bucket_bytes`), so no key gathers more rows than there are tasks.
Who needs values of another bucket's keys (pairs of tokens beyond the lexicon; texts of pairs beyond a broadcast table of the `pairs_size` most frequent
ones) sends the keys there and has the values back. A text's score is a sum: what its tokens have without their pairs, and what every pair seen in
training adds, in steps of 2^-20, so that it doesn't depend on the order of summing.

Defined results: null text is empty and has the end only; repeated rows are scored row by row; a row with a null id is
training data; without training rows every token is unknown. Tokens that tie at the lexicon's least count stay outside together, as do pairs; they are looked
up in their buckets then, with the same result. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import functools
import itertools
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import binary_values, drop_scratch, prepare, scratch_table, split_tokens

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_FAR = np.uint64(1 << 63)  # marks ids that are hashes
END = (1 << 63) - 1  # key of the end, which no word's hash is given
_STEP = 1 << 20
#: Bytes of words a worker remembers.
_KEPT_BYTES = 1 << 20


def held_out(id_col: str = "doc_id"):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 7 == 2


# -- arrays -----------------------------------------------------------------------------------------------------------


@functools.lru_cache(maxsize=1)
def _tools():
    return zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def squeeze(x: np.ndarray) -> bytes:
    """An array's bytes, those of equal rank side by side, compressed."""
    raw = np.ascontiguousarray(x)
    return _tools()[0].compress(raw.view(np.uint8).reshape(len(raw), raw.itemsize).T.tobytes()) if len(raw) else b""


def unsqueeze(raw: bytes, kind) -> np.ndarray:
    kind = np.dtype(kind)
    if not raw:
        return np.zeros(0, kind)
    flat = np.frombuffer(_tools()[1].decompress(raw), np.uint8)
    return flat.reshape(kind.itemsize, -1).T.copy(order="C").reshape(-1).view(kind)


def squeeze_keys(keys: np.ndarray) -> bytes:
    return squeeze(np.diff(keys, prepend=np.uint64(0)))


def unsqueeze_keys(raw: bytes) -> np.ndarray:
    return np.cumsum(unsqueeze(raw, np.uint64), dtype=np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _starts(keys: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)


def counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct sorted keys and how often each occurs."""
    keys = np.sort(keys)
    starts = _starts(keys)
    return keys[starts], np.diff(starts, append=len(keys))


def summed(keys: np.ndarray, *columns: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct sorted keys, and the sums of columns by key."""
    order = np.argsort(keys)
    keys = keys[order]
    starts = _starts(keys)
    return keys[starts], *(np.add.reduceat(c[order], starts) if len(starts) else c[:0] for c in columns)


def dealt(keys: np.ndarray, buckets: int, near: int = 0) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, places of its keys, in order). Keys up to `near`, places in the lexicon, are dealt in stretches."""
    home = mixed(keys + _B) % np.uint64(buckets)
    if near:
        home = np.where(keys <= near, np.minimum(keys, np.uint64(near)) * np.uint64(buckets) // np.uint64(near + 1), home)
    if not len(keys):
        return
    home = home.astype(np.uint16 if buckets <= 1 << 16 else np.int64)
    order = np.argsort(home, kind="stable")
    home = home[order].astype(np.int64)
    ends = np.flatnonzero(np.diff(home, append=-1)) + 1
    for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True):
        yield int(home[a]), order[a:b]


def looked_up(keys: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of `asked` in sorted `keys`, and whether they are there."""
    if not len(keys):
        return np.zeros(len(asked), np.int64), np.zeros(len(asked), bool)
    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    return at, keys[at] == asked


def batch_of(schema: dict, rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.values(), strict=True)], names=list(schema))


def spark_schema(schema: dict) -> str:
    return ", ".join(f"{name} {'binary' if t == pa.binary() else 'long' if t == pa.int64() else 'int' if t == pa.int32() else 'double'}" for name, t in schema.items())


# -- seating ----------------------------------------------------------------------------------------------------------


def discount_of(n1: int, n2: int) -> float:
    return min(0.95, max(0.05, n1 / (n1 + 2 * n2))) if n1 + n2 else 0.5


def seat(keys: np.ndarray, counts: np.ndarray, weight: np.ndarray, d: float, seed: int) -> np.ndarray:
    """Tables after seating `counts` customers of each dish anew; `weight` is that of a new table (strength and the other dishes' discounted tables, times the parent's probability)."""
    tables = np.minimum(counts, 1)
    active = np.flatnonzero(counts > 1)
    i = 1
    while len(active):
        draw = (mixed(keys[active].astype(np.uint64) + np.uint64((seed * 1_000_003 + i) * 0x9E3779B97F4A7C15 % 2**64)) >> np.uint64(11)).astype(np.float64) / 2.0**53
        run = 1 if i < 64 else i // 16
        w = np.maximum(weight[active], 0.0)
        p = w / (w + np.maximum(i - d * tables[active], 1e-9))
        mean = np.minimum(run, counts[active] - i) * p
        tables[active] += (np.floor(mean) + (draw < mean - np.floor(mean))).astype(np.int64)
        i += run
        active = active[counts[active] > i]
    return tables


# -- texts ------------------------------------------------------------------------------------------------------------


def token_hash(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word) % END


class Reader:
    """Words of texts as ids: places in the lexicon (sorted hashes), else hashes with the top bit set. Without a lexicon, plain hashes."""

    def __init__(self, lexicon: np.ndarray | None = None):
        self.lexicon = lexicon
        self._forget()

    def _forget(self) -> None:
        """Remembered words have places from 0, in order; a new one is given the next place while it is looked up."""
        self.known: defaultdict[bytes, int] = defaultdict()
        self.known.default_factory = self.known.__len__
        self.ids, self.held = np.zeros(1 << 12, np.uint64), 0

    def __call__(self, words: list[bytes]) -> np.ndarray:
        known, before = self.known, len(self.known)
        places = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
        if len(known) > before:
            new = list(itertools.islice(reversed(known), len(known) - before))[::-1]
            ids = np.fromiter(map(xxhash.xxh3_64_intdigest, new), np.uint64, len(new)) % np.uint64(END)
            if self.lexicon is not None:
                at, found = looked_up(self.lexicon, ids)
                ids = np.where(found, at.astype(np.uint64), ids | _FAR)
            if len(known) > len(self.ids):
                self.ids = np.concatenate([self.ids, np.zeros(len(known), np.uint64)])
            self.ids[before : len(known)] = ids
            self.held += sum(map(len, new))
        out = self.ids[places]
        if self.held > _KEPT_BYTES:
            self._forget()
        return out


def pair_keys(u: np.ndarray, w: np.ndarray, none: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of pairs of ids: of places in the lexicon (`none`: beginning or end) the places, else a hash with the top bit set; and which are such."""
    far = ((u | w) & _FAR) > 0
    return np.where(far, mixed(u * _A + mixed(w + _B)) | _FAR, u * np.uint64(none + 1) + w), far


def count_tokens(texts: DataFrame, buckets: int, flush: int = 1_000_000) -> DataFrame:
    """(bucket, n, keys, c) over column `text`: keys of tokens, the end among them, summed in each task, then by bucket."""
    shape = {"bucket": pa.int32(), "keys": pa.binary(), "c": pa.binary()}

    def run(batches):
        reader, parts, sums = Reader(), [], [np.zeros(0, np.uint64), np.zeros(0, np.int64)]
        pending = 0

        def gather():
            nonlocal parts, sums, pending
            new = counted(np.concatenate(parts)) if parts else (sums[0][:0], sums[1][:0])
            sums = list(summed(*(np.concatenate(x) for x in zip(sums, new, strict=True)))) if len(sums[0]) else list(new)
            parts, pending = [], 0

        def out():
            nonlocal sums
            rows = [(b, squeeze_keys(sums[0][at]), squeeze(sums[1][at])) for b, at in dealt(sums[0], buckets)] if len(sums[0]) else []
            sums = [np.zeros(0, np.uint64), np.zeros(0, np.int64)]
            return batch_of(shape, rows)

        for batch in batches:
            for raw in binary_values(batch.column(0)):
                parts += [reader(split_tokens(raw or b"")), np.array([END], np.uint64)]
                pending += len(parts[-2]) + 1
                if pending > flush:
                    gather()
                    if len(sums[0]) > flush // 2:
                        yield out()
        gather()
        yield out()

    def merge(table: pa.Table) -> pa.Table:
        keys, c = summed(np.concatenate([unsqueeze_keys(x) for x in table["keys"].to_pylist()]), np.concatenate([unsqueeze(x, np.int64) for x in table["c"].to_pylist()]))
        return pa.table({"bucket": pa.array([table["bucket"][0].as_py()], pa.int32()), "n": pa.array([len(keys)], pa.int64()), "keys": [squeeze_keys(keys)], "c": [squeeze(c)]})

    return texts.mapInArrow(run, spark_schema(shape)).groupBy("bucket").applyInArrow(merge, "bucket int, n long, keys binary, c binary")


PAIRS = {"bucket": pa.int32(), "far": pa.int32(), "more": pa.int32(), "keys": pa.binary(), "u": pa.binary(), "w": pa.binary(), "c": pa.binary(), "t": pa.binary(), "total": pa.binary()}


def count_pairs(texts: DataFrame, lexicon, buckets: int, flush: int = 1_000_000) -> DataFrame:
    """PAIRS rows over column `text`: counts of pairs by bucket, those within the lexicon and others (far), those counted once and more apart; one table each."""
    shape = {"bucket": pa.int32(), "keys": pa.binary(), "u": pa.binary(), "w": pa.binary(), "c": pa.binary()}

    def run(batches):
        reader = Reader(lexicon.value)
        none = len(lexicon.value)
        edge = np.array([none], np.uint64)
        ids: list[np.ndarray] = []
        held, pending = None, 0

        def gather():
            nonlocal ids, held, pending
            every = np.concatenate([x for part in ids for x in (edge, part)] + [edge]) if ids else np.zeros(0, np.uint64)
            u, w = every[:-1], every[1:]
            keys, far = pair_keys(u, w, none)
            near, c = counted(keys[~far])
            far_pairs = keys[far], u[far], w[far], np.ones(int(far.sum()), np.int64)
            if held is not None:
                near, c = summed(np.concatenate([held[0][0], near]), np.concatenate([held[0][3], c]))
                far_pairs = tuple(np.concatenate(x) for x in zip(held[1], far_pairs, strict=True))
            held = [(near, near, near, c), _distinct(*far_pairs)]
            ids, pending = [], 0

        def out():
            nonlocal held
            rows = []
            for f, (keys, u, w, c) in enumerate(held or []):
                if len(keys):
                    rows += [(b, squeeze_keys(keys[at]), squeeze(u[at]) if f else b"", squeeze(w[at]) if f else b"", squeeze(c[at])) for b, at in dealt(keys, buckets)]
            held = None
            return batch_of(shape, rows)

        for batch in batches:
            for raw in binary_values(batch.column(0)):
                ids.append(reader(split_tokens(raw or b"")))
                pending += len(ids[-1]) + 1
                if pending > flush:
                    gather()
                    if sum(len(x[0]) for x in held) > flush // 2:
                        yield out()
        if ids:
            gather()
        yield out()

    def merge(table: pa.Table) -> pa.Table:
        rows = []
        bucket = table["bucket"][0].as_py()
        columns = [table[x].to_pylist() for x in ("keys", "u", "w", "c")]
        for f in (0, 1):
            mine = [i for i, u in enumerate(columns[1]) if bool(u) == bool(f)]
            if not mine:
                continue
            keys, c = np.concatenate([unsqueeze_keys(columns[0][i]) for i in mine]), np.concatenate([unsqueeze(columns[3][i], np.int64) for i in mine])
            u, w = (np.concatenate([unsqueeze(columns[x][i], np.uint64) for i in mine]) for x in (1, 2)) if f else (keys, keys)
            keys, u, w, c = _distinct(keys, u, w, c) if f else (*(x := summed(keys, c))[:1], x[0], x[0], x[1])
            for more in (0, 1):
                at = (c > 1) == bool(more)
                if at.any():
                    rows.append((bucket, f, more, squeeze_keys(keys[at]), squeeze(u[at]) if f else b"", squeeze(w[at]) if f else b"", squeeze(c[at]) if more else b"", squeeze(np.ones(int(at.sum()), np.int64)) if more else b"", squeeze(np.zeros(int(at.sum()), np.int64)) if more else b""))
        return pa.Table.from_batches([batch_of(PAIRS, rows)])

    return texts.mapInArrow(run, spark_schema(shape)).groupBy("bucket").applyInArrow(merge, spark_schema(PAIRS))


def _distinct(keys, u, w, c):
    order = np.argsort(keys)
    keys = keys[order]
    starts = _starts(keys)
    return keys[starts], u[order][starts], w[order][starts], np.add.reduceat(c[order], starts) if len(starts) else c[:0]


class Pairs:
    """A PAIRS row as arrays; u and w are ids."""

    def __init__(self, row: dict, none: int):
        self.bucket, self.far, self.more = row["bucket"], row["far"], row["more"]
        self.keys = unsqueeze_keys(row["keys"])
        self.u, self.w = (unsqueeze(row["u"], np.uint64), unsqueeze(row["w"], np.uint64)) if self.far else (self.keys // np.uint64(none + 1), self.keys % np.uint64(none + 1))
        ones = np.ones(len(self.keys), np.int64)
        self.c, self.t, self.total = (unsqueeze(row["c"], np.int64), unsqueeze(row["t"], np.int64), unsqueeze(row["total"], np.int64)) if self.more else (ones, ones, ones)

    def row(self) -> tuple:
        return self.bucket, self.far, self.more, squeeze_keys(self.keys), squeeze(self.u) if self.far else b"", squeeze(self.w) if self.far else b"", squeeze(self.c), squeeze(self.t), squeeze(self.total)


# -- the model --------------------------------------------------------------------------------------------------------

TOKENS = {"bucket": pa.int32(), "keys": pa.binary(), "c": pa.binary(), "fixed_t": pa.binary(), "fixed_c": pa.binary(), "tables": pa.binary(), "customers": pa.binary(), "above": pa.binary(), "sum_tables": pa.binary(), "sum_p": pa.binary()}


class Level:
    """Constants of the restaurant of single tokens after a sweep."""

    def __init__(self, vocabulary: int, strength: float):
        self.base, self.strength = 1.0 / (max(1, vocabulary) + 1), strength
        self.d, self.above, self.customers, self.counted = 0.5, float(vocabulary), 0.0, False

    def p(self, customers, above):
        """Probability of tokens with these customers and tables; of an unknown one with none."""
        return (np.maximum(customers - self.d * above, 0.0) + (self.strength + self.d * self.above) * self.base) / (self.strength + self.customers)


class Model:
    """Seats all restaurants of `texts` (column text) and averages them; holds what scoring needs."""

    def __init__(self, texts: DataFrame, lexicon_size: int, bucket_bytes: int, burn_in: int, sweeps: int, strength: float = 1.0):
        spark = texts.sparkSession
        self.spark, self.strength, self.sweeps = spark, strength, sweeps
        size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        self.buckets = max(16, -(-size // bucket_bytes))
        self.counts = scratch_table(count_tokens(texts, self.buckets), "tokens")
        hashes, counts, self.n_tokens, self.n_distinct = self._lexicon(lexicon_size)
        self.lexicon, self.none, self.c = spark.sparkContext.broadcast(hashes), len(hashes), counts
        self.pairs = scratch_table(count_pairs(texts, self.lexicon, self.buckets), "pairs")
        self.d = self._discount()
        self.level = Level(self.n_distinct, strength)
        self.more = self.pairs.filter("more = 1")
        self.tokens = self._seat_tokens(self._fixed(), self.more, 0)
        for sweep in range(1, burn_in + sweeps + 1):
            after = scratch_table(self._seat_pairs(sweep, sweep > burn_in), "more")
            tokens = self._seat_tokens(self.tokens, after, sweep)
            drop_scratch(self.more if sweep > 1 else None, self.tokens)
            self.more, self.tokens = after, tokens
            self.level.counted = sweep > burn_in
        self._finish()

    # the lexicon

    def _lexicon(self, most: int) -> tuple[np.ndarray, np.ndarray, int, int]:
        """Hashes (sorted) and counts of the most frequent tokens with the end's count last, and the numbers of all tokens and of different ones."""

        def bins(batches):
            for batch in batches:
                for raw in batch.column("c").to_pylist():
                    c = unsqueeze(raw, np.int64)
                    b, n = np.unique(_bin(c), return_counts=True)
                    yield batch_of({"bin": pa.int64(), "n": pa.int64(), "c": pa.int64()}, [(int(x), int(m), int(c[_bin(c) == x].sum())) for x, m in zip(b, n, strict=True)] if len(b) < 200 else _bin_sums(c, b))

        found = sorted(((r["bin"], r["n"], r["c"]) for r in self.counts.mapInArrow(bins, "bin long, n long, c long").groupBy("bin").agg(F.sum("n").alias("n"), F.sum("c").alias("c")).collect()), reverse=True)
        floor, seen = None, 0
        for b, n, _ in found:
            seen += n
            if seen > most + 1:  # the end beside
                break
            floor = b
        everything = sum(c for *_, c in found), sum(n for _, n, _ in found)

        def top(batches):
            for batch in batches:
                for raw, counts in zip(batch.column("keys").to_pylist(), batch.column("c").to_pylist(), strict=True):
                    keys, c = unsqueeze_keys(raw), unsqueeze(counts, np.int64)
                    mine = (keys == np.uint64(END)) | (_bin(c) >= floor if floor is not None else np.zeros(len(c), bool))
                    yield pa.RecordBatch.from_arrays([pa.array(keys[mine].astype(np.int64)), pa.array(c[mine])], names=["h", "c"])

        rows = self.counts.mapInArrow(top, "h long, c long").toArrow()
        hashes, counts = rows["h"].to_numpy().astype(np.uint64), rows["c"].to_numpy().astype(np.int64)
        order = np.argsort(hashes)
        hashes, counts = hashes[order], counts[order]
        if not len(hashes):
            return hashes, np.zeros(1, np.int64), *everything
        return hashes[:-1], counts, *everything  # the end has the largest key

    def _discount(self) -> float:
        def few(batches):
            for batch in batches:
                for more, keys, c in zip(batch.column("more").to_pylist(), batch.column("keys").to_pylist(), batch.column("c").to_pylist(), strict=True):
                    yield batch_of({"n1": pa.int64(), "n2": pa.int64()}, [(0, int((unsqueeze(c, np.int64) == 2).sum())) if more else (len(unsqueeze(keys, np.uint64)), 0)])

        n1, n2 = self.pairs.select("more", "keys", "c").mapInArrow(few, "n1 long, n2 long").agg(F.sum("n1"), F.sum("n2")).first()
        return discount_of(n1 or 0, n2 or 0)

    # tokens

    def _token_sums(self, pairs: DataFrame) -> DataFrame:
        """(bucket, keys, t, c) of tokens' buckets: tables in a token's restaurant, tables that serve it."""
        none, buckets = self.none, self.buckets
        shape = {"bucket": pa.int32(), "keys": pa.binary(), "t": pa.binary(), "c": pa.binary()}

        def run(batches):
            for batch in batches:
                for row in batch.to_pylist():
                    p = Pairs(row, none)
                    nothing = np.zeros(len(p.t), np.int64)
                    keys, t, c = summed(np.concatenate([p.u, p.w]), np.concatenate([p.t, nothing]), np.concatenate([nothing, p.t]))
                    yield batch_of(shape, [(b, squeeze_keys(keys[at]), squeeze(t[at]), squeeze(c[at])) for b, at in dealt(keys, buckets, none)])

        return pairs.mapInArrow(run, spark_schema(shape))

    def _fixed(self) -> DataFrame:
        """TOKENS rows with what pairs counted once give, by id."""
        lexicon, none, buckets = self.lexicon, self.none, self.buckets
        shape = {"bucket": pa.int32(), "keys": pa.binary(), "c": pa.binary()}

        def named(batches):
            for batch in batches:
                for raw, counts in zip(batch.column("keys").to_pylist(), batch.column("c").to_pylist(), strict=True):
                    keys, c = unsqueeze_keys(raw), unsqueeze(counts, np.int64)
                    at, inside = looked_up(lexicon.value, keys)
                    keys = np.where(keys == np.uint64(END), np.uint64(none), np.where(inside, at.astype(np.uint64), keys | _FAR))
                    order = np.argsort(keys)
                    keys, c = keys[order], c[order]
                    yield batch_of(shape, [(b, squeeze_keys(keys[x]), squeeze(c[x])) for b, x in dealt(keys, buckets, none)])

        def run(table: pa.Table, sums: pa.Table) -> pa.Table:
            if not table.num_rows:
                return pa.Table.from_batches([batch_of(TOKENS, [])])
            keys, count = summed(np.concatenate([unsqueeze_keys(x) for x in table["keys"].to_pylist()]), np.concatenate([unsqueeze(x, np.int64) for x in table["c"].to_pylist()]))
            t, c = _sums_at(keys, sums)
            zero, nothing = np.zeros(len(keys), np.int64), np.zeros(len(keys))
            return pa.Table.from_batches([batch_of(TOKENS, [(table["bucket"][0].as_py(), squeeze_keys(keys), *map(squeeze, (count, t, c, zero, zero, zero, nothing, nothing)))])])

        tokens = self.counts.select("keys", "c").mapInArrow(named, spark_schema(shape))
        return tokens.groupBy("bucket").cogroup(self._token_sums(self.pairs.filter("more = 0")).groupBy("bucket")).applyInArrow(run, spark_schema(TOKENS))

    def _seat_tokens(self, tokens: DataFrame, more: DataFrame, sweep: int) -> DataFrame:
        """TOKENS rows (scratch) with the customers that `more` gives, seated; the sums take up the sweep before if it counted. Then the level's constants and the lexicon's values."""
        level, counted = self.level, self.level.counted

        def run(table: pa.Table, sums: pa.Table) -> pa.Table:
            if not table.num_rows:
                return pa.Table.from_batches([batch_of(TOKENS, [])])
            x = _token_row(table.to_pylist()[0])
            if counted:
                x["sum_tables"] += x["tables"]
                x["sum_p"] += level.p(x["customers"], x["above"])
            t, c = _sums_at(x["keys"], sums)
            x["tables"], x["customers"] = x["fixed_t"] + t, x["fixed_c"] + c
            x["above"] = seat(x["keys"], x["customers"], np.full(len(t), (level.strength + level.d * level.above) * level.base), level.d, 2 * sweep)
            return pa.Table.from_batches([batch_of(TOKENS, [(table["bucket"][0].as_py(), squeeze_keys(x["keys"]), *(squeeze(x[name]) for name in list(TOKENS)[2:]))])])

        out = scratch_table(tokens.groupBy("bucket").cogroup(self._token_sums(more).groupBy("bucket")).applyInArrow(run, spark_schema(TOKENS)), "tokens")
        self._values(out)
        return out

    def _values(self, tokens: DataFrame) -> None:
        """The level's constants, and tables and parent's probabilities of the lexicon and the end."""
        none = self.none

        def run(batches):
            for batch in batches:
                for row in batch.to_pylist():
                    x = _token_row(row)
                    at, inside = x["keys"], x["keys"] <= none
                    few = np.bincount(np.minimum(x["customers"], 3), minlength=4)
                    totals = [x["above"].sum(), x["customers"].sum(), few[1], few[2]]
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate((np.arange(-4, 0), at[inside])).astype(np.int32)), pa.array(np.concatenate((totals, x["tables"][inside])).astype(np.int64)), pa.array(np.concatenate((np.zeros(4), x["customers"][inside])).astype(np.int64)), pa.array(np.concatenate((np.zeros(4), x["above"][inside])).astype(np.int64))], names=["at", "tables", "customers", "above"])

        found = tokens.mapInArrow(run, "at int, tables long, customers long, above long").groupBy("at").agg(*[F.sum(x).alias(x) for x in ("tables", "customers", "above")]).toArrow()
        at, tables, customers, above = (found[x].to_numpy() for x in ("at", "tables", "customers", "above"))
        totals = dict(zip(at[at < 0].tolist(), tables[at < 0].tolist(), strict=True))
        level = Level(self.n_distinct, self.strength)
        level.above, level.customers = float(totals.get(-4, 0)), float(totals.get(-3, 0))
        level.d = discount_of(totals.get(-2, 0), totals.get(-1, 0))
        self.level = level
        inside = at >= 0
        self.tables, p = np.zeros(self.none + 1), np.full(self.none + 1, level.p(0.0, 0.0))
        self.tables[at[inside]] = tables[inside]
        p[at[inside]] = level.p(customers[inside], above[inside])
        self.parents = p

    # pairs

    def _with_far(self, pairs: DataFrame, tokens: DataFrame, work, shape: dict, values) -> DataFrame:
        """`work(Pairs, tables of u, probability of w)` on all rows of `pairs`: from the lexicon's arrays, and for far pairs from the tokens' buckets.

        `values` gives tables and probabilities of a TOKENS row.
        """
        lexicon, none, buckets = self.lexicon, self.none, self.buckets
        tools = self.spark.sparkContext.broadcast((self.tables, self.parents))

        def near(batches):
            for batch in batches:
                for row in batch.to_pylist():
                    p = Pairs(row, none)
                    yield batch_of(shape, [work(p, tools.value[0][p.u.astype(np.int64)], tools.value[1][p.w.astype(np.int64)])])

        done = pairs.filter("far = 0").mapInArrow(near, spark_schema(shape))
        asks = {"bucket": pa.int32(), "who": pa.int32(), "keys": pa.binary()}
        answers = {"who": pa.int32(), "keys": pa.binary(), "tables": pa.binary(), "p": pa.binary()}

        def ask(batches):
            for batch in batches:
                for row in batch.to_pylist():
                    p = Pairs(row, none)
                    ids = np.unique(np.concatenate([p.u, p.w]))
                    keys = ids[(ids & _FAR) > 0]
                    yield batch_of(asks, [(b, row["bucket"], squeeze_keys(keys[at])) for b, at in dealt(keys, buckets, none)])

        def answer(asked: pa.Table, table: pa.Table) -> pa.Table:
            rows = []
            if asked.num_rows:
                x = _token_row(table.to_pylist()[0])
                tables, p = values(x)
                for who, raw in zip(asked["who"].to_pylist(), asked["keys"].to_pylist(), strict=True):
                    at, _ = looked_up(x["keys"], unsqueeze_keys(raw))
                    rows.append((who, raw, squeeze(tables[at].astype(np.float64)), squeeze(p[at])))
            return pa.Table.from_batches([batch_of(answers, rows)])

        far = pairs.filter("far = 1")
        replies = far.mapInArrow(ask, spark_schema(asks)).groupBy("bucket").cogroup(tokens.groupBy("bucket")).applyInArrow(answer, spark_schema(answers))

        def finish(mine: pa.Table, found: pa.Table) -> pa.Table:
            rows = []
            if mine.num_rows:
                keys, tables, p = (np.concatenate([f(x) for x in found[c].to_pylist()]) for c, f in (("keys", unsqueeze_keys), ("tables", lambda x: unsqueeze(x, np.float64)), ("p", lambda x: unsqueeze(x, np.float64))))
                order = np.unique(keys, return_index=True)[1]  # rows counted once and more of a bucket may ask for the same token
                keys, tables, p = keys[order], tables[order], p[order]
                for row in mine.to_pylist():
                    x = Pairs(row, none)
                    ends = []
                    for ids, broadcast, away in ((x.u, tools.value[0], tables), (x.w, tools.value[1], p)):
                        is_far = (ids & _FAR) > 0
                        at, _ = looked_up(keys, ids)
                        ends.append(np.where(is_far, away[at], broadcast[np.where(is_far, 0, ids).astype(np.int64)]))
                    rows.append(work(x, *ends))
            return pa.Table.from_batches([batch_of(shape, rows)])

        return done.union(far.groupBy("bucket").cogroup(replies.groupBy("who")).applyInArrow(finish, spark_schema(shape)))

    def _seat_pairs(self, sweep: int, counted: bool) -> DataFrame:
        d, strength, level = self.d, self.strength, self.level

        def work(p: Pairs, tables: np.ndarray, parent: np.ndarray) -> tuple:
            p.t = seat(p.keys, p.c, (strength + d * (tables - p.t)) * parent, d, 2 * sweep + 1)
            if counted:
                p.total = p.total + p.t
            return p.row()

        return self._with_far(self.more, self.tokens, work, PAIRS, lambda x: (x["tables"], level.p(x["customers"], x["above"])))

    def _finish(self) -> None:
        """Averages of the lexicon: mean tables and probabilities; a last level for tokens' buckets."""
        level, sweeps, none = self.level, self.sweeps, self.none
        # the last sweep isn't in the sums yet
        self.means = lambda x: ((x["sum_tables"] + x["tables"]) / sweeps, (x["sum_p"] + level.p(x["customers"], x["above"])) / sweeps)
        means = self.means

        def run(batches):
            for batch in batches:
                for row in batch.to_pylist():
                    x = _token_row(row)
                    tables, p = means(x)
                    at, inside = x["keys"], x["keys"] <= none
                    yield pa.RecordBatch.from_arrays([pa.array(at[inside].astype(np.int32)), pa.array(tables[inside]), pa.array(p[inside])], names=["at", "tables", "p"])

        # an unknown token's probability hardly changes from sweep to sweep: what is left of one
        found = self.tokens.mapInArrow(run, "at int, tables double, p double").toArrow()
        at = found["at"].to_numpy()
        self.tables, self.parents = np.zeros(self.none + 1), np.ones(self.none + 1)
        self.tables[at], self.parents[at] = found["tables"].to_numpy(), found["p"].to_numpy()

        def total(batches):
            for batch in batches:
                for row in batch.to_pylist():
                    yield batch_of({"p": pa.float64()}, [(float(means(_token_row(row))[1].sum()),)])

        self.p_unknown = max(1.0 - (self.tokens.mapInArrow(total, "p double").agg(F.sum("p")).first()[0] or 0.0), 1e-300) if self.n_tokens else 0.5
        if not self.n_tokens:
            self.parents[:] = 0.5

    def gains(self, least: int = 1) -> DataFrame:
        """(bucket, keys, c, gain): what pairs add to a text's score, in steps of 2^-20; only pairs counted `least` times or more, if that is more than once."""
        d, strength, sweeps = self.d, self.strength, self.sweeps
        shape = {"bucket": pa.int32(), "keys": pa.binary(), "c": pa.binary(), "gain": pa.binary()}

        def work(p: Pairs, tables: np.ndarray, parent: np.ndarray) -> tuple:
            mean = p.total / sweeps if p.more else np.ones(len(p.keys))
            gain = np.log10(1 + (p.c - d * mean) / ((strength + d * tables) * parent))
            return p.bucket, squeeze_keys(p.keys), squeeze(p.c), squeeze(np.round(gain * _STEP).astype(np.int64))

        some = self.more if least > 1 else self.pairs.filter("more = 0").union(self.more)
        return self._with_far(some, self.tokens, work, shape, self.means)

    def drop(self) -> None:
        drop_scratch(self.counts)


def _token_row(row: dict) -> dict[str, np.ndarray]:
    return {"keys": unsqueeze_keys(row["keys"]), **{x: unsqueeze(row[x], np.float64 if x in ("sum_tables", "sum_p") else np.int64) for x in list(TOKENS)[2:]}}


def _sums_at(keys: np.ndarray, sums: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    t, c = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
    for raw, more_t, more_c in zip(sums["keys"].to_pylist(), sums["t"].to_pylist(), sums["c"].to_pylist(), strict=True):
        at, _ = looked_up(keys, unsqueeze_keys(raw))
        t[at] += unsqueeze(more_t, np.int64)
        c[at] += unsqueeze(more_c, np.int64)
    return t, c


def _bin(c: np.ndarray) -> np.ndarray:
    """Counts below 4096 as they are, larger ones rounded down to a 64th of a power of two: only to find which tokens are broadcast."""
    return np.where(c < 4096, c, np.floor(2.0 ** (np.floor(np.log2(np.maximum(c, 1)) * 64 + 1e-9) / 64)).astype(np.int64))


def _bin_sums(c: np.ndarray, bins: np.ndarray) -> list[tuple[int, int, int]]:
    at = np.searchsorted(bins, _bin(c))
    return list(zip(bins.tolist(), np.bincount(at).tolist(), np.bincount(at, c).astype(np.int64).tolist(), strict=True))


# -- scoring ----------------------------------------------------------------------------------------------------------


def frequent_pairs(model: Model, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys (sorted) and gains of the most frequent pairs within the lexicon."""

    def bins(batches):
        for batch in batches:
            for raw in batch.column("c").to_pylist():
                b, n = np.unique(_bin(unsqueeze(raw, np.int64)), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(b), pa.array(n)], names=["bin", "n"])

    some = model.more.filter("far = 0")
    floor, seen = None, 0
    for b, n in sorted(((r["bin"], r["n"]) for r in some.select("c").mapInArrow(bins, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")).collect()), reverse=True):
        seen += n
        if seen > most:
            break
        floor = b
    if floor is None:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def top(batches):
        for batch in batches:
            for keys, c, gain in zip(*(batch.column(x).to_pylist() for x in ("keys", "c", "gain")), strict=True):
                mine = _bin(unsqueeze(c, np.int64)) >= floor
                yield pa.RecordBatch.from_arrays([pa.array(unsqueeze_keys(keys)[mine].astype(np.int64)), pa.array(unsqueeze(gain, np.int64)[mine])], names=["key", "gain"])

    rows = model.gains(least=2).mapInArrow(top, "key long, gain long").filter("key >= 0").toArrow()
    keys = rows["key"].to_numpy().astype(np.uint64)
    order = np.argsort(keys)
    return keys[order], rows["gain"].to_numpy()[order]


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_on: DataFrame | None = None, lexicon_size: int = 1 << 20, pairs_size: int = 1 << 19, bucket_bytes: int = 12 << 20, burn_in: int = 1, sweeps: int = 2) -> DataFrame:
    """One row per row of `docs`: id_col, n_tokens, n_known, train_tokens, base_score, score, perplexity.

    `train_on` are the rows to learn from (default: all of `docs`).
    """
    spark = docs.sparkSession
    prepare(spark)
    model = Model((docs if train_on is None else train_on).select(F.col(text_col).cast("binary").alias("text")), lexicon_size, bucket_bytes, burn_in, sweeps)
    lexicon, none, buckets, strength, d = model.lexicon, model.none, model.buckets, model.strength, model.d
    norm = model.n_tokens + model.n_distinct + 1
    top = frequent_pairs(model, pairs_size)
    # of every token of the lexicon and the end: its probability in the parent, and its restaurant's share that goes there
    plain = np.log10(model.parents) + np.log10((strength + d * model.tables) / (strength + model.c))
    tools = spark.sparkContext.broadcast((np.round(plain * _STEP).astype(np.int64), np.log10((model.c + 1) / norm), *top))
    end_known, unknown, means = int(model.c[-1] > 0), int(round(np.log10(model.p_unknown) * _STEP)), model.means
    id_type = docs.schema[id_col].dataType
    # kinds of rows: a text with its sums; keys of pairs, or of tokens, that texts of a chunk ask a bucket for; answers
    shape = {"chunk": pa.int64(), "bucket": pa.int32(), "kind": pa.int32(), "seq": pa.int32(), "id": to_arrow_type(id_type), "n_tokens": pa.int64(), "n_known": pa.int64(), "base": pa.float64(), "value": pa.int64(), "keys": pa.binary(), "texts": pa.binary()}
    kinds = ", ".join(f"{x} {id_type.simpleString() if x == 'id' else 'binary' if t == pa.binary() else 'double' if t == pa.float64() else 'long' if t == pa.int64() else 'int'}" for x, t in shape.items())
    nothing = (None, 0, 0, 0.0, 0)

    def ask(batches):
        reader, edge = Reader(lexicon.value), np.array([none], np.uint64)
        tokens, base, top_keys, top_gains = tools.value
        first, number = TaskContext.get().partitionId() << 32, 0
        ids: list[np.ndarray] = []
        names: list = []
        pending = 0

        def out():
            nonlocal ids, names, pending, number
            n, chunk = len(ids), first + number
            lengths = np.array([len(x) for x in ids], np.int64)
            every = np.concatenate([x for part in ids for x in (edge, part)] + [edge])
            # of every pair, and so of every token and end, the text it stands in
            text = np.repeat(np.arange(n, dtype=np.uint32), lengths + 1)
            u, w = every[:-1], every[1:]
            far = (w & _FAR) > 0
            near = np.where(far, 0, w).astype(np.int64)
            value = np.bincount(text, np.where(far, 0, tokens[near]), n).astype(np.int64)
            sums = np.bincount(text, np.where(far, 0.0, base[near]), n)
            known = np.bincount(text, ~far & (near < none), n).astype(np.int64) + end_known
            requests = []
            away, away_text = w[far], text[far]
            keys, _ = pair_keys(u, w, none)
            order = np.argsort(keys)
            keys, text = keys[order], text[order]
            at, hit = looked_up(top_keys, keys)
            value += np.bincount(text[hit], top_gains[at[hit]], n).astype(np.int64) if hit.any() else 0
            requests.append((1, keys[~hit], text[~hit], 0))
            order = np.argsort(away)
            requests.append((2, away[order], away_text[order], none))
            rows = [(chunk, i % buckets, 0, i, name, length + 1, k, x, v, b"", b"") for i, (name, length, k, x, v) in enumerate(zip(names, lengths.tolist(), known.tolist(), sums.tolist(), value.tolist(), strict=True))]
            for kind, k, t, within in requests:
                rows += [(chunk, b, kind, 0, *nothing, squeeze_keys(k[x]), squeeze(t[x])) for b, x in dealt(k, buckets, within)]
            ids, names, pending, number = [], [], 0, number + 1
            return batch_of(shape, rows)

        for batch in batches:
            for i, raw in enumerate(binary_values(batch.column(1))):
                ids.append(reader(split_tokens(raw or b"")))
                names.append(batch.column(0)[i].as_py())
                pending += len(ids[-1]) + 1
                if pending > 700_000 or len(ids) > 20_000:
                    yield out()
        if ids:
            yield out()

    def answer(asked: pa.Table, table: pa.Table) -> pa.Table:
        """Texts' rows as they are; for asked keys the sums by text."""
        rows, known = [], {}
        for row in asked.to_pylist():
            if not row["kind"]:
                rows.append(tuple(row.values()))
                continue
            if row["kind"] not in known:
                known[row["kind"]] = _answers(table, row["kind"])
            keys, values, c = known[row["kind"]]
            texts = unsqueeze(row["texts"], np.uint32)
            at, there = looked_up(keys, unsqueeze_keys(row["keys"]))
            if row["kind"] == 1:  # pairs never seen add nothing
                texts, sums = summed(texts[there], values[at[there]])
            else:
                value = np.where(there, values[at] if len(keys) else 0, unknown)
                base = np.log10((np.where(there, c[at] if len(keys) else 0, 0) + 1) / norm)
                texts, sums, bases, seen = summed(texts, value, base, there.astype(np.int64))
                if len(texts):
                    rows += [(row["chunk"], 0, k, 0, *nothing, squeeze(texts), squeeze(x)) for k, x in ((2, bases), (3, seen))]
            if len(texts):
                rows.append((row["chunk"], 0, 1, 0, *nothing, squeeze(texts), squeeze(sums)))
        return pa.Table.from_batches([batch_of(shape, rows)])

    def _answers(table: pa.Table, kind: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if kind == 1:
            keys, values = (np.concatenate([f(x) for x in table[c].to_pylist() if x] or [f(b"")]) for c, f in (("pair_keys", unsqueeze_keys), ("gain", lambda x: unsqueeze(x, np.int64))))
            order = np.argsort(keys)
            return keys[order], values[order], values[:0]
        for row in table.select(list(TOKENS)).to_pylist():
            if row["keys"]:
                x = _token_row(row)
                tables, p = means(x)
                return x["keys"], np.round((np.log10(p) + np.log10((strength + d * tables) / (strength + x["c"]))) * _STEP).astype(np.int64), x["c"]
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    results = {"id": shape["id"], "n_tokens": pa.int64(), "n_known": pa.int64(), "base": pa.float64(), "value": pa.int64()}

    def finish(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        texts = sorted((r for r in rows if not r["kind"]), key=lambda r: r["seq"])
        known, value, base = np.array([r["n_known"] for r in texts], np.int64), np.array([r["value"] for r in texts], np.int64), np.array([r["base"] for r in texts])
        for r in sorted((r for r in rows if r["kind"]), key=lambda r: (r["kind"], r["keys"], r["texts"])):
            at = unsqueeze(r["keys"], np.uint32).astype(np.int64)
            if r["kind"] == 2:
                base[at] += unsqueeze(r["texts"], np.float64)
            else:
                (value if r["kind"] == 1 else known)[at] += unsqueeze(r["texts"], np.int64)
        return pa.table({"id": pa.array([r["id"] for r in texts], shape["id"]), "n_tokens": pa.array([r["n_tokens"] for r in texts], pa.int64()), "n_known": pa.array(known), "base": pa.array(base), "value": pa.array(value)}, schema=pa.schema(list(results.items())))

    requests = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(ask, kinds)
    empty = F.lit(None).cast("binary")
    held = [x for x in TOKENS if x != "bucket"]
    tables = model.gains().select("bucket", *[empty.alias(x) for x in held], F.col("keys").alias("pair_keys"), "gain").union(model.tokens.select("bucket", *held, empty.alias("pair_keys"), empty.alias("gain")))
    answers = requests.groupBy("bucket").cogroup(tables.groupBy("bucket")).applyInArrow(answer, kinds)
    found = answers.groupBy("chunk").applyInArrow(finish, f"id {id_type.simpleString()}, n_tokens long, n_known long, base double, value long")
    score = F.col("value") / float(_STEP)
    model.drop()
    return found.select(F.col("id").alias(id_col), "n_tokens", "n_known", F.lit(model.n_tokens).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), score.alias("score"), F.pow(F.lit(10.0), -score / F.col("n_tokens")).alias("perplexity"))


def brute_counts(texts: list[bytes | None]) -> Counter:
    """Pairs of tokens with their counts, for tests; the beginning and the end are empty."""
    out: Counter = Counter()
    for raw in texts:
        words = split_tokens(raw or b"")
        out.update(zip([b"", *words], [*words, b""], strict=True))
    return out
