"""SentencePiece encoding and decoding; giant documents by a max-plus parallel scan over chunks.

The pieces of a BPE model that encode a text are the only sequence in which every piece is its own encoding and no two
neighbours would have been merged otherwise ("compatible"). So encoding is a best path in the max-plus semiring with weight 0
for compatible neighbours and minus infinity for others; the state at a place is the piece that ends or straddles there. A giant
document is split into chunks; each chunk's task finds, for every state at its left edge, the states it can
reach at its right edge (its transfer matrix). Matrices are combined associatively per document, the one path with finite
weight fixes the state at every edge, and each chunk is then backtraced alone between its two states.

No piece crosses from another character to the space mark, nor holds a line feed (checked when the model is loaded), so all
paths meet at such cuts: a chunk with cuts only needs the lattice left of its first and right of its last cut; the
units between cuts, like all of a document that fits one chunk, are encoded by the library and remembered.

Defined results: null or empty text has no ids and decodes to the empty string; ids equal the library's. A text with
a literal U+2581 decodes to spaces there, as the library has it. Of equally ranked merges the leftmost comes first, as in the library. Repeated rows
are encoded row by row; an empty table gives an empty result; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, scratch_table, text_values

#: Where the vocabulary files of public tokenizers are; a parameter of every function here.
MODEL = os.environ.get("STRATALITH_SENTENCEPIECE", "/opt/tokenizers/piece_bpe_32k.model")
MARK = "▁"
_UNITS = re.compile("\n|▁*[^▁\n]+|▁+")
#: Characters of stretches between cuts whose ids a worker remembers (about 120,000 words), and the longest stretch among them.
_KEPT_CHARS, _LONGEST_UNIT = 1_000_000, 64


class Model:
    """A BPE model: library, vocabulary, compatibility of neighbours."""

    loaded: dict[str, Model] = {}

    @classmethod
    def at(cls, path: str) -> Model:
        if path not in cls.loaded:
            cls.loaded[path] = cls(path)
        return cls.loaded[path]

    def __init__(self, path: str):
        import sentencepiece

        self.lib = sentencepiece.SentencePieceProcessor(model_file=path)
        size = self.lib.get_piece_size()
        names = [self.lib.id_to_piece(i) for i in range(size)]
        self.bytes_at = {}
        self.ids, self.rank, self.raw = {}, {}, []
        for i, name in enumerate(names):
            if self.lib.is_byte(i):
                self.bytes_at[int(name[3:5], 16)] = i
                self.raw.append(bytes([int(name[3:5], 16)]))
            elif self.lib.is_control(i) or self.lib.is_unknown(i):
                self.raw.append(b"")
            else:
                self.ids[name] = i
                self.rank[name] = -self.lib.get_score(i)
                self.raw.append(name.replace(MARK, " ").encode())
        if any(MARK in n.lstrip(MARK) or "\n" in n for n in self.ids):
            raise ValueError("this model has pieces across cuts")
        self.longest = max(map(len, self.ids))
        self.units: dict[str, bytes] = {}
        self.held = 0
        self.fits: dict[tuple[str, str], bool] = {}
        self.own: dict[str, bool] = {}
        self.head = len(self.lib.encode("\n"))

    # -- encoding by cuts ---------------------------------------------------------------------------------------------

    def ids_of(self, units: list[str]) -> dict[str, bytes]:
        """The ids of `units` (stretches between cuts) as int32 bytes; short ones are remembered in self.units."""
        new = [u for u in set(units) if u not in self.units]
        if self.held > _KEPT_CHARS:
            self.units.clear()
            self.held = 0
            new = list(set(units))
        long_ones: dict[str, bytes] = {}
        for at in range(0, len(new), 10_000):
            part = new[at : at + 10_000]
            for u, ids in zip(part, self.lib.encode(["\n" + u for u in part], num_threads=1), strict=True):
                into = self.units if len(u) <= _LONGEST_UNIT and self.held <= 2 * _KEPT_CHARS else long_ones
                into[u] = np.array(ids[self.head :], dtype=np.int32).tobytes()
                if into is self.units:
                    self.held += len(u)
        return long_ones

    def encode(self, text: str) -> np.ndarray:
        if not text:
            return np.empty(0, np.int32)
        return self.encode_marked(MARK + text.replace(" ", MARK))

    def encode_marked(self, marked: str) -> np.ndarray:
        """Ids of a stretch that begins and ends at cuts, spaces already marked."""
        units = _UNITS.findall(marked)
        try:
            return np.frombuffer(b"".join(map(self.units.__getitem__, units)), np.int32)
        except KeyError:
            more = self.ids_of(units)
            return np.frombuffer(b"".join([self.units[u] if u in self.units else more[u] for u in units]), np.int32)

    def decode(self, ids: np.ndarray) -> str:
        if not len(ids):
            return ""
        text = b"".join(map(self.raw.__getitem__, ids.tolist())).decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text

    # -- the lattice --------------------------------------------------------------------------------------------------

    def merged(self, text: str) -> list[str]:
        """Pieces of a short text by merging the best-ranked, leftmost neighbours."""
        parts = list(text)
        while len(parts) > 1:
            best = min(((self.rank[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in self.rank), default=None)
            if best is None:
                break
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def compatible(self, a: str, b: str) -> bool:
        if a == "":
            return True
        key = (a, b)
        if key not in self.fits:
            if len(self.fits) > 200_000:
                self.fits.clear()
            self.fits[key] = self.merged(a + b) == [a, b]
        return self.fits[key]

    def starting(self, s: str, p: int) -> list[str]:
        """Pieces (or a lone unknown character) that begin at s[p]."""
        out = [s[p]]
        for e in range(p + 2, min(p + self.longest, len(s)) + 1):
            piece = s[p:e]
            if piece in self.rank:
                if piece not in self.own:
                    self.own[piece] = self.merged(piece) == [piece]
                if self.own[piece]:
                    out.append(piece)
        return out

    def forward(self, s: str, entries: list[tuple[int, str]], end: int) -> list[dict[str, int]]:
        """For each place, the pieces ending there and, as bits, the entries they can be reached from."""
        at: list[dict[str, int]] = [{} for _ in range(len(s) + 1)]
        for bit, (place, piece) in enumerate(entries):
            at[place][piece] = at[place].get(piece, 0) | 1 << bit
        for p in range(min((e[0] for e in entries), default=end), end):
            if at[p]:
                for piece in self.starting(s, p):
                    mask = 0
                    for last, bits in at[p].items():
                        if self.compatible(last, piece):
                            mask |= bits
                    if mask:
                        at[p + len(piece)][piece] = at[p + len(piece)].get(piece, 0) | mask
        return at

    def path(self, s: str, entry: tuple[int, str], exit_: tuple[int, str]) -> list[str]:
        """The pieces from just behind `entry` up to `exit_`, its piece included."""
        at, out = self.forward(s, [entry], exit_[0]), []
        place, piece = exit_
        while place > entry[0]:
            out.append(piece)
            place -= len(piece)
            if place <= entry[0]:
                break
            piece = next(x for x in at[place] if self.compatible(x, piece))
        return out[::-1]

    def piece_ids(self, pieces: list[str]) -> list[int]:
        return [i for p in pieces for i in ([self.ids[p]] if p in self.ids else [self.bytes_at[b] for b in p.encode("utf-8", "replace")])]


# A chunk's text is left context + own characters + right context; places count from its own first character.


def is_cut(s: str, at: int) -> bool:
    return (s[at : at + 1] == MARK and s[at - 1] != MARK) or s[at - 1] == "\n" or s[at : at + 1] == "\n"


def edge_states(model: Model, s: str, edge: int) -> list[tuple[int, str]]:
    """Possible states at `edge`: (place where the piece ends, piece) with the piece beginning before the edge; one nameless state at a cut."""
    if is_cut(s, edge):
        return [(edge, "")]
    return [(p + len(x), x) for p in range(max(0, edge - model.longest), edge) for x in model.starting(s, p) if p + len(x) >= edge]


def inner_cuts(s: str, begin: int, end: int) -> tuple[int, int] | None:
    """First and last cut of s at or behind `begin` and before or at `end`."""
    pattern = re.compile(f"(?<=[^{MARK}])(?={MARK})|(?<=\n)|(?=\n)")
    first = pattern.search(s, max(begin, 1), end + 1)
    if not first or first.start() > end:
        return None
    last = first.start()
    for at in range(end, last, -1):
        if is_cut(s, at):
            last = at
            break
    return first.start(), last


def transfer(model: Model, s: str, begin: int, end: int, first: bool, last: bool) -> list[tuple[int, str, int, str]]:
    """Finite entries of a chunk's matrix: (entry place, entry piece, exit place, exit piece), places from the edges they lie at."""
    entries = [(begin, "")] if first else edge_states(model, s, begin)
    cuts = inner_cuts(s, begin + (0 if first else model.longest), end)
    if cuts is None:
        at = model.forward(s, entries, end)
        return [(e[0] - begin, e[1], place - end, piece) for place in range(end, len(s) + 1) for piece, bits in at[place].items() for bit, e in enumerate(entries) if bits >> bit & 1 and (not last or place == end)]
    at = model.forward(s, entries, cuts[0])
    alive = 0
    for bits in at[cuts[0]].values():
        alive |= bits
    tail = model.forward(s, [(cuts[1], "")], end)
    exits = [(place - end, piece) for place in range(end, len(s) + 1) for piece in tail[place] if not last or place == end]
    return [(e[0] - begin, e[1], *x) for bit, e in enumerate(entries) if alive >> bit & 1 for x in exits]


def combine(a: dict[tuple[int, str], set], b: dict[tuple[int, str], set]) -> dict[tuple[int, str], set]:
    """Max-plus product of two matrices with weights 0 and minus infinity, kept as the finite places of each row."""
    return {x: out for x, ys in a.items() if (out := set().union(*(b.get(y, ()) for y in ys)))}


def edges_of(matrices: list[list[tuple[int, str, int, str]]]) -> list[tuple[tuple[int, str], tuple[int, str]]]:
    """The entry and exit state of every chunk on the one finite path."""
    rows = []
    for m in matrices:
        table: dict[tuple[int, str], set] = defaultdict(set)
        for a, p, b, q in m:
            table[a, p].add((b, q))
        rows.append(dict(table))
    suffix = [rows[-1]]
    for m in reversed(rows[:-1]):
        suffix.append(combine(m, suffix[-1]))
    suffix.reverse()  # suffix[k]: chunks k to the end
    state, out = (0, ""), []
    for k, m in enumerate(rows):
        onward = [y for y in m[state] if k + 1 == len(rows) or y in suffix[k + 1]]
        if len(onward) != 1:
            raise ValueError(f"{len(onward)} finite paths at the edge behind chunk {k}")
        out.append((state, onward[0]))
        state = onward[0]
    return out


def backtrace(model: Model, s: str, begin: int, end: int, entry: tuple[int, str], exit_: tuple[int, str], first: bool) -> list[int]:
    """Ids of the pieces behind the entry state up to the exit state's piece."""
    start, stop = (begin + entry[0], entry[1]), (end + exit_[0], exit_[1])
    cuts = inner_cuts(s, begin + (0 if first else model.longest), end)
    if cuts is None:
        return model.piece_ids(model.path(s, start, stop))
    head: list[str] = []
    if cuts[0] > start[0]:
        at = model.forward(s, [start], cuts[0])
        head = model.path(s, start, (cuts[0], one_of(model, at, s, start, cuts[0])))
    tail = model.path(s, (cuts[1], ""), stop) if stop[0] > cuts[1] else []
    return [*model.piece_ids(head), *model.encode_marked(s[cuts[0] : cuts[1]]).tolist(), *model.piece_ids(tail)]


def one_of(model: Model, at: list[dict[str, int]], s: str, start: tuple[int, str], place: int) -> str:
    """The piece that ends at a cut; there is one, as text up to a cut has one encoding."""
    if len(at[place]) != 1:
        raise ValueError(f"{len(at[place])} pieces end at a cut")
    return next(iter(at[place]))


_MATRIX = pa.list_(pa.struct([("a", pa.int32()), ("p", pa.string()), ("b", pa.int32()), ("q", pa.string())]))


def id_lists(found: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([len(x) for x in found]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found) if found else np.empty(0, np.int32), pa.int32()))


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model_file: str = MODEL, giant_chars: int = 65_536, chunk_chars: int = 32_768, decoded: bool = False) -> DataFrame:
    """One row per document: id_col, ids array<int>.

    Documents up to `giant_chars` are encoded where they are read: a switch of path, for memory, that changes no id. Longer ones are dealt out as chunks over all tasks; only
    chunk edges and ids are shuffled beyond that. Documents are told apart by row, not by id, so repeated ids are fine. With `decoded`,
    rows have the columns of with_decoded as well, made where the ids are: one Python worker a task instead of two.
    """
    if chunk_chars < 64:
        raise ValueError("chunks must be longer than pieces")
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    length = F.coalesce(F.char_length("text"), F.lit(0))

    def short(batch):
        model = Model.at(model_file)
        for part in (batch.slice(i, 1000) for i in range(0, batch.num_rows, 1000)):
            ids = id_lists([model.encode(t or "") for t in text_values(part.column(1))])
            more = decoded_columns(model, ids) if decoded else {}
            yield pa.RecordBatch.from_arrays([part.column(0), ids, *more.values()], names=["id", "ids", *more])

    plain = map_batches(rows.filter(length <= giant_chars), ["id", "text"], short, f"id {kind}, ids array<int>" + (f", {_DECODED}" if decoded else ""))
    giants = rows.filter(length > giant_chars)

    def split(batch):
        side = Model.at(model_file).longest
        for i, text in enumerate(text_values(batch.column(1))):
            s = MARK + text.replace(" ", MARK)
            n = -(-len(s) // chunk_chars)
            cuts = [(k * chunk_chars, min(len(s), (k + 1) * chunk_chars)) for k in range(n)]
            yield pa.RecordBatch.from_arrays(
                [pa.repeat(batch.column(2)[i], n), batch.column(0).take(pa.array([i] * n)), pa.array(range(n), pa.int32()), pa.array([n] * n, pa.int32()), pa.array([min(b, side) for b, _ in cuts], pa.int32()), pa.array([e - b for b, e in cuts], pa.int32()), pa.array([s[max(0, b - side) : e + side] for b, e in cuts], pa.string())],
                names=["row", "id", "k", "n", "left", "own", "s"],
            )

    chunks = scratch_table(map_batches(giants.withColumn("row", F.monotonically_increasing_id()), ["id", "text", "row"], split, f"row long, id {kind}, k int, n int, left int, own int, s string").repartition(F.col("row"), F.col("k")), "chunks")

    def matrices(batch):
        model = Model.at(model_file)
        found = []
        for k, n, left, own, s in zip(*(batch.column(c).to_pylist() for c in ("k", "n", "left", "own", "s")), strict=True):
            found.append([{"a": a, "p": p, "b": b, "q": q} for a, p, b, q in transfer(model, s, left, left + own, k == 0, k + 1 == n)])
        yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("k"), pa.array(found, _MATRIX)], names=["row", "k", "m"])

    tables = map_batches(chunks, ["row", "k", "n", "left", "own", "s"], matrices, "row long, k int, m array<struct<a:int,p:string,b:int,q:string>>")
    # a document's matrices: a few states for each chunk_chars characters of it
    gathered = tables.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("k", "m"))).alias("ms"))

    def scan(batch):
        out: dict[str, list] = {x: [] for x in ("row", "k", "a", "p", "b", "q")}
        for row, ms in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for x, (entry, exit_) in enumerate(edges_of([[(r["a"], r["p"], r["b"], r["q"]) for r in m["m"]] for m in ms])):
                for name, v in zip(out, (row, x, *entry, *exit_), strict=True):
                    out[name].append(v)
        yield pa.RecordBatch.from_arrays([pa.array(out[x], t) for x, t in zip(out, (pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.string()), strict=True)], names=list(out))

    edges = map_batches(gathered, ["row", "ms"], scan, "row long, k int, a int, p string, b int, q string")

    def back(batch):
        model = Model.at(model_file)
        found = []
        for k, left, own, s, a, p, b, q in zip(*(batch.column(c).to_pylist() for c in ("k", "left", "own", "s", "a", "p", "b", "q")), strict=True):
            found.append(np.array(backtrace(model, s, left, left + own, (a, p), (b, q), k == 0), np.int32))
        yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("id"), batch.column("k"), id_lists(found)], names=["row", "id", "k", "ids"])

    traced = map_batches(chunks.join(edges, ["row", "k"]), ["row", "id", "k", "left", "own", "s", "a", "p", "b", "q"], back, f"row long, id {kind}, k int, ids array<int>")
    whole = traced.groupBy("row").agg(F.first("id", ignorenulls=True).alias("id"), F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("k", "ids"))), lambda x: x["ids"])).alias("ids")).select("id", "ids")
    whole = with_decoded(whole, "id", model_file) if decoded else whole
    return plain.union(whole).withColumnRenamed("id", id_col)


def decode_documents(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", model_file: str = MODEL) -> DataFrame:
    """One row per row of `encoded`: id_col, text."""

    def fn(batch):
        model = Model.at(model_file)
        ids = batch.column(1)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([model.decode(np.array(ids[i].as_py() or [], np.int32)) for i in range(len(ids))], pa.string())], names=[id_col, "text"])

    return map_batches(encoded, [id_col, ids_col], fn, f"`{id_col}` {encoded.schema[id_col].dataType.simpleString()}, text string")


def with_decoded(encoded: DataFrame, id_col: str = "doc_id", model_file: str = MODEL) -> DataFrame:
    """`encoded` with n_tokens and the SHA-256 and length of the decoded text, for round-trip checks without a copy of all texts."""

    def fn(batch):
        more = decoded_columns(Model.at(model_file), batch.column(1))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *more.values()], names=[id_col, "ids", *more])

    return map_batches(encoded, [id_col, "ids"], fn, f"`{id_col}` {encoded.schema[id_col].dataType.simpleString()}, ids array<int>, {_DECODED}")


_DECODED = "n_tokens long, decoded_chars long, decoded_sha256 string"


def decoded_columns(model: Model, lists: pa.Array) -> dict[str, pa.Array]:
    """n_tokens, decoded_chars and decoded_sha256 of lists of ids, one text at a time."""
    flat, offsets = lists.flatten().to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
    offsets = offsets - offsets[0]
    chars, digests = [], []
    for a, b in zip(offsets, offsets[1:], strict=False):
        text = model.decode(flat[a:b])
        chars.append(len(text))
        digests.append(hashlib.sha256(text.encode("utf-8", "replace")).hexdigest())
    return {"n_tokens": pa.array(np.diff(offsets), pa.int64()), "decoded_chars": pa.array(chars, pa.int64()), "decoded_sha256": pa.array(digests, pa.string())}
