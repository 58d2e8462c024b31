"""Conversation repair: the cheapest edits that make a conversation's roles `(s?(ua)+)?`, by forward Viterbi over four grammar states.

States are what came last: nothing, system, user, assistant. Each row of a conversation, in order of turn, is kept (K, 0), given the role user or
assistant (R, 2) or deleted (D, 3; blank rows and repeats must be); a truncated row that stays costs 1 more. Behind every row's layer, empty
turns may be inserted (I, 2 each): two at most bring any state to any other worth reaching, so a layer is closed by one pass over six transitions.
Of equal costs the audit string (the edits' initials in order) that is least as ASCII wins.

Per state a layer carries the least (cost, audit). Audits are carried by their rank among the layer's four and one byte a row to find them
again: behind the same number of rows, none of two different audits that end in a row's edit begins with the other, so their order never changes when edits
are added, and comparing ranks, then the last row's edits, is comparing strings. A SHA-256 state of the repaired turns goes along in the same way.
So a conversation passes in one sweep over sorted rows: per row 4 bytes for the way back and 16 for the check of repeats are held, never texts.
A conversation's rows meet in one task, in a stream that Spark sorts and spills, because its digest is one sequence; nothing else is gathered.

Defined results: null role and null text are one space, a null conversation id is a conversation of its own, null turns come first; rows of one
turn are ordered by role, then text; repeated rows are repeats; a role is judged by its first character, case and all, and an empty one can't be kept; a conversation none of whose rows is
present gets zeros and empty strings; an empty table gives an empty table. Other columns are not read.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .common import prepare

BLANKS = " \t\n\x0b\x0c\r"
ENDS = ".!?"
START, SYSTEM, USER, ASSISTANT = range(4)
KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
COST = {KEEP: 0, REROLE: 2, DELETE: 3, INSERT: 2}
TRUNCATED = 1

#: (from, to): the roles inserted on the way
CLOSING = {(START, USER): ["user"], (START, ASSISTANT): ["user", "assistant"], (SYSTEM, USER): ["user"], (SYSTEM, ASSISTANT): ["user", "assistant"], (USER, ASSISTANT): ["assistant"], (ASSISTANT, USER): ["user"]}
#: a kept row's first character: the state before it to the state behind it
KEPT = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
#: a row with a new role: the state before it to the state behind it
REROLED = {START: USER, SYSTEM: USER, ASSISTANT: USER, USER: ASSISTANT}
ROLE = {USER: "user", ASSISTANT: "assistant"}
LEGAL = {"su", "ua", "au"}

_LETTERS = KEEP + REROLE + DELETE
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


class Viterbi:
    """One conversation's layers. `open[q]`: (cost, rank, digest) of the best way that ends in a row's edit and in state q; `closed[q]`: (cost, p, inserts)."""

    def __init__(self):
        self.open: list[tuple | None] = [(0, 0, hashlib.sha256()), None, None, None]
        self.ways = bytearray()
        self._close()

    def _close(self) -> None:
        best: list[tuple | None] = [None if x is None else (x[0], p, 0) for p, x in enumerate(self.open)]
        for (p, q), roles in CLOSING.items():
            if self.open[p] is None:
                continue
            cost = self.open[p][0] + COST[INSERT] * len(roles)
            if best[q] is None or (cost, self.open[p][1]) < (best[q][0], self.open[best[q][1]][1]):
                best[q] = (cost, p, len(roles))
        self.closed = best

    def row(self, role: str, text: str, must_go: bool, truncated: bool) -> None:
        """The next layer: every edit of the row behind every closed state."""
        found: list[tuple | None] = [None] * 4

        def offer(state: int, to: int, letter: str, extra: int) -> None:
            cost, p, k = self.closed[state]
            way = (cost + COST[letter] + extra, self.open[p][1], INSERT * k + letter, p, state)
            if found[to] is None or way < found[to]:
                found[to] = way

        kept = KEPT.get(role[:1], {})
        for state in range(4):
            if self.closed[state] is None:
                continue
            offer(state, state, DELETE, 0)
            if not must_go:
                if state in kept:
                    offer(state, kept[state], KEEP, TRUNCATED * truncated)
                offer(state, REROLED[state], REROLE, TRUNCATED * truncated)
        ranks = {q: r for r, q in enumerate(sorted((q for q in range(4) if found[q]), key=lambda q: found[q][1:3]))}
        after: list[tuple | None] = [None] * 4
        for q, way in enumerate(found):
            if way is None:
                self.ways.append(0)
                continue
            cost, _, token, p, state = way
            letter = token[-1]
            made = None if letter == DELETE else f"{role}:{text}" if letter == KEEP else f"{ROLE[q]}:{text}"
            after[q] = (cost, ranks[q], self._told(p, state, made))
            self.ways.append(p | (len(token) - 1) << 2 | _LETTERS.index(letter) << 4)
        self.open = after
        self._close()

    def _told(self, p: int, state: int, made: str | None):
        """The digest of the way to p, with the turns inserted from there to `state` and one more turn."""
        turns = [f"{r}:" for r in CLOSING[p, state]] if p != state else []
        turns += [] if made is None else [made]
        digest = self.open[p][2]
        if not turns:
            return digest  # never changed in place
        digest = digest.copy()
        digest.update((("" if p == START else "\n") + "\n".join(turns)).encode())
        return digest

    def end(self) -> tuple[int, str, str]:
        """(cost, audit, digest of the repaired turns)."""
        _, _, q = min((self.closed[q][0], self.open[self.closed[q][1]][1], q) for q in (START, ASSISTANT) if self.closed[q] is not None)
        cost, p, k = self.closed[q]
        digest = self._told(p, q, None).hexdigest()
        audit = [INSERT * k]
        for at in range(len(self.ways) - 4, -1, -4):
            way = self.ways[at + p]
            audit.append(INSERT * (way >> 2 & 3) + _LETTERS[way >> 4])
            p = way & 3
        return cost, "".join(reversed(audit)), digest


class Conversation:
    """Counts and layers of one conversation, row by row."""

    def __init__(self):
        self.first = self.last = None
        self.turns = self.rows = 0
        self.counts = dict.fromkeys(COUNTS, 0)
        self.seen: set[bytes] = set()
        self.before: str | None = None
        self.layers = Viterbi()

    def row(self, turn: int | None, role: str, text: str) -> None:
        if turn is not None and turn != self.last:
            self.first = turn if self.first is None else self.first
            self.last, self.turns = turn, self.turns + 1
        self.rows += 1
        bare = text.rstrip(BLANKS)
        key = hashlib.blake2b(f"{len(role)}:{role}{text}".encode(), digest_size=16).digest()
        fault = "blank" if not bare else "duplicate" if key in self.seen else "truncated" if bare[-1] not in ENDS else None
        self.seen.add(key)
        if fault:
            self.counts[fault] += 1
        if self.before is not None and self.before + role[:1] not in LEGAL:
            self.counts["illegal"] += 1
        self.before = role[:1]
        self.layers.row(role, text, fault in ("blank", "duplicate"), fault == "truncated")

    def end(self) -> dict:
        self.counts["cost"], audit, digest = self.layers.end()
        self.counts["gaps"] = 0 if self.first is None else self.last - self.first + 1 - self.turns
        return self.counts | {"audit": audit, "repaired_sha256": digest, "n_rows": self.rows}


def _ordered(rows: DataFrame) -> list[Column]:
    return [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]


def _filled(rows: DataFrame) -> DataFrame:
    """The columns that are read, nulls as one space; a row that isn't present only names its conversation."""
    present = F.coalesce(F.col("present"), F.lit(False)) if "present" in rows.columns else F.lit(True)
    return rows.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), present.alias("present"))


def repair(rows: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 and n_rows of each conversation of (conv_id, turn, role, text[, present])."""
    kind = rows.schema["conv_id"].dataType
    names = [*COUNTS, "audit", "repaired_sha256", "n_rows"]
    schema = StructType([StructField("conv_id", kind), *StructType.fromDDL("gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string, n_rows long").fields])

    def run(batches):
        now, ended, key_type = None, [], None
        current: Conversation | None = None

        def flush():
            return pa.RecordBatch.from_arrays([pa.array([k for k, _ in ended], key_type), *[pa.array([r[c] for _, r in ended], pa.string() if c in ("audit", "repaired_sha256") else pa.int64()) for c in names]], ["conv_id", *names])

        for batch in batches:
            key_type = batch.column(0).type
            for i in range(batch.num_rows):
                conv, turn, role, text, present = (batch.column(c)[i].as_py() for c in range(5))
                if current is None or conv != now:
                    if current is not None:
                        ended.append((now, current.end()))
                    now, current = conv, Conversation()
                if present:
                    current.row(turn, role, text)
                if len(ended) >= 1000:
                    yield flush()
                    ended = []
        if current is not None:
            ended.append((now, current.end()))
        if ended:
            yield flush()

    prepare(rows.sparkSession)
    filled = _filled(rows)
    return filled.repartition("conv_id").sortWithinPartitions("conv_id", *_ordered(filled)).mapInArrow(run, schema)


def edits(repaired: DataFrame) -> DataFrame:
    """(conv_id, position, at, edit, given) of every edit: the row it is of (from 1; an insertion: the row before) and the role it gives, null if none.

    Which role an insertion or a new role gets follows from how many turns but a leading system's came before.
    """
    schema = StructType([repaired.schema["conv_id"], *StructType.fromDDL("position long, at long, edit string, given string").fields])

    def run(batches):
        for batch in batches:
            for conv, audit, system in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                at, made, rows = 0, -1 if system.as_py() else 0, []
                for position, letter in enumerate(audit.as_py()):
                    at += letter != INSERT
                    rows.append((position, at, letter, ("user", "assistant")[made % 2] if letter in (REROLE, INSERT) else None))
                    made += letter != DELETE
                    if len(rows) == 10_000:
                        yield packed(conv, rows)
                        rows = []
                if rows:
                    yield packed(conv, rows)

    def packed(conv, rows):
        return pa.RecordBatch.from_arrays([pa.array([conv.as_py()] * len(rows), conv.type), *[pa.array([r[k] for r in rows], pa.int64() if k < 2 else pa.string()) for k in range(4)]], ["conv_id", "position", "at", "edit", "given"])

    prepare(repaired.sparkSession)
    return repaired.select("conv_id", "audit", "system").mapInArrow(run, schema)


def repaired_turns(rows: DataFrame) -> DataFrame:
    """The repaired conversations: (conv_id, position, edit, role, text), deleted rows left out.

    Edits and numbered rows meet by (conversation, row), so that no row carries a whole audit and the join deals long conversations evenly.
    """
    from pyspark.sql import Window

    found = repair(rows)
    filled = _filled(rows).filter("present")
    number = F.row_number().over(Window.partitionBy("conv_id").orderBy(*_ordered(filled)))
    numbered = filled.select("conv_id", number.cast("long").alias("at"), "role", "text")
    # the first turn that stays is a system's only if it is kept: its row's number is that of the first K, if nothing else stays before
    first = F.length(F.regexp_extract("audit", "^D*K", 0)).cast("long")
    leading = found.select("conv_id", "audit", first.alias("at")).join(numbered.filter(F.substring("role", 1, 1) == "s").select(F.col("conv_id").alias("_conv"), F.col("at").alias("_at")), (F.col("conv_id").eqNullSafe(F.col("_conv"))) & (F.col("at") == F.col("_at")), "left")
    done = edits(leading.select("conv_id", "audit", F.col("_at").isNotNull().alias("system"))).filter(F.col("edit") != DELETE)
    own = numbered.select(F.col("conv_id").alias("_conv"), F.col("at").alias("_at"), "role", "text")
    met = done.join(own, (F.col("edit") != INSERT) & done["conv_id"].eqNullSafe(F.col("_conv")) & (F.col("at") == F.col("_at")), "left")
    return met.select("conv_id", "position", "edit", F.coalesce("given", "role").alias("role"), F.coalesce("text", F.lit("")).alias("text"))


def damage(rows: DataFrame) -> DataFrame:
    """Planted faults, by crc32 of `conv_id:turn` modulo 20: 0 drops a row, 1 empties its text, 2 removes its `[.!?]`, 3 repeats it, 4 sets its role to user.

    Nulls (of ids in the checksum too) are one space. A dropped row stays as one that isn't present, so that its conversation is still named.
    """
    space = F.lit(" ")
    kind = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space)).cast("binary")) % 20
    role, text = F.coalesce(F.col("role"), space), F.coalesce(F.col("text"), space)
    return rows.select(
        "conv_id",
        "turn",
        F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate(text, ENDS, "")).otherwise(text).alias("text"),
        (kind != 0).alias("present"),
        F.explode(F.when(kind == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy"),
    ).drop("copy")
