import hashlib
import random
import re
import time
import zlib

import pytest

from stratalith.llm.conversation_repair import Conversation, damage, repair, repaired_turns

SCHEMA = "conv_id long, turn long, role string, text string, cost string, audit string"
EMPTY = hashlib.sha256(b"").hexdigest()


def damaged(rows):
    out = []
    for c, t, r, x in rows:
        r, x = (" " if v is None else v for v in (r, x))
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if kind == 1:
            x = ""
        if kind == 2:
            x = re.sub("[.!?]", "", x)
        if kind == 4:
            r = "user"
        out += [(c, t, r, x)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def cheapest(rows, musts, cut):
    """(cost, audit, turns) by trying all edits: every list of roles made so far, without states, up to the cost of deleting all."""
    most = 3 * len(rows)
    ways = {(): (0, "", [])}

    def grown(ways):
        done, new = dict(ways), ways
        for _ in range(3):  # one insertion more than any closing needs
            more = {}
            for made, (cost, audit, turns) in new.items():
                for role in ("user", "assistant"):
                    key = (*made, role[0])
                    way = (cost + 2, audit + "I", [*turns, f"{role}:"])
                    if way[0] <= most and (key not in done or way[:2] < done[key][:2]):
                        done[key] = more[key] = way
            new = more
        return done

    for (_, _, role, text), must, truncated in zip(rows, musts, cut):
        after = {}
        for made, (cost, audit, turns) in grown(ways).items():
            moves = [(made, cost + 3, "D", turns)]
            if not must:
                moves.append(((*made, role[:1] or "?"), cost + truncated, "K", [*turns, f"{role}:{text}"]))
                moves += [((*made, r[0]), cost + 2 + truncated, "R", [*turns, f"{r}:{text}"]) for r in ("user", "assistant")]
            for key, c, letter, t in moves:
                if c <= most and re.fullmatch("s?[ua]*", "".join(key)) and (key not in after or (c, audit + letter) < after[key][:2]):
                    after[key] = (c, audit + letter, t)
        ways = after
    return min((w for made, w in grown(ways).items() if re.fullmatch("(s?(ua)+)?", "".join(made))), key=lambda w: w[:2])


def brute(conv, rows):
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
    turns = {t for _, t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    seen, counts, musts, cut = set(), {"blank": 0, "duplicate": 0, "truncated": 0}, [], []
    for _, _, role, text in rows:
        inked = re.findall(r"[^\x20\x09-\x0D]", text)
        fault = "blank" if not inked else "duplicate" if (role, text) in seen else "truncated" if inked[-1] not in ".!?" else None
        seen.add((role, text))
        if fault:
            counts[fault] += 1
        musts.append(fault in ("blank", "duplicate"))
        cut.append(int(fault == "truncated"))
    illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    cost, audit, made = cheapest(rows, musts, cut)
    return (conv, gaps, *counts.values(), illegal, cost, audit, hashlib.sha256("\n".join(made).encode()).hexdigest()), made


def conversations(seed, n, most):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        for _ in range(rng.randint(1, most)):
            turn = rng.choice([None, 0, 1, 2, 3, 4, 7])
            role = rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "User", "", "a2", None])
            rows.append((c, turn, role, rng.choice(["Yes.", "No", "Why?", " ", "", None, "a.\n", "é…", "Yes. \t"])))
    return rows


def seen(df):
    return sorted(tuple(r)[:9] for r in df.collect())


def want_of(ids, rows):
    return sorted(brute(c, [r for r in rows if r[0] == c])[0] for c in ids)


def test_equals_trying_all_edits(spark):
    rows = conversations(1, 150, 5)
    found = repair(spark.createDataFrame([(*r, "x", "x") for r in rows], SCHEMA))
    clean = [tuple(" " if v is None and k > 1 else v for k, v in enumerate(r)) for r in rows]
    assert seen(found) == want_of({r[0] for r in rows}, clean)


def test_damage(spark):
    rows = conversations(2, 150, 4)
    made = damage(spark.createDataFrame([(*r, "x", "x") for r in rows], SCHEMA))
    assert sorted((tuple(r) for r in made.filter("present").drop("present").collect()), key=repr) == sorted(damaged(rows), key=repr)
    assert seen(repair(made)) == want_of({r[0] for r in rows}, damaged(rows))


def test_repaired_turns(spark):
    rows = [r for r in conversations(3, 120, 5) if None not in r[2:]] + [(None, 0, "system", "Be."), (None, 1, "assistant", "Go.")]
    got = {}
    for r in repaired_turns(spark.createDataFrame([(*r, "x", "x") for r in rows], SCHEMA)).orderBy("conv_id", "position").collect():
        got.setdefault(r["conv_id"], []).append(f"{r['role']}:{r['text']}")
    for c in {r[0] for r in rows}:
        assert got.get(c, []) == brute(c, [r for r in rows if r[0] == c])[1]
    assert got[None] == ["system:Be.", "user:", "assistant:Go."]


def test_defined_cases(spark):
    rows = [(1, None, None, None), (2, None, "user", "a."), (None, 5, "assistant", "b."), (3, 0, "user", "Hi."), (3, 0, "user", "Hi."), (3, 4, "assistant", "Ho.")]
    got = {r["conv_id"]: r for r in repair(spark.createDataFrame([(*r, "x", "x") for r in rows], SCHEMA)).collect()}
    assert (got[1]["blank"], got[1]["audit"], got[1]["repaired_sha256"], got[1]["gaps"]) == (1, "D", EMPTY, 0)
    assert (got[2]["audit"], got[2]["cost"], got[None]["audit"]) == ("KI", 2, "IK")
    assert (got[3]["audit"], got[3]["duplicate"], got[3]["gaps"], got[3]["illegal"], got[3]["cost"]) == ("KDK", 1, 3, 1, 3)
    none = repair(damage(spark.createDataFrame([], SCHEMA)))
    assert none.count() == 0
    gone = repair(spark.createDataFrame([(9, 0, "user", "a.", False)], "conv_id string, turn int, role string, text string, present boolean")).collect()
    assert [tuple(r) for r in gone] == [("9", 0, 0, 0, 0, 0, 0, "", EMPTY, 0)]


@pytest.mark.parametrize("roles", [["user", "assistant"], ["system"], ["assistant"], ["user", "user", "assistant", "tool"]])
def test_long_conversation_is_linear(roles):
    took = []
    for n in (5_000, 20_000):
        c = Conversation()
        began = time.perf_counter()
        for i in range(n):
            c.row(i, roles[i % len(roles)], f"Text {i}." if i % 7 else "same.")
        end = c.end()
        took.append(time.perf_counter() - began)
        assert len(end["audit"].replace("I", "")) == n and end["n_rows"] == n
    assert took[1] < 12 * took[0]
