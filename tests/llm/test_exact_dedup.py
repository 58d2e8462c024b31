import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratalith.llm import exact_dedup as E


def normal(text):
    return re.sub(r"[\x20\x09-\x0d]+", " ", text or "")


def brute(rows):
    groups = {}
    for at, (i, t) in enumerate(rows):
        groups.setdefault(normal(t), []).append((i is None, i or 0, at))
    out = []
    for at, (i, t) in enumerate(rows):
        g = groups[normal(t)]
        none, first, loc = min(g)
        out.append((i, None if none else first, len(g), at == loc, hashlib.sha256(normal(t).encode()).hexdigest()))
    return sorted(out, key=repr)


def result(df):
    return sorted((tuple(r) for r in df.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()), key=repr)


def rows_of(seed=5):
    rng = random.Random(seed)
    texts = ["a b", "a  b", "a\tb\n", " a b", "a b", "A b", "", None, " ", "\n\n", "é", "x" * 200_000, "x" * 200_000 + " "] + [f"text {k}" for k in range(80)]
    rows = [(rng.randint(-50, 200), rng.choice(texts)) for _ in range(600)] + [(None, "a b"), (None, "only null"), (None, "only null"), (7, "same"), (7, "same"), (7, "same")]
    return rows


@pytest.mark.parametrize("past", [None, "true", "false", "id % 3 = 0", "cast(null as boolean)"])
def test_equals_brute_force(spark, docs_of, past):
    rows = rows_of()
    docs = docs_of(rows, extra="digest string, size string, keep_id string, kept string").coalesce(1)
    found = E.deduplicate(docs, history=None if past is None else F.expr(past))
    assert found.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    got, want = result(found), brute(rows)
    assert got == want
    assert sum(r[3] for r in got) == len({normal(t) for _, t in rows})


def test_heavy_groups(spark):
    docs = spark.range(6000).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN 'hot  text' WHEN id % 3 = 1 THEN 'hot text' ELSE concat('cold ', id) END AS text")
    got = E.deduplicate(docs).groupBy("keep_id", "group_size").agg(F.count("*").alias("n"), F.sum(F.col("kept").cast("int")).alias("kept")).collect()
    assert len(got) == 2001 and all(r["n"] == r["group_size"] and r["kept"] == 1 for r in got)
    assert max((r["group_size"], r["keep_id"]) for r in got) == (4000, 0)


def test_empty(docs_of):
    assert E.deduplicate(docs_of([])).count() == 0


def test_perfect_hash_is_minimal_and_perfect():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 17, 20_000):
        words = rng.integers(0, 2**63, (n, 4)).astype(np.uint64)
        hashed = E.PerfectHash.of(words)
        assert sorted(hashed.slots(words)) == list(range(n))
        other = rng.integers(0, 2**63, (1000, 4)).astype(np.uint64)
        assert all(-1 <= s < max(n, 0) or n == 0 for s in hashed.slots(other))
    near = np.zeros((64, 4), np.uint64)
    near[:, 3] = np.arange(64)  # distinct in one word only
    assert sorted(E.PerfectHash.of(near).slots(near)) == list(range(64))
    with pytest.raises(ValueError):
        E.PerfectHash.of(np.zeros((2, 4), np.uint64))


def test_members_are_told_by_their_bytes(spark, docs_of):
    """A digest that falls on a taken slot is not a repeat."""
    past = E.fingerprints(docs_of([(i, f"old {i}") for i in range(500)]))
    index = E.build_index(past, 1)
    groups = E.look_up(E.fingerprints(docs_of([(1000 + i, f"new {i}") for i in range(3000)] + [(-1, "old 7"), (9999, "old 8")])), index, 1)
    got = {(r["known"], r["size"]): r["n"] for r in groups.groupBy("known", "size").agg(F.count("*").alias("n")).collect()}
    assert got == {(True, 1): 498, (True, 2): 2, (False, 1): 3000}
    assert sorted(r["keep_id"] for r in groups.filter("size = 2").collect()) == [-1, 8]


def test_index_kept_for_a_later_batch(spark, docs_of, tmp_path):
    E.build_index(E.fingerprints(docs_of([(1, "a b"), (2, "c"), (3, None)])), 64).write.parquet(str(tmp_path / "index"))
    index = spark.read.parquet(str(tmp_path / "index"))
    batch = docs_of([(10, "a\nb"), (11, "d"), (9, "d "), (8, "d  "), (12, ""), (13, "e"), (13, "e"), (None, "f")], extra="_digest string, _row string, known string")
    kept = E.remove_repeats(batch, index, 64)
    assert kept.columns == batch.columns
    assert sorted(((r["doc_id"], r["text"], r["_digest"]) for r in kept.collect()), key=repr) == sorted([(11, "d", "x"), (8, "d  ", "x"), (13, "e", "x"), (13, "e", "x"), (None, "f", "x")], key=repr)
