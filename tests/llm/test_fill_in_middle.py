import hashlib
import random
import re

import pytest

from stratalith.llm.fill_in_middle import digest, restored, transform


def brute(doc_id, text, spm=50, fim=100, seed=7):
    """Parts by slicing a list of lines, as the contract words it."""
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= fim:
        return n, "plain", None, None, None, text
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    return (n, "spm", p, m, s, f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < spm else (n, "psm", p, m, s, f"<P>{p}<S>{s}<M>{m}")


def texts():
    rng = random.Random(3)
    pieces = ["\n", "\n", "a", "é", "😀", "\x01", "\x02", "\x01d", "\x01e", "$1", "\\", "\r", " ", "<", "<P", ">", " ", "S>"]
    made = [None, "", "\n", "\n\n\n", "one", "one\n", "\x02\x01\x02", "has <P> in it", "<M>", "line\n" * 30_000, "x" * 300_000 + "\n" + "y" * 10]
    return made + ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 60))) for _ in range(200)]


def test_equals_slicing(spark, docs_of):
    rows = list(enumerate(texts())) + [(3, "\n\n\n"), (3, "\n\n\n"), (None, "a\nb\nc"), (-5, "a\nb")]
    found = transform(docs_of(rows, extra="n string, form string, output string"))
    assert found.columns == ["doc_id", "n", "form", "prefix", "middle", "suffix", "output"]
    got = sorted(map(repr, (tuple(r) for r in found.collect())))
    assert got == sorted(repr((i, *brute(i, t))) for i, t in rows)
    back = found.select("doc_id", restored(found["output"], found["form"])).collect()
    assert sorted(map(repr, map(tuple, back))) == sorted(repr((i, t or "")) for i, t in rows)


def test_digest(spark, docs_of):
    rows = list(enumerate(texts()))
    want = []
    for i, t in rows:
        n, form, p, m, _, out = brute(i, t)
        want.append((i, n, form, None if p is None else len(p), None if m is None else len(m), *(hashlib.sha256(x.encode()).hexdigest() for x in (out, t or ""))))
    assert sorted(tuple(r) for r in digest(transform(docs_of(rows))).collect()) == sorted(want)


def test_rates_and_kept_columns(spark, docs_of):
    rows = [(i, "a\nb\nc\nd\n") for i in range(400)]
    docs = docs_of(rows, extra="score string")
    for fim, spm in ((0, 50), (30, 0), (100, 100), (60, 40)):
        got = transform(docs, fim_percent=fim, spm_percent=spm, keep=["score"])
        assert got.columns[:2] == ["doc_id", "score"]
        assert sorted((r["doc_id"], r["form"], r["output"]) for r in got.collect()) == sorted((i, *[brute(i, t, spm, fim)[k] for k in (1, 5)]) for i, t in rows)


def test_own_markers_and_units(spark, docs_of):
    marks = ("[[pre]]", "[[suf]]", "[[mid]]")
    got = transform(docs_of([(i, "ab cd  ef gh") for i in range(40)]), unit=r"[^ ]* |[^ ]+", markers=marks)
    back = got.select("n", "form", restored(got["output"], got["form"], marks).alias("t")).collect()
    assert {r["form"] for r in back} == {"psm", "spm"} and all(r["n"] == 5 and r["t"] == "ab cd  ef gh" for r in back)
    for bad in (("a", "a", "b"), ("", "x", "y"), ("<P", "P>", "z"), ("ab", "abc", "q")):
        with pytest.raises(ValueError):
            transform(docs_of([(1, "t")]), markers=bad)


def test_empty_table_and_plan(spark, docs_of):
    found = transform(docs_of([]))
    assert found.count() == 0
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan
