import hashlib
import re

from stratalith.llm import decontaminate as D
from stratalith.llm.queries import QUERIES

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(t):
    return WORD.findall((t or "").translate(LOWER))


def brute(docs, items, n=10):
    windows = {}
    for i, t in items:
        w = words(t)
        for a in range(len(w) - min(n, len(w)) + 1 if w else 0):
            windows.setdefault(tuple(w[a : a + min(n, len(w))]), set()).add(str(i))
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for size in {len(x) for x in windows}:
            for a in range(len(w) - size + 1):
                owners = windows.get(tuple(w[a : a + size]))
                if owners:
                    hit |= set(range(a, a + size))
                    found |= owners
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out)


ITEMS = [(1, "one two three four five six seven eight nine ten eleven twelve"), (2, "Short item!"), (3, None), (4, ""), (5, "... --"), (10, "one two three four five six seven eight nine ten"), (2, "short item again")]
DOCS = [(1, "x ONE two, three four five six seven eight nine ten y"), (2, "two three four five six seven eight nine ten eleven twelve"), (3, None), (4, ""), (5, "a short item and a short item again"), (6, "one two three four five six seven eight nine"), (7, "é " * 5000 + "Short Item"), (7, "short item"), (8, "shortitem short\x00item")]


def test_brute_force(spark, docs_of):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    docs = docs_of(DOCS)
    want = brute(DOCS, ITEMS)
    assert sorted(map(tuple, D.digest(D.scan_benchmark(docs, items)).collect())) == want
    assert sorted(map(tuple, D.digest(D.scan_benchmark(docs, items, block_bytes=100)).collect())) == want  # several blocks


def test_modes(spark, docs_of):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    docs = docs_of(DOCS)
    for block in (1 << 20, 100):
        kept = D.decontaminate(docs, items, block_bytes=block)
        assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [3, 4, 6] + [i for i, *r in brute(DOCS, ITEMS) if i in (2, 8) and not r[-1]]
    cut = {r["doc_id"]: r["text"] for r in D.decontaminate(docs, items, mode="spans").collect()}
    assert cut[1] == "x  y" and cut[5] == "a  and a " and cut[3] is None


def test_empty(spark, docs_of):
    none = spark.createDataFrame([], "item_id long, text string")
    assert D.scan_benchmark(docs_of([]), none).count() == 0
    assert [tuple(r)[1:4] for r in D.digest(D.scan_benchmark(docs_of([(1, "a b")]), none)).collect()] == [(2, 0, 0)]


def test_query(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert sorted(map(tuple, QUERIES["op6_decontamination"](spark, sf).collect())) == brute(docs, items)


def test_large_benchmark_in_little_memory():
    import pickle
    import random
    import tracemalloc

    rng = random.Random(1)
    items = [(i, " ".join(f"w{rng.randint(0, 60_000)}" for _ in range(700)).encode()) for i in range(900)]
    size = sum(len(t) for _, t in items)
    tracemalloc.start()
    made = D.WindowSet(items, 10)
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert size > 4 << 20 or held < 14 * size
    # a block of 4 MB stays below 60 MB in a worker; a benchmark of 20 MB is five of them, one after the other
    assert held < 60 << 20 and len(pickle.dumps(made)) < 8 * size
    text = items[5][1].split()
    n, runs, found = made.scan(b" ".join([b"x"] * 3 + text[20:40] + [b"y"]))
    assert (n, runs, found) == (24, [(3, 23)], {"5"})


def test_spans_are_the_same_for_any_number_of_blocks(spark, docs_of):
    """Items that overlap in a document: cut from the text as it was, not from what another block left."""
    words = [f"w{i}" for i in range(40)]
    items = spark.createDataFrame([(i, " ".join(words[i * 4 : i * 4 + 14])) for i in range(6)] + [(9, "end of it")], "item_id long, text string")
    rows = [(1, "start " + " ".join(words) + " end of it"), (2, None), (3, " ".join(words[:9])), (4, " ".join(words[2:12]) + " x " + " ".join(words[20:34])), (5, "")]
    docs = docs_of(rows, extra="_runs0 string, runs string")
    got = [sorted((r["doc_id"], r["text"], r["_runs0"]) for r in D.decontaminate(docs, items, mode="spans", block_bytes=b).collect()) for b in (1 << 20, 400, 100)]
    assert got[0] == got[1] == got[2]
    assert [x[1] for x in got[0]] == ["start  w34 w35 w36 w37 w38 w39 ", None, " ".join(words[:9]), " x ", ""]
    assert D.decontaminate(docs, items, mode="spans", block_bytes=100).columns == docs.columns
