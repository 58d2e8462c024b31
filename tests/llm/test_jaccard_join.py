import random

from stratalith.llm import jaccard_join as J
from stratalith.llm.queries import QUERIES


def shingles(t, n=3):
    w = (t or "").encode().lower().split()
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def brute(docs, n=3, percent=90):
    sets = {i: shingles(t, n) for i, t in docs}
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return sorted((i, len(sets[i]), find(i)) for i in ids)


def near_copies(seed, groups=6, size=14, words=60):
    rng, docs = random.Random(seed), []
    for g in range(groups):
        base = [f"w{rng.randint(0, 300)}" for _ in range(words)]
        for _ in range(size):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                copy[rng.randrange(len(copy))] = f"z{rng.randint(0, 99)}"
            docs.append(" ".join(copy + ["shared passage of many words in every document here"] * (g % 2)))
    rng.shuffle(docs)
    return docs


def test_brute_force(spark, docs_of):
    docs = list(enumerate([*near_copies(1), None, "", "one", "ONE", "one two", "a b c", "A  b\tc", "x " * 20_000, "\x0b"]))
    want = brute(docs)
    for options in ({}, {"block": 5}, {"block": 3, "spare": 0}):
        got = sorted(map(tuple, J.duplicate_components(docs_of(docs), **options).collect()))
        assert got == want, options


def test_other_shingles_and_thresholds(spark, docs_of):
    docs = list(enumerate(near_copies(3, groups=4, size=10)))
    got = sorted(map(tuple, J.duplicate_components(docs_of(docs), n=5, threshold="4/5").collect()))
    assert got == brute(docs, 5, 80)


def test_odd_tables(spark, docs_of):
    assert J.duplicate_components(docs_of([])).count() == 0
    assert [tuple(r) for r in J.duplicate_components(docs_of([(5, "a b c d"), (5, "a b c d"), (5, None)])).collect()] == [(5, 2, 5)]
    kept = J.keep_first(docs_of([(3, "a b c d"), (2, "a b c d"), (9, "other words are here"), (4, None)]))
    assert sorted(r["doc_id"] for r in kept.collect()) == [2, 4, 9] and kept.columns == ["doc_id", "text", "n_words", "score", "runs"]


def test_query(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, QUERIES["op9_ngram_jaccard"](spark, sf).collect())) == brute(docs)


def test_blocks_are_bounded_by_shingles(spark, docs_of):
    docs = list(enumerate(near_copies(2, groups=3, size=12)))
    assert sorted(map(tuple, J.duplicate_components(docs_of(docs, extra="n_shingles string, component_id string, size string, parts string"), block_shingles=200).collect())) == brute(docs)


def test_components_with_heavy_nodes(spark):
    from stratalith.llm.common import connected_components

    rng = random.Random(7)
    edges = [(0, i) for i in range(1, 60)] + [(100 + i, 101 + i) for i in range(30)] + [(rng.randint(200, 260), rng.randint(200, 260)) for _ in range(40)] + [(59, 140)]
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        up[max(x, y)] = min(x, y)
    nodes = {x for e in edges if e[0] != e[1] for x in e}
    got = connected_components(spark.createDataFrame(edges, "src long, dst long"), heavy_degree=5, most_heavy=1000).collect()
    assert sorted(map(tuple, got)) == sorted((x, find(x)) for x in nodes)


def test_a_task_sends_a_part_once(spark, docs_of):
    base = [f"w{i}" for i in range(120)]
    docs = []
    for i in range(300):
        copy = list(base)
        copy[i % 120] = f"z{i}"
        docs.append((i, " ".join(copy)))
    prints = J.fingerprints(docs_of(docs).repartition(3), "doc_id", "text", 3, J.Fraction("9/10"), 1)
    most = prints.selectExpr("explode(parts) AS part").groupBy("part").count().selectExpr("max(count)").first()[0]
    assert most <= 3


def test_repeated_shingles(spark, docs_of):
    docs = [*enumerate(near_copies(5, groups=3, size=6)), (3, "a text of its own"), (3, "one more text of its own"), (900, None), (901, ""), (902, "x y"), (903, "x y")]
    sets = [(i, shingles(t, 5)) for i, t in docs]
    for flush, bucket_bytes in ((1 << 20, 32 << 20), (40, 300)):
        got = {r["doc"]: tuple(r)[1:] for r in J.repeated_shingles(docs_of(docs).repartition(3), "doc_id", "text", 5, bucket_bytes, flush).collect()}
        for i in {i for i, _ in docs}:
            mine = [(k, s) for k, (d, s) in enumerate(sets) if d == i]
            repeated = sum(any(x in other for at, (_, other) in enumerate(sets) if at != k) for k, s in mine for x in s)
            sizes = [len(s) for _, s in mine]
            assert got[i] == (max(sizes), min((x for x in sizes if x), default=None), repeated)


def test_one_of_an_ids_rows_links(spark, docs_of):
    copy = " ".join(f"w{i}" for i in range(40))
    docs = [(1, copy), (2, copy + " more"), (2, " ".join(f"z{i}" for i in range(90)))]
    assert sorted(map(tuple, J.duplicate_components(docs_of(docs), n=5, threshold="4/5", block=1).collect())) == [(1, 36, 1), (2, 86, 1)]


def test_open_groups_of_many_sizes(spark, docs_of):
    rng, docs = random.Random(11), []
    for size in (20, 25, 31, 39, 48, 60, 75):
        base = [f"p{i}" for i in range(15)] + [f"s{size}_{i}" for i in range(size)]
        for _ in range(4):
            copy = list(base)
            copy[rng.randrange(15, len(copy))] = f"z{rng.randint(0, 9)}"
            docs.append(" ".join(copy))
    docs = list(enumerate(docs))
    assert sorted(map(tuple, J.duplicate_components(docs_of(docs), n=2, threshold="1/2", block=2).collect())) == brute(docs, 2, 50)


def test_forest():
    rng = random.Random(5)
    for size in (0, 1, 300):
        edges = [(rng.randint(0, 200) * 3, rng.randint(0, 200) * 3) for _ in range(size)] + [(1000 + i, 1001 + i) for i in range(size)]
        up = {}

        def find(x):
            while up.setdefault(x, x) != x:
                x = up[x]
            return x

        for a, b in edges:
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
        got = J.forest(J.np.array(edges, J.np.int64).reshape(-1, 2)).tolist()
        assert sorted(map(tuple, got)) == sorted((x, find(x)) for x in list(up) if find(x) != x)


def test_rare_shingles(spark, docs_of):
    docs = list(enumerate([*near_copies(9, groups=4, size=8), "a text of its own", None, ""]))
    j = J.Fraction("4/5")
    for chunk, bucket, tasks in ((1 << 18, 4 << 20, 1), (90, 60, 3)):
        texts = docs_of(docs).selectExpr("doc_id AS doc", "0L AS g", "text").repartition(tasks)
        rows = J.rare_shingles(texts, 2000, 3, j, chunk, bucket).collect()
        held = [p for r in rows for p in r["parts"]]
        sets = {i: shingles(t) for i, t in docs}
        assert sorted(r["doc"] for r in rows) == [i for i, s in sets.items() if s]
        # no chunk sends a token twice, and every linked pair is joined
        found = {(a, b) for r in rows for a, b in [(r["doc"], x) for x in r["near"]]}
        by = {}
        for r in rows:
            for p in r["parts"]:
                by.setdefault(p, []).append(r["doc"])
        found |= {(x, v[0]) for v in by.values() for x in v}
        forest = dict(J.forest(J.np.array(sorted(found) or [(0, 0)], J.np.int64)).tolist())
        for a, x in sets.items():
            for b, y in sets.items():
                if a < b and x and y and 5 * len(x & y) >= 4 * len(x | y):
                    assert forest.get(a, a) == forest.get(b, b)
        if tasks == 1:
            assert len(held) == len(set(held))
