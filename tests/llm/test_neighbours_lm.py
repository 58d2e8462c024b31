import collections
import math
import zlib

import numpy as np

from stratalith.llm import language_model as LM
from stratalith.llm.neighbours import nearest
from stratalith.llm.queries import QUERIES


def exact(ids, m, q, k=20):
    at = int(np.flatnonzero(ids == q)[0])
    s = (m * m[at]).sum(axis=1)
    s[at] = -np.inf
    return ids[np.lexsort((ids, -s))[: min(k, len(ids) - 1)]].tolist(), s


def test_neighbour_query(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()
    ids, m = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], dtype=float)
    by = collections.defaultdict(list)
    for r in QUERIES["op7_neighbours"](spark, sf).collect():
        by[r["query_id"]].append(r)
    found = 0
    for q in ids[ids % 20 == 0].tolist():
        want, s = exact(ids, m, q)
        got = sorted(by[q], key=lambda r: r["rank"])
        assert [r["rank"] for r in got] == list(range(1, 21)) and len({r["vec_id"] for r in got}) == 20
        assert all(math.isclose(r["score"], s[int(np.flatnonzero(ids == r["vec_id"])[0])], rel_tol=1e-12) for r in got)
        found += len(set(want) & {r["vec_id"] for r in got})
    assert found / (20 * len(by)) >= 0.9 and len(by) == (ids % 20 == 0).sum()


def test_odd_vectors(spark):
    nan = float("nan")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [float("inf"), 1.0]), (7, [None, 1.0]), (8, [1.0]), (20, [3.0, 4.0])] + [(100 + i, [0.5, 0.5]) for i in range(40)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, rank int")
    got = collections.defaultdict(list)
    for r in sorted(nearest(df, lambda i: i % 20 == 0, block_rows=7).collect(), key=lambda r: (r[0], r[1])):
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    assert sorted(got) == [0, 20, 100, 120]
    assert got[20][:3] == [(2, 4.0), (100, 3.5), (101, 3.5)] or got[20][0] == (2, 4.0)
    assert got[0][:3] == [(20, 3.0), (1, 1.0), (100, 0.5)] and [v for v, _ in got[0][2:]] == list(range(100, 118))
    few = nearest(df.filter("vec_id < 3"), lambda i: i % 20 == 0).collect()
    assert sorted((r["rank"], r["vec_id"]) for r in few) == [(1, 1), (2, 2)]
    assert nearest(df.limit(0), lambda i: i % 20 == 0).count() == 0 and nearest(df.filter("vec_id = 4"), lambda i: i % 20 == 0).count() == 0


def tokens(t):
    return (t or "").encode().lower().split() + [b" "]


def check_base(rows, texts, held):
    c = collections.Counter(x for i, t in texts if not held(i) for x in tokens(t))
    n, v = sum(c.values()), len(c)
    want = collections.Counter()
    for i, t in texts:
        w = tokens(t)
        want[i, len(w), sum(c[x] > 0 for x in w), n, round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), 6)] += 1
    assert collections.Counter((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in rows) == want


def test_lm_query(spark, sf):
    texts = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    rows = QUERIES["op8_lm_score"](spark, sf).collect()
    check_base(rows, texts, held)
    out = [r for r in rows if r["held_out"]]
    assert all(held(r["doc_id"]) == r["held_out"] and r["score"] < 0 for r in rows)
    total = sum(r["n_tokens"] for r in out)
    assert sum(r["score"] for r in out) / total > sum(r["base_score"] for r in out) / total  # a lower perplexity


def test_lm_odd_texts(spark, docs_of):
    texts = [(1, "a b a c"), (2, None), (3, ""), (4, "A b\x0bzzz " + "q" * 300), (5, "a " * 30_000), (5, "a " * 30_000), (6, "é É"), (7, "new words only")]
    docs = docs_of(texts)
    for options in ({}, {"lexicon_size": 2}, {"lexicon_size": 0, "pairs_size": 0, "bucket_bytes": 50_000}):
        rows = LM.score_texts(docs, train_on=docs.filter("doc_id <> 7"), **options).collect()
        check_base(rows, texts, lambda i: i == 7)
    assert LM.score_texts(docs.limit(0)).count() == 0
    unseen = LM.score_texts(docs.filter("doc_id = 1"), train_on=docs.limit(0)).first()
    assert unseen["n_known"] == 0 and unseen["train_tokens"] == 0 and unseen["score"] < 0


def test_lm_keeps_every_context(spark, docs_of):
    rare = [f"u{i}x" for i in range(60)]
    follows = {u: f"w{i}z" for i, u in enumerate(rare)}
    learn = docs_of([(i, f"{u} {follows[u]}") for i, u in enumerate(rare)] * 3)
    asked = docs_of([(1, f"{rare[3]} {follows[rare[3]]}"), (2, f"{rare[3]} {follows[rare[4]]}"), (3, f"{rare[4]} {follows[rare[4]]}")])
    for options in ({}, {"lexicon_size": 2, "pairs_size": 2}, {"pairs_size": 0}):
        got = {r["doc_id"]: r["score"] for r in LM.score_texts(asked, train_on=learn, **options).collect()}
        assert got[1] > got[2] + 0.5 and got[3] > got[2] + 0.5, options


def test_lm_contexts_sum_to_one(spark, docs_of):
    texts = ["a b", "a b", "a cc", "b dd a", "", "dd", "a b a b a b"]
    learn = docs_of(list(enumerate(texts)))
    words = sorted({w for t in texts for w in t.split()})
    for options in ({}, {"lexicon_size": 1}):
        model = LM.Model(learn.selectExpr("cast(text AS binary) AS text"), options.get("lexicon_size", 100), 12 << 20, 1, 2)
        for u in ["", "a", "cc", "never"]:
            p = conditional(model, u.encode(), [w.encode() for w in words])
            assert len(p) == len(words) + 2 and math.isclose(sum(p.values()), 1, rel_tol=1e-5), (options, u)


def conditional(model, u, words):
    """p(w | u) of every word, the end and one unknown word, from the model's tables."""
    tokens, gains = {}, {}
    for row in model.tokens.collect():
        x = LM._token_row(row.asDict())
        tables, p = model.means(x)
        tokens.update({k: (t, q, c) for k, t, q, c in zip(x["keys"].tolist(), tables.tolist(), p.tolist(), x["c"].tolist(), strict=True)})
    for row in model.gains().collect():
        gains.update(zip(LM.unsqueeze_keys(row["keys"]).tolist(), (LM.unsqueeze(row["gain"], np.int64) / LM._STEP).tolist(), strict=True))
    read, edge = LM.Reader(model.lexicon.value), np.array([model.none], np.uint64)
    left = read([u]) if u else edge
    tables, _, c = tokens.get(int(left[0]), (0, 0, 0))
    share = (model.strength + model.d * tables) / (model.strength + c)
    out = {None: share * model.p_unknown}
    for w in [*words, b""]:
        right = read([w]) if w else edge
        key = LM.pair_keys(left, right, model.none)[0].tolist()[0]
        out[w] = share * tokens[int(right[0])][1] * 10 ** gains.get(key, 0.0)
    return out


def gibbs(texts, d2, d1, theta=1.0, sweeps=400, burn_in=100, seed=0):
    """p(w | u) of the pairs seen, by Gibbs sampling one customer after the other with explicit tables."""
    import random

    rng = random.Random(seed)
    counts = LM.brute_counts([t.encode() for t in texts])
    words = {w for _, w in counts}
    base = 1 / (len(words) + 1)
    under, above = {k: [] for k in counts}, {w: [] for w in words}  # sizes of tables
    total_u, total_1 = collections.Counter(), collections.Counter()

    def p1(w):
        n, t = sum(sum(x) for x in above.values()), sum(map(len, above.values()))
        return (sum(above[w]) - d1 * len(above[w]) + (theta + d1 * t) * base) / (theta + n)

    def choose(sizes, d, new):
        weights = [max(x - d, 0.0) for x in sizes] + [new]
        return rng.choices(range(len(weights)), weights)[0]

    def add_above(w):
        i = choose(above[w], d1, (theta + d1 * sum(map(len, above.values()))) * base)
        above[w][i:] = [above[w][i] + 1, *above[w][i + 1 :]] if i < len(above[w]) else [1]

    def add(u, w):
        own = under[u, w]
        i = choose(own, d2, (theta + d2 * total_u[u]) * p1(w))
        if i < len(own):
            own[i] += 1
        else:
            own.append(1)
            total_u[u] += 1
            add_above(w)

    def leave(sizes):
        i = rng.choices(range(len(sizes)), sizes)[0]
        sizes[i] -= 1
        if not sizes[i]:
            del sizes[i]
            return True
        return False

    for (u, w), c in counts.items():
        for _ in range(c):
            add(u, w)
    mean = collections.Counter()
    context = collections.Counter()
    for (u, _), c in counts.items():
        context[u] += c
    for sweep in range(burn_in + sweeps):
        for (u, w), c in counts.items():
            for _ in range(c):
                if leave(under[u, w]):
                    total_u[u] -= 1
                    leave(above[w])
                add(u, w)
        if sweep >= burn_in:
            for u, w in counts:
                mean[u, w] += (counts[u, w] - d2 * len(under[u, w]) + (theta + d2 * total_u[u]) * p1(w)) / (theta + context[u]) / sweeps
    assert total_1 == collections.Counter()
    return mean


def test_lm_against_brute_force_gibbs(spark, docs_of):
    rng = np.random.default_rng(2)
    vocabulary = [f"w{i}" for i in range(12)]
    texts = [" ".join(vocabulary[min(11, int(x))] for x in rng.exponential(3, 14)) for _ in range(12)]
    model = LM.Model(docs_of(list(enumerate(texts))).selectExpr("cast(text AS binary) AS text"), 6, 12 << 20, 3, 12)
    want = gibbs(texts, model.d, model.level.d)
    words = sorted({w for _, w in want if w})
    got, runs = {}, gibbs(texts, model.d, model.level.d, seed=1)
    for u in sorted({u for u, _ in want}):
        got.update({(u, w): p for w, p in conditional(model, u, words).items()})
    spread = max(abs(math.log(want[k] / runs[k])) for k in want)
    off = [math.log(got[k] / want[k]) for k in want]
    assert abs(sum(off) / len(off)) < 0.02 and max(map(abs, off)) < 0.12 + spread


def test_seating_does_not_depend_on_the_dealing():
    keys = np.arange(1000, dtype=np.uint64) * np.uint64(7919)
    counts, weight = np.arange(1000) % 300 + 1, np.full(1000, 0.4)
    whole = LM.seat(keys, counts, weight, 0.5, 3)
    parts = np.concatenate([LM.seat(keys[i : i + 77], counts[i : i + 77], weight[i : i + 77], 0.5, 3) for i in range(0, 1000, 77)])
    assert (whole == parts).all() and (whole >= 1).all() and (whole <= counts).all()


def test_arrays_are_packed_and_read_back():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 2**63, 5000, dtype=np.uint64) | np.uint64(1 << 63))
    assert (LM.unsqueeze_keys(LM.squeeze_keys(keys)) == keys).all() and len(LM.unsqueeze(b"", np.int64)) == 0
    found = np.concatenate([at for _, at in LM.dealt(keys, 7)])
    places = np.arange(100, dtype=np.uint64)
    assert [np.diff(at).max() for _, at in LM.dealt(places, 5, 99)] == [1] * 5 and list(LM.dealt(keys[:0], 7)) == []
    assert sorted(found.tolist()) == list(range(len(keys)))


def test_discount_is_not_clipped():
    assert LM.discount_of(30_000_000, 15_000_000) == 0.5 and LM.discount_of(300_000_000, 50_000_000) == 0.75


def test_repeated_vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=4)]) for i in range(60)]
    near = max(rows[1:], key=lambda r: np.dot(r[1], rows[0][1]))
    many = [r for r in rows for _ in range(2)] + [near] * 40
    got = collections.defaultdict(list)
    for r in nearest(spark.createDataFrame(many, "vec_id long, embedding array<double>"), lambda i: i == 0, block_rows=200).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"]))
    want, _ = exact(np.arange(60), np.array([v for _, v in rows]), 0)
    assert sorted(got[0]) == [(i + 1, v) for i, v in enumerate(want)]


def recall_of(spark, x, figures, **options):
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "vec_id long, embedding array<double>")
    by = collections.defaultdict(set)
    for r in nearest(df, lambda i: i % 20 == 0, figures=figures, **options).collect():
        by[r["query_id"]].add(r["vec_id"])
    ids = np.arange(len(x))
    asked = ids[ids % 20 == 0].tolist()
    assert sorted(by) == asked and all(len(by[q]) == 20 for q in asked)
    return sum(len(by[q] & set(exact(ids, x, q)[0])) for q in asked) / (20 * len(asked))


def clustered(n, seed):
    """Vectors of 60 clusters with norms between 0.3 and 3."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(60, 16))
    x = centres[rng.integers(0, 60, n)] + 0.4 * rng.normal(size=(n, 16))
    return x / np.linalg.norm(x, axis=1)[:, None] * rng.uniform(0.3, 3.0, n)[:, None]


def test_recall_with_many_lists(spark):
    pairs = []
    for n in (4000, 8000):
        figures = {}
        assert recall_of(spark, clustered(n, 4), figures, list_rows=50) >= 0.9
        assert figures["lists"] >= 64 and figures["pairs"] < 0.6 * n * (n // 20) * 4
        pairs.append(figures["pairs"])
    assert pairs[1] < 3.2 * pairs[0]  # twice the queries read lists of the same length


def test_two_levels(spark):
    figures = {}
    assert recall_of(spark, clustered(6000, 5), figures, list_rows=50, top_lists=12, sample_rows=2000) >= 0.9
    assert figures["lists"] > 60
