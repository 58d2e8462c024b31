import hashlib
import random

import pytest

from stratalith.llm import sentencepieces as P
from stratalith.llm.queries import QUERIES


@pytest.fixture(scope="module")
def lib():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=P.MODEL)


def test_chunked_equals_library(lib):
    m, rng = P.Model.at(P.MODEL), random.Random(1)
    for i in range(120):
        letters = ["abcdefghij   \n\t▁éxyz0123中😀-=/▁", "theringsandofxmlrepresentation=-/ ", "thrinesadof"][i % 3]
        text = "".join(rng.choice(letters) for _ in range(rng.randint(1, 500)))
        s, size, side = P.MARK + text.replace(" ", P.MARK), 64, m.longest
        n = -(-len(s) // size)
        cut = [(min(k * size, side), min(len(s), (k + 1) * size) - k * size, s[max(0, k * size - side) : min(len(s), (k + 1) * size) + side]) for k in range(n)]
        states = P.edges_of([P.transfer(m, x, left, left + own, k == 0, k + 1 == n) for k, (left, own, x) in enumerate(cut)])
        ids = [i for k, ((left, own, x), (a, b)) in enumerate(zip(cut, states, strict=True)) for i in P.backtrace(m, x, left, left + own, a, b, k == 0)]
        assert ids == lib.encode(text) == m.encode(text).tolist()
        assert m.decode(m.encode(text)) == text.replace("▁", " ")


def test_products_are_associative():
    rng = random.Random(2)
    states = [(i, "x") for i in range(4)]
    a, b, c = ({s: set(rng.sample(states, rng.randint(1, 3))) for s in states if rng.random() < 0.8} for _ in range(3))
    assert P.combine(P.combine(a, b), c) == P.combine(a, P.combine(b, c))


TEXTS = ["plain text", None, "", " ", "  a  b ", "\n\nx\n", "a▁b", "<s> </s> <0x41>", "é́\x00" * 9, "word " * 9000, "q" * 9000, "dup", "dup"]


def test_documents(spark, docs_of, lib):
    docs = docs_of([(i, t) for i, t in enumerate(TEXTS)] + [(0, "word " * 5000)])
    for size in (65_536, 3000):
        got = sorted((r["doc_id"], tuple(r["ids"])) for r in P.encode_documents(docs, giant_chars=size, chunk_chars=1024).collect())
        assert got == sorted([(i, tuple(lib.encode(t or ""))) for i, t in enumerate(TEXTS)] + [(0, tuple(lib.encode("word " * 5000)))])
    back = {r["doc_id"]: r["text"] for r in P.decode_documents(P.encode_documents(docs.filter("doc_id > 0"))).collect()}
    assert all(back[i] == (t or "").replace("▁", " ") for i, t in enumerate(TEXTS) if i)
    assert P.encode_documents(docs_of([])).count() == 0


def test_query(spark, sf, lib):
    texts = {r[0]: r[1] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    for r in QUERIES["op2_sentencepiece"](spark, sf).collect():
        assert r["ids"] == lib.encode(texts[r["doc_id"]]) and r["n_tokens"] == len(r["ids"]) and r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_clashing_columns_and_default_giants(spark, docs_of):
    import sentencepiece

    text = "Some words, and then some more; " * 4000
    assert len(text) > 65_536
    docs = docs_of([(1, text), (1, text), (2, None)], extra="ids string, n_tokens string, decoded_chars string, decoded_sha256 string, row string, k string")
    rows = P.encode_documents(docs, decoded=True).collect()
    want = sentencepiece.SentencePieceProcessor(model_file=P.MODEL).encode(text)
    assert sorted((r["doc_id"], r["ids"] == want, r["n_tokens"], r["decoded_chars"]) for r in rows) == [(1, True, len(want), len(text))] * 2 + [(2, False, 0, 0)]


def test_remembered_units_are_bounded():
    model = P.Model(P.MODEL)
    for i in range(40):
        model.encode(" ".join(f"word{i}x{j}" for j in range(5000)) + " " + "long" * 500)
    assert model.held < 3 * P._KEPT_CHARS and max(map(len, model.units)) <= P._LONGEST_UNIT
