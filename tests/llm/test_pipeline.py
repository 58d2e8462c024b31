import hashlib
import zlib

import corpus_pipeline as CP
from stratalith.llm import langid as L
from stratalith.llm import secrets as S

from .test_decontaminate import brute as hits
from .test_jaccard_join import brute as components


def test_against_brute_force(spark, sf):
    import sentencepiece

    frame = spark.read.parquet(f"{sf}/documents.parquet")
    known = L.Classifier(L.learn_dictionaries(L.training_rows(frame)))
    docs = {r["doc_id"]: r["text"] for r in frame.collect()}
    docs = {i: t for i, t in docs.items() if (p := known.predict(t))[0] != L.UNKNOWN and p[2] >= 0.0005}
    docs = {i: docs[i] for i, _, first in components(docs.items(), 5, 80) if i == first}
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    docs = {i: docs[i] for i, *_, bad in hits(docs.items(), items) if not bad}
    docs = {i: S.redact_text(t) for i, t in docs.items()}
    lib = sentencepiece.SentencePieceProcessor(model_file="/opt/tokenizers/piece_bpe_32k.model")
    want = {i: (lib.encode(t), hashlib.sha256(t.encode()).hexdigest()) for i, t in docs.items()}
    got = {r["doc_id"]: (r["ids"], r["decoded_sha256"]) for r in CP.run(spark, sf).collect()}
    assert got == want and len(got) > 100


def test_stages_keep_columns(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in CP.STAGES[:-1]:
        assert stage(spark, docs.limit(0), sf).columns == docs.columns, name
    clean = CP.secret_scan(spark, docs.limit(20), sf).collect()
    assert all(r["n_chars"] == len(r["text"]) for r in clean) and zlib.crc32(b"") == 0


def test_odd_rows_go_through(spark, sf, tmp_path):
    frame = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").limit(60)
    long_text = frame.filter("length(text) > 200").first()["text"] * 60
    odd = spark.createDataFrame([(10_001, None, None, None, None), (10_002, "", "en", "s", 0), (10_003, long_text, "en", "s", len(long_text)), (10_004, frame.first()["text"], "en", "s", 5)], frame.schema)
    docs = frame.union(odd).withColumn("ids", frame.doc_id).withColumn("n_tokens", frame.doc_id).withColumn("lang_pred", frame.lang)
    docs.union(docs.filter("doc_id = 10003")).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{sf}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = CP.run(spark, str(tmp_path)).collect()
    ids = [r["doc_id"] for r in kept]
    assert 10_001 not in ids and 10_002 not in ids and 10_004 not in ids and ids.count(10_003) in (0, 2)
    docs.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    spark.read.parquet(f"{sf}/benchmark.parquet").write.parquet(f"{tmp_path}/none/benchmark.parquet")
    assert CP.run(spark, f"{tmp_path}/none").count() == 0


def test_a_failed_run_goes_on(spark, sf, monkeypatch, tmp_path):
    import pytest

    calls = []
    stages = list(CP.STAGES)

    def noted(name, stage, fails):
        def run(spark, docs, sf_dir):
            calls.append(name)
            if fails:
                raise RuntimeError("lost")
            return stage(spark, docs, sf_dir)

        return name, run

    monkeypatch.setattr(CP, "STAGES", [noted(n, s, n == "secret_scan") for n, s in stages])
    with pytest.raises(RuntimeError):
        CP.run(spark, sf, run_id=f"test-{tmp_path.name}-{id(calls)}")
    monkeypatch.setattr(CP, "STAGES", [noted(n, s, False) for n, s in stages])
    calls.clear()
    assert CP.run(spark, sf, run_id=f"test-{tmp_path.name}-{id(calls)}").count() > 100 and calls == ["secret_scan", "sentencepiece"]
