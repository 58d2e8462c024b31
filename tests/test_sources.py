import struct

import numpy as np
from pyspark.sql import functions as F

from stratalith.plans import workflows as W
from stratalith.sources import occupancy as O
from stratalith.sources import stacks as T
from stratalith.sources import tables as B
from stratalith.streaming import ingest as I


def tiff(layers, order="<"):
    """A small uncompressed 16-bit TIFF, one strip a page."""
    out = bytearray((b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 0))
    last = 4
    for layer in layers:
        data = np.asarray(layer, order + "u2").tobytes()
        offset = len(out)
        out += data
        struct.pack_into(order + "I", out, last, len(out))
        entries = [(256, 4, layer.shape[1]), (257, 4, layer.shape[0]), (258, 4, 16), (259, 4, 1), (273, 4, offset), (278, 4, layer.shape[0]), (279, 4, len(data))]
        out += struct.pack(order + "H", len(entries))
        for tag, kind, value in entries:
            out += struct.pack(order + "HHII", tag, kind, 1, value)
        last = len(out)
        out += struct.pack(order + "I", 0)
    return bytes(out)


def test_stacks(spark, tmp_path):
    layers = np.random.default_rng(0).integers(0, 60000, (3, 8, 9))
    for order in "<>":
        assert all((a == b).all() for a, b in zip(T.decode(tiff(layers, order)), layers, strict=True))
    (tmp_path / "a_b.tif").write_bytes(tiff(layers))
    rows = T.read_stacks(spark, str(tmp_path))
    got = {(r["sample_name"], r["z"]): r["pixels"] for r in rows.collect()}
    assert got["a--b", 2] == layers[2].ravel().tolist() and len(got) == 3
    cell = T.pixel_rows(rows).filter("z = 1 AND x = 2 AND y = 3").first()
    assert cell["v"] == layers[1, 2, 3]


def test_workflows(spark, tmp_path):
    rng = np.random.default_rng(1)
    (tmp_path / "im").mkdir()
    for i in range(2):
        (tmp_path / "im" / f"s{i}.tif").write_bytes(tiff(rng.integers(1, 200, (3, 8, 8))))
    found = W.generate_features(spark, str(tmp_path / "im")).collect()
    assert {r["sample_name"] for r in found} == {"s0", "s1"} and len({r["feature"] for r in found}) == 2660
    rows = spark.createDataFrame([(str(i), "ab"[i % 2], [float(i % 2), float(rng.random())]) for i in range(30)], "sample_name string, label string, vec array<double>")
    results = W.train(rows, ["x", "y"], str(tmp_path / "model"), 2, ci=True)
    assert results.count() == 2 * 2 * 2
    long = spark.createDataFrame([("n", "x", 1.0), ("n", "y", float("nan")), ("n", "extra", 3.0)], "sample_name string, feature string, value double")
    assert W.infer(long, str(tmp_path / "model")).first()["predicted"] == "b"


def test_tables(spark, tmp_path):
    (tmp_path / "aCustomAlgos.txt").write_text("\tv\tw\n0\t1.5\tinf\n1\t2.5\t-inf\n")
    (tmp_path / "aDiffGlobal.txt").write_text("\tglobalMean\n0\t7\n")
    got = B.read_namespace(spark, str(tmp_path), "CustomAlgos", "_index int, v double, w double").collect()
    assert [(r["v"], r["w"], r["sampleName"]) for r in got] == [(1.5, float("inf"), "a"), (2.5, float("-inf"), "a")]
    assert len(B.read_namespace(spark, str(tmp_path), "CustomAlgos", "_index int, v double, w double", 1).collect()) == 1
    frame = spark.createDataFrame([("a", float("inf")), ("b", float("nan"))], "k string, v double")
    B.write_tsv(frame, str(tmp_path / "out"))
    again = {r["k"]: r["v"] for r in B.read_tsv(spark, str(tmp_path / "out"), "k string, v double").collect()}
    assert again["a"] == float("inf") and again["b"] != again["b"]
    assert B.header(spark, str(tmp_path / "out")) == ["k", "v"]


def test_occupancy(spark, tmp_path):
    text = "junk\nImage name:\ta b 01022023_s_Lm_st_L1_p_C06_pos004_tm\nDistance (µm)\t\t0,0\t0,5\nPercent:\t\t1,25\t2,5\n"
    (tmp_path / "o.txt").write_bytes(text.encode("cp1251", "replace"))
    r = O.read_occupancy(spark, str(tmp_path / "o.txt")).first()
    assert (r["name"], r["position"], r["distance"], r["percent"]) == ("01022023_C06", "pos004", [0.0, 0.5], [1.25, 2.5])


def test_stream(spark, tmp_path):
    schema = "sample_name string, feature string, value double"
    src, out, mark = (str(tmp_path / x) for x in ("src", "out", "mark"))
    rows = spark.createDataFrame([("a", "f", float(i)) for i in range(10)], schema)
    rows.write.parquet(src)
    for _ in range(2):  # the second run finds nothing new
        I.ingest_available(I.measurement_stream(spark, src, schema), out, mark).awaitTermination()
    assert spark.read.parquet(out).count() == 10
    q = I.statistics_stream(I.measurement_stream(spark, src, schema)).writeStream.format("memory").queryName("stats").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("SELECT round(q10, 6), median FROM stats").first() == (0.9, 4.5)
    assert rows.agg(F.count("*")).first()[0] == 10


def test_training_saves_the_tuned_forest(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = spark.createDataFrame([(str(i), "ab"[i % 2], [float(i % 2), float(rng.random())]) for i in range(30)], "sample_name string, label string, vec array<double>")
    W.train(rows, ["x", "y"], str(tmp_path / "model"), 2, ci=True)
    best = W.M.tuned_forest(W.S.stratified_folds(rows, "label", "sample_name", 2), 2, 2).first()["parameters"]
    forest = W.M.load_model(str(tmp_path / "model"), spark)[0].stages[0]
    assert f"('numTrees', {forest.getNumTrees})" in best and f"('maxDepth', {forest.getMaxDepth()})" in best


def test_learner_queries_run_the_whole_job(spark, sf, monkeypatch):
    from stratalith.plans import learners as N

    asked = {}
    for name in ("ablation", "benchmark", "tuned_forest"):
        monkeypatch.setattr(N.M, name, lambda rows, *a, _n=name: asked.update({_n: (rows, a)}))
    N.ablation(spark, sf), N.benchmark_results(spark, sf), N.tuned_rf(spark, sf)
    rows = asked["ablation"][0]
    assert rows.selectExpr("min(size(vec))", "max(size(vec))").first() == (64, 64) and asked["ablation"][1][0] == [f"d{i}" for i in range(64)]
    folds = rows.select("fold").distinct().count()
    assert asked["ablation"][1][1] == asked["benchmark"][1][2] == asked["tuned_forest"][1][0] == folds and asked["tuned_forest"][1][1] == 10
    assert N.M.learner("xgb").getClassifier().getMaxIter() == 100
