import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratalith.operators import components as C
from stratalith.operators import evaluate as V
from stratalith.operators import explain as E
from stratalith.operators import features as A
from stratalith.operators import folds as S
from stratalith.operators import grid as G
from stratalith.operators import models as M
from stratalith.operators import quality as Q
from stratalith.operators import structure as R


def pixels(spark, stack):
    return spark.createDataFrame([("s", z, x, y, float(v)) for z, layer in enumerate(stack) for x, row in enumerate(layer) for y, v in enumerate(row)], "sample_name string, z long, x long, y long, v double")


def test_ten_statistics(spark):
    rows = spark.createDataFrame([("A", "f", float(v)) for v in range(10)] + [("A", "f", float("nan")), ("B", "f", 7.0)], "sample_name string, feature string, value double")
    got = {r["sample_name"]: r for r in A.ten_statistics(rows).collect()}
    assert [round(got["A"][s], 6) for s in ("median", "q10", "q25", "q75", "q90", "mean")] == [4.5, 0.9, 2.25, 6.75, 8.1, 4.5]
    assert got["B"]["std"] is None and got["B"]["var"] is None


def test_pivot_rejects_duplicates(spark):
    rows = spark.createDataFrame([("A", "x", 1.0), ("A", "y", 2.0), ("B", "x", 3.0), ("B", "y", 4.0)], "sample_name string, feature string, value double")
    assert {r["sample_name"]: (r["x"], r["y"]) for r in A.pivot(rows, ["x", "y"]).collect()} == {"A": (1.0, 2.0), "B": (3.0, 4.0)}
    with pytest.raises(Exception, match="more than one value"):
        A.pivot(rows.union(rows), ["x", "y"]).collect()


def test_reshape(spark):
    frame = spark.createDataFrame([("a", 1, 2)], ["sample_name", "Unnamed: 0-index", "v"])
    kept, gone = A.drop_artifacts(frame)
    assert kept.columns == ["sample_name", "v"] and gone == ["Unnamed: 0-index"]
    a, b = spark.createDataFrame([(1, 3), (2, 4)], ["col1", "col2"]), spark.createDataFrame([(5,)], ["col1"])
    assert sorted(map(tuple, A.union_ragged(a, b).collect()), key=str) == sorted([(1, 3), (2, 4), (5, None)], key=str)
    # five dishes in three media, each dish with a code of its own
    dishes = spark.createDataFrame([(0.5, "agar", "q"), (0.7, "broth", "r"), (0.1, "agar", "s"), (0.2, None, "t"), (0.9, "milk", "u")], "load double, medium string, code string")
    once = A.one_hot_where_useful(dishes, ["medium", "code"])
    assert once.columns == ["load", "medium_agar", "medium_broth", "medium_milk"]
    assert [tuple(r)[1:] for r in once.orderBy("load").collect()] == [(1, 0, 0), (0, 0, 0), (1, 0, 0), (0, 1, 0), (0, 0, 1)]


def test_labels(spark):
    rows = spark.createDataFrame([("t", None), ("u", " Missing "), ("v", "wild"), ("w", "missing"), ("x", "mutant"), ("y", None)], "sample_name string, label string")
    assert sorted(r[0] for r in Q.drop_unlabelled(rows).collect()) == ["v", "x"]
    with pytest.raises(ValueError, match="4 rows have no label"):
        Q.require_labels(rows)
    twins = spark.createDataFrame([(n, i) for i, n in enumerate(["k", "m", "k", None, "n", "k", None])], "name string, at long")
    assert Q.duplicates(twins, ["name"], "name").agg(F.sum("duplicate_rows")).first()[0] == 5


def test_spreading(spark):
    assert tuple(G.spreading(pixels(spark, [[[0] * 5] * 5, [[0] * 5, [0] * 5, [0, 0, 1, 0, 0], [0] * 5, [0] * 5], [[0] * 5] * 5])).first())[1:] == (0.0, 0.0, 0.0)
    line = G.spreading(pixels(spark, [[[0, 0, 0], [0, 9, 0], [0, 0, 0]]] * 5)).first()
    assert line["sxy"] == 0 and line["sz"] > 0 and line["sxyz"] > 0
    empty = G.spreading(pixels(spark, [[[0] * 3] * 3] * 3)).first()
    assert empty["sxy"] is None and empty["sz"] is None


def brute_components(on):
    seen, n = set(), 0
    for p in zip(*np.nonzero(on), strict=True):
        if p in seen:
            continue
        n += 1
        todo = [p]
        while todo:
            x, y = todo.pop()
            if (x, y) in seen or not (0 <= x < on.shape[0] and 0 <= y < on.shape[1]) or not on[x, y]:
                continue
            seen.add((x, y))
            todo += [(x + i, y + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
    return n


def test_components(spark):
    rng = np.random.default_rng(3)
    for density in (0.1, 0.3, 0.5, 0.8):
        for _ in range(20):
            on = rng.random((13, 16)) < density
            assert C.count_components(on) == brute_components(on)
    grids = [[[100, 0, 100], [0, 0, 0], [100, 0, 100]], [[100, 100, 0], [100, 100, 0], [0, 0, 0]], [[0, 0, 0]] * 3]
    got = {r["z"]: r["components"] for r in C.layer_components(pixels(spark, grids), [0.3]).collect()}
    assert got == {0: 4, 1: 1, 2: 1}


def test_thickness_by_brute_force(spark):
    stack = np.random.default_rng(5).random((4, 5, 6))
    got = {r["i"]: r for r in G.thickness(pixels(spark, stack), [0.2, 0.5, 0.99]).collect()}
    for i, t in enumerate([0.2, 0.5, 0.99]):
        heights = []
        for x in range(5):
            for y in range(6):
                if stack[0, x, y] > t:
                    z = 1
                    while z < 4 and stack[z, x, y] > t:
                        z += 1
                    heights.append(z)
        want = (np.mean(heights) if heights else None, np.mean(np.diff(heights)) if len(heights) > 1 else None)
        for name, w in zip(("thickness", "roughness"), want, strict=True):
            assert got[i][name] is None if w is None else math.isclose(got[i][name], w, abs_tol=1e-12)


def test_homogeneity_is_a_share(spark):
    flat = G.transition_homogeneity(pixels(spark, [[[7] * 4] * 4] * 4), 8).first()["homogeneity"]
    rough = G.transition_homogeneity(pixels(spark, np.random.default_rng(1).random((4, 4, 4)) * 9), 8).first()["homogeneity"]
    assert flat == 1.0 and 0 < rough < 1


def test_folds(spark):
    rows = spark.createDataFrame([(i, "ABC"[i % 3], f"g{i % 7}") for i in range(84)], "k int, label string, group string")
    folded = S.stratified_folds(rows, "label", "k", 4)
    counts = {(r["fold"], r["label"]): r["count"] for r in folded.groupBy("fold", "label").count().collect()}
    assert len(counts) == 12 and set(counts.values()) == {7}
    plan = S.grouped_folds(rows, "label", "group", 3)
    assert plan.count() == 7 and S.shared_groups(rows.join(plan, "group"), "group").isEmpty()
    cover = S.fold_coverage(rows.join(plan, "group"), "label").collect()
    assert all(r["test_labels"] == 3 and r["train_labels_of_test"] == 3 for r in cover)
    assert S.require_k(rows, "label") == 5
    with pytest.raises(ValueError, match="at least 2 samples"):
        S.require_k(rows.limit(1), "label")
    tight = spark.createDataFrame([("A", "A1"), ("A", "A2"), ("B", "B1"), ("B", "B2")], "label string, group string")
    report = S.feasibility(tight, "label", "group")
    assert not report["ok"] and "nested model tuning" in report["reason"]


def test_confusion_sums(spark):
    rows = spark.createDataFrame([("A", "A"), ("A", "C"), ("B", "A")], "truth string, predicted string")
    m = V.confusion(rows)
    assert m.count() == 9
    shares = {r["truth"]: r["s"] for r in V.normalised_confusion(m).groupBy("truth").agg(F.sum("share").alias("s")).collect()}
    assert shares == {"A": 1.0, "B": 1.0, "C": 0.0}


def test_configurations():
    assert V.configuration_grid([16, 32, "all"], 100, 20) == [(16, True, "svd_16"), (16, False, "svd_16"), (32, True, "svd_32"), (32, False, "svd_32"), ("all", True, "all_columns"), ("all", False, "threshold_only")]
    assert V.configuration_grid([16, "all"], 10, 0) == [("all", True, "all_columns"), ("all", False, "all_columns")]
    assert len(list(M.benchmark_plan(3, [(n, f, "") for n in range(7) for f in (True, False)], 3, ["rf"]))) == 126


def test_correlation_of_odd_columns(spark):
    rows = spark.createDataFrame([([float(i), 0.0, v],) for i, v in enumerate([1.0, 2.0, float("nan"), float("inf"), 5.0, 6.0], 1)], "vec array<double>")
    pairs = {(r["a"], r["b"]): (r["r"], r["n"]) for r in R.correlations(rows, ["v", "c", "n"]).collect()}
    assert pairs["v", "c"] == (None, 6) and pairs["v", "n"][1] == 4 and math.isclose(pairs["v", "n"][0], 1.0)
    assert R.correlation_clusters(["v", "c", "n"], R.correlations(rows, ["v", "c", "n"])) == [("v", "v"), ("c", "c"), ("n", "v")]


def test_neighbour_blocks_agree(spark):
    rng = np.random.default_rng(2)
    rows = spark.createDataFrame([(i, str(i % 3), rng.random(4).tolist()) for i in range(60)], "vec_id long, label string, vec array<double>")
    one, many = (sorted(map(tuple, R.neighbours(rows, rows, 3, block=b).collect())) for b in (1000, 7))
    assert one == many and len(one) == 180


def test_best_prefix(spark):
    assert R.best_prefix(spark.createDataFrame([(1, 0.5), (101, 0.8), (265, 0.75)], "top_n int, accuracy double")).first()["top_n"] == 101


def test_progress(spark):
    e = spark.createDataFrame([(2, 5, 5, 20)], "phase_index int, phase_total int, completed int, total int")
    assert E.progress_fraction(e).first()["percent"] == 25.0


@pytest.fixture(scope="module")
def separable(spark):
    rng = np.random.default_rng(0)
    rows = [(i, "ab"[i % 2], [float(i % 2) + 0.1 * rng.random(), *rng.random(3).tolist()], i // 2 % 3) for i in range(60)]
    return spark.createDataFrame(rows, "vec_id long, label string, vec array<double>, fold int").cache()


def test_learners(spark, separable, tmp_path):
    right = M.cross_validate(separable, "decisiontree", 3).agg(F.avg((F.col("truth") == F.col("predicted")).cast("double"))).first()[0]
    assert right > 0.95
    assert M.forest_importance(separable, list("wxyz"), trees=10).first()["feature"] == "w"
    v = M.svd(separable, 2)
    assert v.shape == (4, 2) and np.allclose(v.T @ v, np.eye(2)) and separable.transform(lambda d: M.project(d, v)).first()["vec"].__len__() == 2
    train, test, none = M.fold_features(separable, separable, "all", False, [1, 3])
    assert none is None and len(train.first()["vec"]) == 2
    result = M.benchmark(separable, V.configuration_grid(["all"], 4, 0), ["dummy"], 3)
    assert result.count() == 6 and {r["component_setting"] for r in result.collect()} == {"all_columns"}


def test_model_files_and_margins(spark, separable, tmp_path):
    data, labels = M.indexed(M.vectors(separable))
    model = M.RandomForestClassifier(labelCol="label_idx", numTrees=3, maxDepth=3, seed=1).fit(data)
    M.save_model(model, list("wxyz"), labels.labels, str(tmp_path / "m"), spark)
    long = separable.select(F.col("vec_id").cast("string").alias("sample_name"), F.posexplode("vec").alias("i", "value")).withColumn("feature", F.get(F.array(*[F.lit(x) for x in "wxyz"]), F.col("i"))).filter("feature <> 'z'")
    expected = spark.createDataFrame([(n, i) for i, n in enumerate("wxyz")], "feature string, position int")
    done = M.score(A.align(long, expected), str(tmp_path / "m"))
    assert done.count() == 60 and {r["predicted"] for r in done.collect()} <= {"a", "b"} and done.agg(F.min("confidence")).first()[0] >= 0.5
    wide = M.score_models(A.align(long, expected), {"good": str(tmp_path / "m"), "gone": str(tmp_path / "none")}).first()
    assert wide["good_prediction"] in ("a", "b") and (wide["gone_prediction"], wide["gone_confidence"]) == ("ERROR", 0.0)
    margins = M.path_margins(model, separable.limit(5)).collect()
    assert all(math.isclose(sum(r["by_feature"]), r["total"]) and r["total"] > 0 for r in margins)


def test_tree_attributions(spark, separable):
    from itertools import combinations
    from math import factorial

    data, _ = M.indexed(M.vectors(separable))
    model = M.RandomForestClassifier(labelCol="label_idx", numTrees=2, maxDepth=4, seed=3, featureSubsetStrategy="2").fit(data)
    rows = E.tree_attributions(model, separable.limit(6), 1).collect()
    probability = {r["vec_id"]: r["probability"][1] for r in model.transform(data).select("vec_id", "probability").collect()}
    assert all(math.isclose(r["base_value"] + sum(r["attributions"]), probability[r["vec_id"]], abs_tol=1e-9) for r in rows)
    # brute force over all coalitions of one tree
    tree = E.Tree(model.trees[1]._call_java("rootNode"))
    x = np.array(rows[0]["vec"])

    def value(known):
        return sum(p[1] * np.prod([(lo < x[f] <= hi) if f in known else s for f, (lo, hi, s) in path.items()]) for p, path in tree.leaves)

    for f in range(4):
        others = [g for g in range(4) if g != f]
        want = sum(factorial(n) * factorial(3 - n) / factorial(4) * (value({*c, f}) - value(set(c))) for n in range(4) for c in combinations(others, n))
        assert math.isclose(tree.attributions(x[None, :], 1)[1][0, f], want, abs_tol=1e-9)


def test_linkage():
    d = np.array([[0, 1, 4, 5], [1, 0, 3, 6], [4, 3, 0, 2], [5, 6, 2, 0]], float)
    assert [round(x[2], 6) for x in M.linkage(d, "single")] == [1, 2, 3]
    assert [round(x[2], 6) for x in M.linkage(d, "complete")] == [1, 2, 6]
    assert [round(x[2], 6) for x in M.linkage(d, "average")] == [1, 2, 4.5]


def test_stacks_are_thinned_by_their_name(spark):
    rows = spark.createDataFrame([(n, z) for n, k in (("a--z--5", 5), ("b--z--4", 4), ("c", 2)) for z in range(k)], "sample_name string, z long")
    got = sorted(map(tuple, G.thin_stacks(rows, 5).collect()))
    assert got == [("a--z--3", 0), ("a--z--3", 1), ("a--z--3", 2), *[("b--z--4", z) for z in range(4)], ("c", 0), ("c", 1)]


def test_columns_of_a_ranking(spark):
    scores = spark.createDataFrame([("x", 0.5), ("gone", 0.9), ("y", 0.7), ("z", 0.1)], "feature string, score double")
    frame = spark.createDataFrame([("s", 1.0, 2.0, 3.0, "a", 0)], ["sample_name", "x", "y", "z", "label", "Unnamed: 0"])
    assert A.feature_columns(frame) == ["x", "y", "z"] and A.feature_columns(frame, "z") == ["x", "y"]
    columns = spark.createDataFrame([(c,) for c in A.feature_columns(frame)], "feature string")
    assert [r["feature"] for r in R.ranked_columns(scores, columns, 2).collect()] == ["y", "x"]


def test_ordered_folds(spark):
    """Against the rule written out: labels in one line are dealt to folds in turn, and give each fold its number of rows of a label."""
    rows = [(i, "ABC"[(i * i) % 7 % 3]) for i in range(47)]
    got = {r["k"]: r["fold"] for r in S.ordered_folds(spark.createDataFrame(rows, "k int, label string"), "label", "k", 4).collect()}
    line = sorted(x for _, x in rows)
    for label in "ABC":
        sizes = [line[f::4].count(label) for f in range(4)]
        assert [got[i] for i, x in rows if x == label] == [f for f in range(4) for _ in range(sizes[f])]


def test_bounds():
    from stratalith.functions.numbers import bounded

    assert bounded("threshold", 1) == 1 and bounded("workers", 1) == 1 and bounded("top", 500) == 500
    for name, value in (("threshold", 0), ("threshold", 1.01), ("workers", 0), ("workers", 65), ("top", 501)):
        with pytest.raises(ValueError, match=name):
            bounded(name, value)
