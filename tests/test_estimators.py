"""Estimators against brute force: attributions, information, bootstrap, correlations in blocks, split quantiles, plans of groups."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.ml.feature import SQLTransformer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from stratalith.operators import bootstrap as B
from stratalith.operators import explain as E
from stratalith.operators import features as A
from stratalith.operators import folds as S
from stratalith.operators import gramian as G
from stratalith.operators import information as I
from stratalith.operators import kernel_explain as K
from stratalith.operators import models as M
from stratalith.operators import quantiles as Q

RNG = np.random.default_rng(8)


@pytest.fixture(scope="module")
def rows(spark):
    made = [(f"s{i:02}", "ab"[i % 2], [float(v) for v in (*(RNG.random(4) + i % 2 * np.array([1, 0, 0.5, 0])), i % 3)]) for i in range(30)]
    return spark.createDataFrame(made, "sample_name string, label string, vec array<double>").cache()


def test_kernel_equals_linear_attributions(spark, rows):
    w = [2.0, -1.0, 0.0, 3.5, 0.25]
    model = SQLTransformer(statement=f"SELECT *, aggregate(zip_with(vec, array({', '.join(f'{x}D' for x in w)}), (a, b) -> a * b), 1D, (s, x) -> s + x) AS prediction FROM __THIS__")
    for most in (1000, 24):  # all coalitions, and a sample of them
        got = {r["sample_name"]: r for r in K.kernel_attributions(model, rows, rows, F.col("prediction"), most=most, block=7).collect()}
        long = rows.select("sample_name", F.posexplode("vec").alias("feature", "value"))
        exact = E.linear_attributions(long, spark.createDataFrame(list(enumerate(w)), "feature int, weight double")).collect()
        assert len(got) == 30 and all(math.isclose(got[r["sample_name"]]["attributions"][r["feature"]], r["attribution"], abs_tol=1e-9) for r in exact)


def test_kernel_on_a_forest_is_exact_shapley(spark, rows):
    """Against the definition: all orders of five features, unknown ones taken from each background row."""
    data, _ = M.indexed(M.vectors(rows))
    forest = M.RandomForestClassifier(labelCol="label_idx", numTrees=4, maxDepth=3, seed=2).fit(data)
    got = {r["sample_name"]: r for r in K.kernel_attributions(forest, rows, rows, F.get(vector_to_array("probability"), F.lit(1)), most_rows=2, most_background=6).collect()}
    table = {r["sample_name"]: r["vec"] for r in rows.collect()}
    ground = [table[k] for k in sorted(table)[:6]]
    assert sorted(got) == ["s00", "s01"]
    x = table["s01"]
    sets = [frozenset(c) for n in range(6) for c in itertools.combinations(range(5), n)]
    mixed = spark.createDataFrame([(i, [x[j] if j in s else g[j] for j in range(5)]) for i, s in enumerate(sets) for g in ground], "i int, vec array<double>")
    value = {sets[r["i"]]: r["y"] for r in forest.transform(M.vectors(mixed)).groupBy("i").agg(F.avg(F.get(vector_to_array("probability"), F.lit(1))).alias("y")).collect()}
    for j in range(5):
        others = [s for s in sets if j not in s]
        want = sum(math.factorial(len(s)) * math.factorial(4 - len(s)) / 120 * (value[s | {j}] - value[s]) for s in others)
        assert math.isclose(got["s01"]["attributions"][j], want, abs_tol=1e-9)
    assert math.isclose(got["s01"]["base_value"] + sum(got["s01"]["attributions"]), got["s01"]["prediction"]) and math.isclose(got["s01"]["prediction"], value[frozenset(range(5))])


def test_coalitions_are_a_fixed_sample():
    a, w = K.coalitions(40, 500)
    b, _ = K.coalitions(40, 500)
    assert (a == b).all() and len(np.unique(a, axis=0)) == len(a) and math.isclose(w.sum(), 1) and not a[0].any() and a[1].all()
    assert {tuple(x) for x in a[2:]} == {tuple(~x) for x in a[2:]}
    # additive values are found exactly from far fewer coalitions than there are
    phi = RNG.random(40)
    assert np.allclose(K.solve(a, w, a @ phi + 3), phi)
    assert K.coalitions(1, 10)[0].tolist() == [[False], [True]] and K.solve(*K.coalitions(1, 10), np.array([1.0, 4.0])).tolist() == [3.0]


def test_attributions_are_written(spark, tmp_path):
    made = spark.createDataFrame([("x", [1.0, -3.0]), ("y", [-2.0, 0.0])], "sample_name string, attributions array<double>")
    K.write_attributions(made, ["a.b", "c(d<1"], str(tmp_path))
    read = lambda part: [tuple(r) for r in spark.read.option("header", True).csv(str(tmp_path / part)).collect()]
    assert sorted(read("values")) == [("x", "1.0", "-3.0"), ("y", "-2.0", "0.0")] and read("importance") == [("a.b", "1.5"), ("c(d<1", "1.5")]


def psi(n):
    return -0.5772156649015329 + math.fsum(1 / k for k in range(1, n))


def test_digamma(spark):
    got = spark.range(1, 3000).select("id", I.digamma(F.col("id"))).collect()
    assert all(math.isclose(r[1], psi(r[0]), abs_tol=1e-11) for r in got)


def test_neighbour_information(spark):
    cells = []
    for f, values in {"told": [i % 2 * 5 + v for i, v in enumerate(RNG.random(80).tolist())], "noise": RNG.random(80).tolist(), "ties": RNG.integers(0, 4, 80).astype(float).tolist(), "flat": [1.0] * 80, "holes": [math.nan, math.inf, None] + RNG.random(77).tolist()}.items():
        cells += [(f, "ab"[i % 2] if i < 78 else ["alone", None][i - 78], v) for i, v in enumerate(values)]
    got = {r["feature"]: r["mi"] for r in I.neighbour_information(spark.createDataFrame(cells, "feature string, label string, value double")).collect()}
    for f in got:
        points = [(c, v) for name, c, v in cells if name == f and c is not None and v is not None and math.isfinite(v)]
        points = [(c, v) for c, v in points if sum(c == d for d, _ in points) > 1]
        total = 0.0
        for i, (c, v) in enumerate(points):
            near = sorted((abs(v - u), u) for j, (d, u) in enumerate(points) if j != i and d == c)
            k = min(3, len(near))
            r, at = near[k - 1]
            inside = [u for _, u in points if (u == v if r == 0 else (at if at < v else v - r) < u < (at if at > v else v + r))]
            total += psi(k) - psi(len(near) + 1) - psi(max(1, len(inside)))
        assert math.isclose(got[f], max(0.0, psi(len(points)) + total / len(points)), abs_tol=1e-9), f
    assert got["told"] > 0.5 and got["noise"] < 0.2 and got["flat"] < 1e-9 and len(got) == 5


def test_bootstrap(spark):
    values = RNG.normal(10, 2, 400).tolist()
    data = spark.createDataFrame([(i, "a" if i < 390 else "b", v) for i, v in enumerate(values)] + [(900, "a", None), (901, "c", None)], "k int, g string, v double")
    got = {r["g"]: r for r in B.bootstrap_means(data.repartition(7), ["g"], "v", "k", 400).collect()}
    again = {r["g"]: r for r in B.bootstrap_means(data.coalesce(1), ["g"], "v", "k", 400).collect()}
    assert all(math.isclose(got[g][c], again[g][c]) for g in got for c in ("mean", "low", "high")) and sorted(got) == ["a", "b"]
    a = np.array(values[:390])
    error = a.std(ddof=1) / math.sqrt(390)
    assert math.isclose(got["a"]["mean"], a.mean()) and got["a"]["n"] == 390
    assert abs(got["a"]["low"] - (a.mean() - 1.96 * error)) < 0.5 * error and abs(got["a"]["high"] - (a.mean() + 1.96 * error)) < 0.5 * error
    weights = spark.range(20_000).select(B.weight(F.col("id"), F.lit(3)).alias("w")).agg(F.avg("w"), F.var_samp("w")).first()
    assert abs(weights[0] - 1) < 0.03 and abs(weights[1] - 1) < 0.05


def test_correlations_in_blocks(spark):
    x = RNG.normal(size=(120, 23)) * 10.0 ** RNG.integers(-3, 4, 23) + 100
    x[:, 3], x[:, 7] = 5.1, x[:, 2] * -2
    x[RNG.random(x.shape) < 0.1] = np.nan
    x[0, 0], x[:, 11] = np.inf, np.nan
    x[:, 3] = 5.1
    names = [f"f{i}" for i in range(23)]
    data = spark.createDataFrame([(r.tolist(),) for r in x], "vec array<double>").repartition(6)
    for block, salts in ((256, 32), (5, 2), (1, 1)):
        got = {(r["a"], r["b"]): r for r in G.block_correlations(data, names, block=block, salts=salts).collect()}
        assert len(got) == 23 * 22 // 2
        for i in range(23):
            for j in range(i + 1, 23):
                both = np.isfinite(x[:, i]) & np.isfinite(x[:, j])
                r, want = got[names[i], names[j]]["r"], None
                if both.sum() > 1 and x[both, i].std() > 0 and x[both, j].std() > 1e-12:
                    want = np.corrcoef(x[both, i], x[both, j])[0, 1]
                assert got[names[i], names[j]]["n"] == both.sum() and (r is None if want is None or 3 in (i, j) else math.isclose(r, want, abs_tol=1e-7))


def test_plan_of_thousands_of_features_is_small(spark):
    n = 2660
    data = spark.range(40).select(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.rand(3) + i * 0.001 * F.col("id")).alias("vec"))
    pairs = G.block_correlations(data, [f"f{i}" for i in range(n)])
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert len(plan) < 20_000
    top = pairs.agg(F.count("*"), F.max("r")).first()
    assert top[0] == n * (n - 1) // 2 and top[1] <= 1


def test_split_statistics(spark):
    rng = random.Random(4)
    cells = [("hot", rng.choice([0.1, 0.2, 7.0, -3.5])) for _ in range(3000)] + [("even", float(i)) for i in range(1000)] + [(None, 1.0), (None, 3.0), ("one", 2.0), ("none", None), ("nan", math.nan), ("mixed", math.inf), ("mixed", -1.0), ("mixed", math.nan)]
    long = spark.createDataFrame([("s", f, v) for f, v in cells], "sample_name string, feature string, value double").repartition(9)
    want = {r["feature"]: r for r in A.ten_statistics(long).collect()}
    got = {r["feature"]: r for r in Q.split_statistics(long).collect()}
    assert got.keys() == want.keys()
    for f in want:
        for s in A.STATISTICS:
            a, b = got[f][s], want[f][s]
            assert (a is None and b is None) or math.isclose(a, b, rel_tol=1e-12) or (math.isnan(a) and math.isnan(b)), (f, s, a, b)


def all_plans(counts, k):
    """Is there a plan of k folds at all? Every way of dealing groups."""
    groups, labels = list(counts), {x for c in counts.values() for x in c}
    return any(all({x for g, f in zip(groups, deal) if f == fold for x in counts[g]} == labels for fold in range(k)) for deal in itertools.product(range(k), repeat=len(groups)))


def test_plans_of_groups_equal_trying_all():
    rng = random.Random(6)
    found = 0
    for _ in range(150):
        labels = "ABCD"[: rng.randint(2, 4)]
        counts = {f"g{i}": {x: rng.randint(1, 9) for x in rng.sample(labels, rng.randint(1, len(labels)))} for i in range(rng.randint(2, 7))}
        plan = S.plan_groups(counts, 4)
        best = max((k for k in (2, 3, 4) if all_plans(counts, k)), default=None)
        assert (None if plan is None else max(plan.values()) + 1) == best
        if plan:
            found += 1
            every = {x for c in counts.values() for x in c}
            assert plan.keys() == counts.keys() and all({x for g in counts if plan[g] == f for x in counts[g]} == every for f in range(best))
    assert 30 < found < 150
    # dealing by size alone misses this plan
    hard = {"a": {"A": 9, "B": 1}, "b": {"B": 9, "C": 1}, "c": {"C": 9, "A": 1}, "d": {"A": 5}, "e": {"B": 5}, "f": {"C": 5}}
    assert max(S.plan_groups(hard, 5).values()) == 2
    big = {f"g{i}": {rng.choice("ABCDE"): 1, rng.choice("ABCDE"): 2} for i in range(60)}
    assert S.plan_groups(big, 5) is not None


def test_feasibility_makes_the_plans(spark):
    rows = lambda groups: spark.createDataFrame([(x, g) for g, labels in groups.items() for x in labels], "label string, g string")
    good = S.feasibility(rows({f"g{i}": "AB" for i in range(9)}), "label", "g")
    assert (good["status"], good["outer"], good["inner"]) == ("suitable", 3, [5, 5, 5])
    few = S.feasibility(rows({f"g{i}": "AB" for i in range(4)}), "label", "g")
    assert (few["status"], few["outer"], few["inner"]) == ("limited", 3, [2, 3, 3]) and few["ok"]
    two = S.feasibility(rows({"g1": "AB", "g2": "AB"}), "label", "g")
    assert two["status"] == "unavailable" and "outer fold 1" in two["reason"] and S.feasibility(rows({"g1": "AB", "g2": "AB"}), "label", "g", nested=False)["status"] == "limited"
    # as many groups a class as folds, but no plan: counts alone would call it feasible
    crossed = {"a": {"A": 1, "B": 1}, "b": {"A": 1, "C": 1}, "c": {"B": 1, "C": 1}}
    assert S.plan_groups(crossed, 3) is None
    assert S.feasibility(rows({g: "".join(c) for g, c in crossed.items()}), "label", "g")["errors"] == ["no grouped plan has every class in every training and test fold"]
