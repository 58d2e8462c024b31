import pytest
from pyspark.sql import functions as F

from stratalith.functions import names as N
from stratalith.functions import numbers as X

SAMPLE = "17052021--s--Ec--st--K12a--p--B11--pos017--tm--6--ch--Dapi--z--40"
FIELDS = ["17052021", "Ec", "K12a", "B11", "017", "6", "Dapi", "40"]


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_image_names(spark):
    rows = spark.createDataFrame([(SAMPLE.replace("--", "_") + ".tiff",), ("notes of monday.tif",)], "f string")
    got = rows.select(N.is_image_name(N.stem(F.col("f"))), N.image_field(N.stem(F.col("f")), "label"), N.image_field(N.stem(F.col("f")), "date")).collect()
    assert [tuple(r) for r in got] == [(True, "K12a", "17052021"), (False, "", "")]


def test_fields_of_a_name(spark):
    parts = SAMPLE.split("--")
    # what a name of other separators tells, counted by hand: time, channel and z are tokens 3, 4 and 5 behind `p`, as published
    odd = ["17052021", "Ec", "K12a", "B11", "017", "", "6", "ch"]
    cases = {SAMPLE: FIELDS, SAMPLE.replace("--", "_"): FIELDS, SAMPLE.replace("--", "-").upper(): [x.upper() for x in FIELDS], "dir.x/" + SAMPLE + ".tif": FIELDS}
    cases |= {"___".join(parts): odd, "___".join(parts) + ".tif": odd}
    cases |= {"___".join(parts[:k]): None for k in range(14)}  # cut short: no field at all
    cases |= {"x".join(parts): None, "": None, "1" + SAMPLE: None, "17052021" + "-a" * 14: None, "17052021" + "_-a" * 10 + "--st--L--p--W--pos1": None, None: None}
    rows = spark.createDataFrame([(k,) for k in cases], "s string")
    got = {r[0]: r[1] for r in rows.select("s", N.sample_fields(F.col("s"))).collect()}
    assert got == cases


def test_sample_keys(spark):
    s = F.lit(SAMPLE)
    assert one(spark, *[N.replication_group(s, u) for u in ("date", "well", "position")]) == ("17052021", "17052021::B11", "17052021::B11::017")
    assert one(spark, N.without_position(s)) == (SAMPLE.replace("--pos017", ""),)
    assert one(spark, N.token(s, 4), N.token(s, 40)) == ("K12a", None)
    assert one(spark, N.pool(s), N.sub_pool(s), N.date_and_strain(s)) == ("K12a", "17052021::B11", "17052021::K12a")
    with pytest.raises(ValueError, match="date, well, or position"):
        N.replication_group(s, "dish")


def test_configurations_by_name(spark):
    # (setting, components, flag): key, words, sorted after how many of the others
    cases = [(None, "all", "1", "all_columns", "All generated columns", 0), ("ALL", "7", "no", "all", "All generated columns", 0), (" ", "all", "no", "threshold_only", "Threshold-derived columns only", 2)]
    cases += [(None, "16", "no", "svd_16", "SVD 16 components", 3), ("nan", "64.0", "yes", "svd_64", "SVD 64 components", 4), ("svd_100_threshold_only", "16", "1", "svd_100_threshold_only", "SVD 100 components (threshold-derived input)", 5)]
    cases += [("svd_x_all_columns", None, None, "svd_x_all_columns", "SVD x components", 6), ("by_hand", "all", "1", "by_hand", "By hand", 6)]
    rows = spark.createDataFrame([c[:3] for c in cases], "setting string, n string, flag string")
    key = N.configuration_key(F.col("setting"), F.col("n"), F.col("flag"))
    got = rows.select(key, N.configuration_display(key), N.configuration_order(key)).collect()
    assert [tuple(r)[:2] for r in got] == [c[3:5] for c in cases]
    order = [tuple(r[2])[:2] for r in got]
    assert [sum(x < mine for x in order) for mine in order] == [c[5] for c in cases]
    assert one(spark, N.configuration_key(F.lit(None).cast("string"), F.lit("2660"), F.lit(None).cast("string"))) == ("all_columns",)


def test_namespaces(spark):
    both = F.lit("/x/DiffGlobal/aCustomAlgosDiffGlobal.txt")
    assert one(spark, N.namespace_of(both), N.namespace_of(F.lit("/CustomAlgos/other.txt"))) == ("CustomAlgos", None)
    assert one(spark, N.sample_from_file(F.lit("a_b_cDiffGlobal.txt"))) == ("a--b--c",)


def test_families(spark):
    names = ["ThicknessThreshold=0.25-SUMMARYCustomAlgos.tsv_q75.txt", "ph_reading"]
    assert one(spark, *[N.is_generated_feature(F.lit(n)) for n in names]) == (True, False)
    assert one(spark, N.feature_name(F.lit("mean"), F.lit("DiffGlobal"), F.lit("q10"))) == ("mean-SUMMARYDiffGlobal.tsv_q10.txt",)
    assert one(spark, N.disk_name(F.lit("counts(inten<0.1"))) == ("counts-inten_lt_0.1",)


def test_report_names(spark):
    long = "AVeryWordyLearner(depth=3) " * 9
    name = one(spark, N.safe_report_name(F.lit(long)))[0]
    assert len(name) <= 80 and name == one(spark, N.safe_report_name(F.lit(long)))[0] and len(name.rsplit("_", 1)[1]) == 12
    assert one(spark, N.canonical_learner(F.lit("RandomizedSearchCV(estimator=RandomForestClassifier())"))) == ("rf",)
    titles = {"classification": "All generated columns", "classification_all": "All generated columns", "classification_no_counts_features": "Without count-derived columns", "classification_my_run-2": "My run-2"}
    assert one(spark, *[N.classification_title(F.lit(k)) for k in titles]) == tuple(titles.values())
    assert one(spark, N.classification_scope(F.lit("classification_no_counts_features")), N.classification_scope(F.lit("classification"))) == ("no_counts_features_", "")


def test_imputation(spark):
    rows = spark.createDataFrame([("f", 1.0), ("f", float("inf")), ("f", float("-inf")), ("f", float("nan")), ("g", float("inf"))], "feature string, v double")
    got = [(r[0], r[1]) for r in rows.select("feature", X.impute(F.col("v"), "feature")).collect()]
    assert sorted(got) == sorted([("f", 1.0), ("f", 4.140000000000001), ("f", -666.0), ("f", -666.0), ("g", -666.0)])


def test_numbers(spark):
    texts = ["1", " 2.5e3 ", "1d", "inf", "", "x", ".5", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in rows.select(X.as_number(F.col("t"))).collect()] == [1.0, 2500.0, None, float("inf"), None, None, 0.5, None]
    assert len(X.THRESHOLDS) == 29 and X.THRESHOLDS[5] == 0.060000000000000005
    assert one(spark, *[F.round(X.luma(*(F.lit(float(c)) for c in rgb)), 4) for rgb in ((255, 0, 0), (255, 255, 255))]) == (76.2195, 254.9745)
    assert X.planned_fits("random", 5, draws=10) == 50 and X.planned_fits("grid", 3, grid=28) == 84 and X.planned_fits("none", 3) == 1
