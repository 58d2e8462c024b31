"""Queries over folds, pools and result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names as N
from ..operators import evaluate as V
from ..operators import folds as S
from .registry import query, table

_FOLDS = "(SELECT vec_id, label, CAST((row_number() OVER (PARTITION BY label ORDER BY md5(CAST(vec_id AS VARCHAR)), vec_id) - 1) % 3 AS INTEGER) AS fold FROM embeddings)"


def _embedded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "label")


@query(f"SELECT vec_id, label, fold FROM {_FOLDS}")
def stratified_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.stratified_folds(_embedded(spark, sf_dir), "label", "vec_id", 3).select("vec_id", "label", "fold")


@query(f"SELECT fold, CAST(sum(n) AS BIGINT) AS n, count(*) AS test_labels, count(*) FILTER (t > n) AS train_labels_of_test FROM (SELECT fold, label, count(*) AS n, sum(count(*)) OVER (PARTITION BY label) AS t FROM {_FOLDS} GROUP BY fold, label) GROUP BY fold")
def fold_class_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.fold_coverage(S.stratified_folds(_embedded(spark, sf_dir), "label", "vec_id", 3), "label")


@query("SELECT min(n) AS smallest_class, CAST(least(5, min(n)) AS INTEGER) AS k, count(*) AS classes, min(n) >= 2 AS feasible FROM (SELECT label, count(*) AS n FROM embeddings GROUP BY label)")
def adaptive_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.adaptive_k(_embedded(spark, sf_dir), "label")


@query("SELECT user_id AS test_group, test_n, CAST(sum(test_n) OVER () - test_n AS BIGINT) AS train_n, count(*) OVER () - 1 AS train_groups FROM (SELECT user_id, count(event_id) AS test_n FROM events GROUP BY user_id)")
def logo_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.leave_one_out(table(spark, sf_dir, "events"), "user_id", "event_id")


@query("""WITH r AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS n, row_number() OVER (ORDER BY label, vec_id) - 1 AS place FROM embeddings),
a AS (SELECT label, place % 10 AS f, count(*) AS c FROM r GROUP BY ALL), g AS (SELECT label, f FROM (SELECT DISTINCT label FROM r), range(0, 10) t(f)),
b AS (SELECT g.label, sum(coalesce(a.c, 0)) OVER (PARTITION BY g.label ORDER BY g.f) AS upto FROM g LEFT JOIN a ON a.label = g.label AND a.f = g.f)
SELECT vec_id, label, CAST((SELECT count(*) FROM b WHERE b.label = r.label AND b.upto <= r.n) AS INTEGER) AS fold FROM r""")
def ordered_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten stratified folds without a shuffle."""
    return S.ordered_folds(table(spark, sf_dir, "embeddings").select("vec_id", "label"), "label", "vec_id")


@query("SELECT user_id, folds FROM (SELECT user_id, count(DISTINCT event_id % 2) AS folds FROM events GROUP BY user_id) WHERE folds > 1")
def group_disjointness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.shared_groups(table(spark, sf_dir, "events").select("user_id", (F.col("event_id") % 2).alias("fold")), "user_id")


@query("""WITH r AS (SELECT o_orderpriority AS label, o_custkey % 20 AS well FROM orders), g AS (SELECT label, well, count(*) AS c, row_number() OVER (PARTITION BY label ORDER BY md5(CAST(well AS VARCHAR)), well) AS rank FROM r GROUP BY label, well)
SELECT n_pools, label, CAST(sum(c) AS BIGINT) AS n_rows, count(*) AS groups FROM g, (VALUES (1), (5), (10), (20)) t(n_pools) WHERE rank <= n_pools GROUP BY ALL""")
def learning_curve_pools(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("label"), (F.col("o_custkey") % 20).alias("well"))
    return S.pooled_sizes(rows, "label", "well", [1, 5, 10, 20])


@query(f"""WITH c AS (SELECT f.fold, l.label, count(*) FILTER (x.fold <> f.fold) AS train, count(*) FILTER (x.fold = f.fold) AS here FROM (SELECT DISTINCT fold FROM {_FOLDS}) f, (SELECT DISTINCT label FROM embeddings) l, {_FOLDS} x WHERE x.label = l.label GROUP BY ALL)
SELECT fold, label AS majority, round(here / size, 6) AS accuracy FROM (SELECT *, sum(here) OVER (PARTITION BY fold) AS size, row_number() OVER (PARTITION BY fold ORDER BY train DESC, label) AS r FROM c) WHERE r = 1""")
def majority_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.majority(S.stratified_folds(_embedded(spark, sf_dir), "label", "vec_id", 3)).withColumn("accuracy", F.round("accuracy", 6))


# predictions made of labels: two models of three configurations, wrong where a hash says so
_PRED = "(SELECT vec_id, CASE WHEN vec_id % 2 = 0 THEN 'rf' ELSE 'dummy' END AS model, CASE vec_id % 3 WHEN 0 THEN 'all' WHEN 1 THEN '16' ELSE '32' END AS n_components, vec_id % 5 < 3 AS thr_features, CAST(vec_id % 4 AS INTEGER) AS fold, 'L' || CAST(label AS VARCHAR) AS truth, 'L' || CAST(CASE WHEN (vec_id * 7) % 11 < 4 THEN (label + vec_id) % 12 ELSE label END AS VARCHAR) AS predicted FROM embeddings)"


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, label = F.col("vec_id"), F.col("label")
    wrong = F.when((v * 7) % 11 < 4, (label + v) % 12).otherwise(label)
    return table(spark, sf_dir, "embeddings").select("vec_id", F.when(v % 2 == 0, "rf").otherwise("dummy").alias("model"), F.when(v % 3 == 0, "all").when(v % 3 == 1, "16").otherwise("32").alias("n_components"), (v % 5 < 3).alias("thr_features"), (v % 4).cast("int").alias("fold"), F.concat(F.lit("L"), label.cast("string")).alias("truth"), F.concat(F.lit("L"), wrong.cast("string")).alias("predicted"))


_ACC = f"(SELECT model, n_components, thr_features, fold, avg(CAST(truth = predicted AS INTEGER)) AS accuracy, count(*) AS n FROM {_PRED} GROUP BY ALL)"
_KEYS = ["model", "n_components", "thr_features", "fold"]


@query(f"SELECT model, n_components, thr_features, fold, round(accuracy, 6) AS accuracy, n FROM {_ACC}")
def accuracy_by_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.accuracy(predictions(spark, sf_dir), *_KEYS).withColumn("accuracy", F.round("accuracy", 6))


@query(f"SELECT model, n_components, thr_features, round(m, 6) AS mean_accuracy FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY CASE WHEN n_components = 'all' AND thr_features THEN 0 ELSE 1 END, round(m, 12) DESC, n_components, thr_features) AS r FROM (SELECT model, n_components, thr_features, avg(accuracy) AS m FROM {_ACC} WHERE NOT (model = 'dummy' AND n_components = 'all') GROUP BY ALL)) WHERE r = 1")
def best_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = V.accuracy(predictions(spark, sf_dir), *_KEYS).filter(~((F.col("model") == "dummy") & (F.col("n_components") == "all")))
    return V.best_configuration(results).withColumn("mean_accuracy", F.round("mean_accuracy", 6))


@query(f"SELECT model, configuration, round(avg(accuracy), 6) AS mean, round(stddev_samp(accuracy), 6) AS std, round(avg(accuracy) - 1.96 * stddev_samp(accuracy) / sqrt(count(*)), 6) AS low, round(avg(accuracy) + 1.96 * stddev_samp(accuracy) / sqrt(count(*)), 6) AS high, count(*) AS n FROM (SELECT model, n_components || CASE WHEN thr_features THEN '_t' ELSE '_f' END AS configuration, accuracy FROM {_ACC}) GROUP BY ALL")
def config_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = V.accuracy(predictions(spark, sf_dir), *_KEYS).withColumn("configuration", F.concat("n_components", F.when(F.col("thr_features"), "_t").otherwise("_f")))
    out = V.mean_by_configuration(results)
    return out.select("model", "configuration", *[F.round(c, 6).alias(c) for c in ("mean", "std", "low", "high")], "n")


_CONF = f"(SELECT a.l AS truth, b.l AS predicted, count(p.vec_id) AS n FROM (SELECT truth AS l FROM {_PRED} UNION SELECT predicted FROM {_PRED}) a CROSS JOIN (SELECT truth AS l FROM {_PRED} UNION SELECT predicted FROM {_PRED}) b LEFT JOIN {_PRED} p ON p.truth = a.l AND p.predicted = b.l GROUP BY ALL)"


@query(f"SELECT truth, predicted, n FROM {_CONF}")
def confusion_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.confusion(predictions(spark, sf_dir))


@query(f"SELECT truth, predicted, round(coalesce(n / nullif(sum(n) OVER (PARTITION BY truth), 0), 0), 6) AS share FROM {_CONF}")
def confusion_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.normalised_confusion(V.confusion(predictions(spark, sf_dir))).withColumn("share", F.round("share", 6))


@query(f"SELECT round(sum(n) FILTER (truth = predicted) / sum(n), 6) AS accuracy FROM {_CONF}")
def trace_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.trace_accuracy(V.confusion(predictions(spark, sf_dir))).withColumn("accuracy", F.round("accuracy", 6))


@query(f"""WITH t AS (SELECT truth AS l, sum(n) AS support, sum(n) FILTER (truth = predicted) AS tp FROM {_CONF} GROUP BY 1), s AS (SELECT predicted AS l, sum(n) AS seen FROM {_CONF} GROUP BY 1)
SELECT round(sum(coalesce(2 * coalesce(tp, 0) / nullif(support + seen, 0), 0) * support) / sum(support), 6) AS weighted_f1 FROM t JOIN s USING (l)""")
def weighted_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.weighted_f1(V.confusion(predictions(spark, sf_dir))).withColumn("weighted_f1", F.round("weighted_f1", 6))


_LISTS = f"(SELECT model, n_components, fold, string_agg(truth, ',' ORDER BY vec_id) AS test_set, string_agg(predicted, ',' ORDER BY vec_id) AS predicted_set FROM {_PRED} GROUP BY ALL)"


@query(f"SELECT * FROM {_LISTS}")
def result_join_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.join_lists(predictions(spark, sf_dir), ["model", "n_components", "fold"], "vec_id")


@query(f"SELECT model, n_components, fold, CAST(i - 1 AS INTEGER) AS position, string_split(test_set, ',')[i] AS truth, string_split(predicted_set, ',')[i] AS predicted FROM {_LISTS}, range(1, 10000) t(i) WHERE i <= len(string_split(test_set, ',')) AND fold <> 3")
def result_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = V.join_lists(predictions(spark, sf_dir), ["model", "n_components", "fold"], "vec_id")
    broken = lists.withColumn("predicted_set", F.when(F.col("fold") != 3, F.col("predicted_set")).otherwise(F.concat("predicted_set", F.lit(",x"))))
    return V.explode_lists(broken)


# names of current and legacy results
# names and settings as result files have them, dealt over orders: {n} is a number of the order
_MODELS = ["rf", "RandomForestClassifier(n_estimators={n})", "DummyClassifier()", "GridSearchCV(estimator=KNeighborsClassifier({n}))", "XGBClassifier(" + "x" * 120 + "{n})", "  odd   learner (v{n}) ", "odd  " + "long name " * 12 + "{n}", "LogisticRegression(max_iter={n})", "decisiontree", "", " Dummy "]
_COMPONENTS = ["all", "16", "64.0", "128", "2660", "x", "512"]
_FLAGS = ["true", "1", "False", "no", "YES"]
_NAMED = [None, "nan", "", "All_Columns", "svd_16_threshold_only", "custom_setting", "threshold_only", "svd_32"]


def _sql_list(values: list) -> str:
    return "[" + ", ".join("NULL" if v is None else f"'{v}'" for v in values) + "]"


_VALUES = f"""(SELECT replace({_sql_list(_MODELS)}[o_orderkey % 11 + 1], '{{n}}', CAST(o_custkey % 50 AS VARCHAR)) AS model, {_sql_list(_COMPONENTS)}[o_custkey % 7 + 1] AS n_components,
 {_sql_list(_FLAGS)}[(o_orderkey + o_custkey) % 5 + 1] AS thr_features, {_sql_list(_NAMED)}[o_custkey % 8 + 1] AS component_setting, o_custkey % 1000 / 1000.0 AS accuracy FROM orders) v"""


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, customer = F.col("o_orderkey"), F.col("o_custkey")
    pick = lambda values, i: F.get(F.array(*[F.lit(v).cast("string") for v in values]), (i % len(values)).cast("int"))
    model = F.replace(pick(_MODELS, key), F.lit("{n}"), (customer % 50).cast("string"))
    return table(spark, sf_dir, "orders").select(model.alias("model"), pick(_COMPONENTS, customer).alias("n_components"), pick(_FLAGS, key + customer).alias("thr_features"), pick(_NAMED, customer).alias("component_setting"), (customer % 1000 / 1000.0).alias("accuracy"))


_CANON = "CASE WHEN lower(r) IN (" + ", ".join(f"'{k}'" for k in N.LEARNERS) + ") THEN lower(r) " + " ".join(f"WHEN contains(lower(r), '{p}') THEN '{k}'" for p, k in N.LEARNER_CLASSES) + " WHEN r = '' THEN 'model' ELSE r END"
_RAW = rf"(SELECT *, trim(regexp_replace(model, '\s+', ' ', 'g')) AS r FROM {_VALUES})"


@query(f"SELECT model, {_CANON} AS learner, count(*) AS n_orders FROM {_RAW} GROUP BY ALL")
def canonical_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _results(spark, sf_dir).groupBy("model").agg(F.count("*").alias("n_orders")).select("model", N.canonical_learner(F.col("model")).alias("learner"), "n_orders")


_SAFE = rf"(SELECT model, CASE WHEN r = '' THEN 'model' ELSE r END AS raw, regexp_replace(regexp_replace({_CANON}, '[^A-Za-z0-9_-]+', '_', 'g'), '^_+|_+$', '', 'g') AS safe FROM {_RAW})"


@query(f"SELECT DISTINCT model, CASE WHEN length(safe) > 80 THEN regexp_replace(substr(safe, 1, 67), '_+$', '') || '_' || substr(sha256(raw), 1, 12) WHEN safe = '' THEN 'model' ELSE safe END AS report_name FROM {_SAFE}")
def safe_report_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _results(spark, sf_dir).select("model").distinct().select("model", N.safe_report_name(F.col("model")).alias("report_name"))


_CONFIG = r"""(SELECT *, CASE WHEN s NOT IN ('', 'nan') THEN s WHEN lower(n_components) = 'all' THEN e WHEN regexp_replace(n_components, '\.0*$', '') IN ('16', '32', '64', '128', '256', '512') THEN 'svd_' || regexp_replace(n_components, '\.0*$', '') ELSE e END AS k
FROM (SELECT *, lower(trim(coalesce(component_setting, ''))) AS s, CASE WHEN lower(trim(thr_features)) IN ('true', '1', 'yes') THEN 'all_columns' ELSE 'threshold_only' END AS e FROM
 (SELECT n_components, thr_features, component_setting, count(*) AS n, avg(accuracy) AS accuracy FROM """ + _VALUES + " GROUP BY ALL)))"


@query(rf"""SELECT n_components, thr_features, component_setting, n, round(accuracy, 9) AS accuracy, k AS configuration, CASE WHEN k IN ('all', 'all_columns') THEN 'All generated columns' WHEN k = 'threshold_only' THEN 'Threshold-derived columns only'
 WHEN starts_with(k, 'svd_') THEN 'SVD ' || regexp_extract(k, '^svd_(.+?)(_(all_columns|threshold_only))?$', 1) || ' components' || CASE WHEN ends_with(k, '_threshold_only') THEN ' (threshold-derived input)' ELSE '' END
 ELSE upper(substr(k, 1, 1)) || replace(substr(k, 2), '_', ' ') END AS configuration_name,
 row_number() OVER (ORDER BY CASE WHEN k IN ('all', 'all_columns') THEN 0 WHEN k = 'threshold_only' THEN 1 ELSE 2 END, coalesce(TRY_CAST(regexp_extract(k, '^svd_([0-9.]+)', 1) AS DOUBLE), CASE WHEN k IN ('all', 'all_columns', 'threshold_only') THEN 0 ELSE 1e9 END), k, n_components, thr_features, component_setting NULLS FIRST) AS place FROM {_CONFIG}""")
def configuration_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    by = ["n_components", "thr_features", "component_setting"]
    rows = _results(spark, sf_dir).groupBy(*by).agg(F.count("*").alias("n"), F.round(F.avg("accuracy"), 9).alias("accuracy"))
    named = V.with_configuration(rows.withColumn("model", F.lit("rf")))
    place = F.row_number().over(Window.orderBy(N.configuration_order(F.col("configuration")), *by))
    return named.select(*by, "n", "accuracy", "configuration", "configuration_name", place.cast("long").alias("place"))


# thirty learners: every third one has results with settings, every third one with flags, and every fifth one with other columns than its largest number
_PREF = f"""(SELECT CAST(o_custkey % 30 AS VARCHAR) AS model, CASE WHEN o_custkey % 5 = 0 THEN 'x' ELSE {_sql_list(_COMPONENTS)}[o_orderkey % 7 + 1] END AS n_components, CASE WHEN o_custkey % 3 = 1 THEN ['true', 'no'][o_orderkey % 2 + 1] ELSE 'no' END AS thr_features,
 CASE WHEN o_custkey % 3 = 0 THEN {_sql_list(_NAMED)}[o_orderkey % 8 + 1] END AS component_setting, o_custkey % 1000 / 1000.0 AS accuracy FROM orders WHERE o_custkey % 4 <> 0 OR o_orderkey % 7 <> 0) v"""


@query(f"""WITH a AS (SELECT *, lower(coalesce(component_setting, '')) IN ('all', 'all_columns') AS ex, thr_features IN ('true', '1', 'yes') AS fl FROM {_PREF}),
b AS (SELECT *, bool_or(ex) OVER (PARTITION BY model) AS anyex, bool_or(fl) OVER (PARTITION BY model) AS anyfl FROM a), c AS (SELECT * FROM b WHERE CASE WHEN anyex THEN ex WHEN anyfl THEN fl ELSE TRUE END),
d AS (SELECT *, bool_or(n_components = 'all') OVER (PARTITION BY model) AS anyall, max(TRY_CAST(n_components AS DOUBLE)) OVER (PARTITION BY model) AS top FROM c)
SELECT model, n_components, thr_features, component_setting, CAST(accuracy AS DOUBLE) AS accuracy FROM d WHERE anyex OR CASE WHEN anyall THEN n_components = 'all' ELSE top IS NULL OR TRY_CAST(n_components AS DOUBLE) = top END""")
def preferred_configuration(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, customer = F.col("o_orderkey"), F.col("o_custkey")
    pick = lambda values: F.get(F.array(*[F.lit(v).cast("string") for v in values]), (key % len(values)).cast("int"))
    rows = table(spark, sf_dir, "orders").filter((customer % 4 != 0) | (key % 7 != 0))
    return V.preferred_configuration(
        rows.select(
            (customer % 30).cast("string").alias("model"),
            F.when(customer % 5 == 0, "x").otherwise(pick(_COMPONENTS)).alias("n_components"),
            F.when(customer % 3 == 1, pick(["true", "no"])).otherwise("no").alias("thr_features"),
            F.when(customer % 3 == 0, pick(_NAMED)).alias("component_setting"),
            (customer % 1000 / 1000.0).alias("accuracy"),
        )
    )


@query(f"SELECT m.model, c.n_components, f.fold FROM (SELECT DISTINCT model FROM {_PRED}) m, (VALUES ('all'), ('16'), ('64')) c(n_components), (SELECT CAST(i AS INTEGER) AS fold FROM range(0, 6) t(i)) f WHERE NOT EXISTS (SELECT 1 FROM {_PRED} p WHERE p.model = m.model AND p.n_components = c.n_components AND p.fold = f.fold)")
def pending_evaluations(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = predictions(spark, sf_dir).select("model", "n_components", "fold").distinct()
    planned = done.select("model").distinct().withColumn("n_components", F.explode(F.array(*[F.lit(c) for c in ("all", "16", "64")]))).withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(5))))
    return V.pending(planned, done, ["model", "n_components", "fold"])


@query()
def grouped_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole groups to folds; the rule is our own, its invariants are tested."""
    rows = table(spark, sf_dir, "events").select((F.col("user_id") % 12).alias("well"), F.col("event_type").alias("label"))
    return S.grouped_folds(rows, "label", "well")
