"""Queries over rankings, correlations, neighbours, profiles and explanations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import explain as E
from ..operators import structure as S
from ..sources import occupancy as O
from ..sources import progress as P
from .registry import query, table

_DIMS = 64
_NAMES = [f"d{i}" for i in range(_DIMS)]
_LONG = f"(SELECT vec_id, label, 'd' || CAST(i - 1 AS VARCHAR) AS feature, CAST(i - 1 AS INTEGER) AS pos, CAST(embedding[i] AS DOUBLE) AS value FROM embeddings, range(1, {_DIMS + 1}) t(i))"
_SCORES = f"(SELECT feature, round(var_pop(value), 9) AS score FROM {_LONG} GROUP BY feature)"


def long_dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.posexplode(F.slice("embedding", 1, _DIMS)).alias("pos", "v"))
    return rows.select("vec_id", "label", F.concat(F.lit("d"), F.col("pos").cast("string")).alias("feature"), "pos", F.col("v").cast("double").alias("value"))


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return long_dims(spark, sf_dir).groupBy("feature").agg(F.round(F.var_pop("value"), 9).alias("score"))


@query(f"SELECT feature, score FROM {_SCORES} ORDER BY score DESC, feature LIMIT 5")
def topk_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.top_features(scores(spark, sf_dir), 5)


@query(f"SELECT feature, score FROM {_SCORES} WHERE score >= 0.0155")
def score_cutoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(spark, sf_dir).filter(F.col("score") >= 0.0155)


@query(f"SELECT CAST(n AS INTEGER) AS top_n, CAST(place AS INTEGER) AS place, feature FROM (SELECT *, row_number() OVER (ORDER BY score DESC, feature) AS place FROM {_SCORES}), range(1, {_DIMS}, 4) t(n) WHERE place <= n")
def prefix_subsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.prefixes(scores(spark, sf_dir), 4)


_CELL = "CASE WHEN i = 5 THEN 1.0::DOUBLE WHEN i = 6 AND vec_id % 7 = 0 THEN 'inf'::DOUBLE WHEN i = 6 AND vec_id % 11 = 0 THEN 'nan'::DOUBLE WHEN i = 8 THEN embedding[1]::DOUBLE * 2 + embedding[9]::DOUBLE * 0.3 WHEN i = 10 THEN -embedding[1]::DOUBLE + embedding[11]::DOUBLE * 0.2 ELSE embedding[i]::DOUBLE END"
_MADE = f"(SELECT vec_id, CAST(i - 1 AS INTEGER) AS pos, CASE WHEN isfinite(v) THEN v END AS v FROM (SELECT vec_id, i, {_CELL} AS v FROM embeddings, range(1, {_DIMS + 1}) t(i)))"
_CORR = f"""(SELECT 'd' || CAST(pa AS VARCHAR) AS a, 'd' || CAST(pb AS VARCHAR) AS b, pa, pb, covar_pop(va, vb) / nullif(stddev_pop(va) * stddev_pop(vb), 0) AS r, count(*) AS n
FROM (SELECT x.pos AS pa, y.pos AS pb, x.v AS va, y.v AS vb FROM {_MADE} x JOIN {_MADE} y ON x.vec_id = y.vec_id AND x.pos < y.pos WHERE x.v IS NOT NULL AND y.v IS NOT NULL) GROUP BY pa, pb)"""


def _made(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dimensions with a constant, holes, infinities and dependent ones among them."""
    at = lambda i: F.get("embedding", F.lit(i)).cast("double")
    v = F.col("vec_id")
    cells = [at(i) for i in range(_DIMS)]
    cells[4] = F.lit(1.0)
    cells[5] = F.when(v % 7 == 0, float("inf")).when(v % 11 == 0, float("nan")).otherwise(at(5))
    cells[7] = at(0) * 2 + at(8) * 0.3
    cells[9] = -at(0) + at(10) * 0.2
    return table(spark, sf_dir, "embeddings").select("vec_id", F.array(*cells).alias("vec"))


@query(f"SELECT a, b, round(r, 6) AS r, n FROM {_CORR}")
def corr_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.correlations(_made(spark, sf_dir), _NAMES).withColumn("r", F.round("r", 6))


@query(f"""WITH RECURSIVE e AS MATERIALIZED (SELECT pa, pb FROM {_CORR} WHERE abs(r) > 0.8), s AS (SELECT pa AS x, pb AS y FROM e UNION SELECT pb, pa FROM e UNION SELECT CAST(i AS INTEGER), CAST(i AS INTEGER) FROM range(0, {_DIMS}) t(i)),
w(x, y) AS (SELECT x, y FROM s UNION SELECT w.x, s.y FROM w JOIN s ON w.y = s.x) SELECT 'd' || CAST(x AS VARCHAR) AS feature, 'd' || CAST(min(y) AS VARCHAR) AS cluster FROM w GROUP BY x""")
def corr_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(S.correlation_clusters(_NAMES, S.correlations(_made(spark, sf_dir), _NAMES)), "feature string, cluster string")


@query("""WITH q AS (SELECT o_orderpriority, count(*) AS n, quantile_cont(o_totalprice, 0.25) AS q1, median(o_totalprice) AS med, quantile_cont(o_totalprice, 0.75) AS q3 FROM orders GROUP BY 1)
SELECT o_orderpriority, any_value(n) AS n, round(any_value(q1), 4) AS q1, round(any_value(med), 4) AS median, round(any_value(q3), 4) AS q3, round(min(o_totalprice) FILTER (o_totalprice >= q1 - 1.5 * (q3 - q1)), 4) AS low, round(max(o_totalprice) FILTER (o_totalprice <= q3 + 1.5 * (q3 - q1)), 4) AS high FROM orders JOIN q USING (o_orderpriority) GROUP BY 1""")
def boxplot_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = S.box_statistics(table(spark, sf_dir, "orders"), ["o_orderpriority"], "o_totalprice")
    return out.select("o_orderpriority", "n", *[F.round(c, 4).alias(c) for c in ("q1", "median", "q3", "low", "high")])


@query("SELECT o_orderpriority AS facet, o_orderstatus AS x, round(median(o_totalprice), 4) AS median FROM orders GROUP BY ALL UNION ALL SELECT NULL, o_orderstatus, round(median(o_totalprice), 4) FROM orders GROUP BY ALL")
def facet_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").groupingSets([["o_orderpriority", "o_orderstatus"], ["o_orderstatus"]], "o_orderpriority", "o_orderstatus")
    return rows.agg(F.round(F.percentile("o_totalprice", F.lit(0.5)), 4).alias("median")).select(F.col("o_orderpriority").alias("facet"), F.col("o_orderstatus").alias("x"), "median")


@query("WITH j AS (SELECT p_brand, p_size % 5 AS label, count(*) AS n FROM part GROUP BY ALL), t AS (SELECT n, sum(n) OVER () AS all_n, sum(n) OVER (PARTITION BY p_brand) AS f, sum(n) OVER (PARTITION BY label) AS l FROM j) SELECT round(sum(n / all_n * ln(n * all_n / (f * l))), 6) AS mi FROM t")
def binned_mutual_information(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_brand", (F.col("p_size") % 5).alias("label"))
    return S.binned_information(rows, "p_brand", "label").withColumn("mi", F.round("mi", 6))


def _near(spark: SparkSession, sf_dir: str, k: int, metric: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("vec"))
    return S.neighbours(rows, rows.filter("vec_id % 100 = 0"), k, metric)


def _near_sql(k: int, metric: str) -> str:
    d = "sqrt(list_sum([(a.v[i] - b.v[i]) * (a.v[i] - b.v[i]) FOR i IN range(1, len(a.v) + 1)]))" if metric == "euclidean" else "list_sum([abs(a.v[i] - b.v[i]) FOR i IN range(1, len(a.v) + 1)])"
    v = "(SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"
    return f"(SELECT * FROM (SELECT a.vec_id AS query, b.vec_id AS neighbour, b.label AS label, round({d}, 9) AS distance, row_number() OVER (PARTITION BY a.vec_id ORDER BY round({d}, 9), b.vec_id) AS place FROM {v} a JOIN {v} b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0) WHERE place <= {k})"


def _vote_sql(near: str, ks: str) -> str:
    return f"""(SELECT query, k, weights, label AS predicted FROM (SELECT *, row_number() OVER (PARTITION BY query, k, weights ORDER BY round(v, 9) DESC, label) AS r FROM (SELECT query, k, weights, label, sum(CASE WHEN weights = 'uniform' THEN 1.0::DOUBLE ELSE coalesce(1 / nullif(distance, 0), 1e12) END) AS v FROM {near}, (VALUES {ks}) t(k), (VALUES ('uniform'), ('distance')) u(weights) WHERE place <= k GROUP BY ALL)) WHERE r = 1)"""


@query(f"SELECT query, k, weights, predicted FROM {_vote_sql(_near_sql(5, 'euclidean'), '(5)')} WHERE weights = 'uniform'")
def knn_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.vote(_near(spark, sf_dir, 5, "euclidean"), [5], ["uniform"])


_KS = [3, 5, 7, 11, 15, 21, 31]
_KS_SQL = ", ".join(f"({k})" for k in _KS)


@query(
    "SELECT metric, k, weights, round(avg(CAST(predicted = label AS INTEGER)), 6) AS accuracy FROM ("
    + " UNION ALL ".join(f"SELECT '{m}' AS metric, * FROM {_vote_sql(_near_sql(31, m), _KS_SQL)}" for m in ("euclidean", "manhattan"))
    + ") p JOIN embeddings e ON e.vec_id = p.query GROUP BY ALL"
)
def knn_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 28 candidates from one table of neighbours per metric."""
    found = None
    for m in ("euclidean", "manhattan"):
        part = S.vote(_near(spark, sf_dir, 31, m), _KS).withColumn("metric", F.lit(m))
        found = part if found is None else found.union(part)
    truth = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query"), "label")
    return found.join(truth, "query").groupBy("metric", "k", "weights").agg(F.round(F.avg((F.col("predicted") == F.col("label")).cast("double")), 6).alias("accuracy"))


@query("SELECT label, CAST(i - 1 AS INTEGER) AS position, round(avg(v), 6) AS average, round(max(v) - avg(v), 6) AS above, round(avg(v) - min(v), 6) AS below FROM (SELECT label, i, CAST(embedding[i] AS DOUBLE) AS v FROM embeddings, range(1, 22) t(i)) GROUP BY ALL")
def positional_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("label", F.slice(F.col("embedding").cast("array<double>"), 1, 21).alias("vec"))
    return S.profile(rows, "label", "vec").select("label", F.col("position").cast("int").alias("position"), *[F.round(c, 6).alias(c) for c in ("average", "above", "below")])


@query("SELECT a, b, round(sqrt(sum((x - y) * (x - y))), 6) AS distance FROM (SELECT p.label AS a, q.label AS b, p.m AS x, q.m AS y FROM (SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS m FROM embeddings, range(1, 65) t(i) GROUP BY ALL) p JOIN (SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS m FROM embeddings, range(1, 65) t(i) GROUP BY ALL) q ON p.i = q.i AND p.label < q.label) GROUP BY ALL")
def euclidean_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("label", F.col("embedding").cast("array<double>").alias("vec"))
    return S.centroid_distances(rows, "label", 64).withColumn("distance", F.round("distance", 6))


@query("SELECT vec_id, label AS index, CASE label WHEN 0 THEN 'class_a' WHEN 1 THEN 'class_b' WHEN 2 THEN 'class_c' ELSE 'class_' || CAST(label AS VARCHAR) END AS name FROM embeddings")
def class_names_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    mapping = spark.createDataFrame([(0, "class_a"), (1, "class_b"), (2, "class_c")], "index int, name string")
    return E.named_classes(table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").alias("index")), mapping).select("vec_id", "index", "name")


@query("SELECT CASE WHEN vec_id % 2 = 0 THEN 'rf' ELSE 'dummy' END AS model, count(*) AS n_predictions, count(DISTINCT label) AS n_unique FROM embeddings GROUP BY 1")
def prediction_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.summary(table(spark, sf_dir, "embeddings").select(F.when(F.col("vec_id") % 2 == 0, "rf").otherwise("dummy").alias("model"), F.col("label").alias("predicted")))


@query("SELECT sample_name, predicted, round(p, 6) AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY sample_name ORDER BY p DESC, predicted) AS r FROM (SELECT sample_name, predicted, round(s / sum(s) OVER (PARTITION BY sample_name), 9) AS p FROM (SELECT o_custkey AS sample_name, o_orderpriority AS predicted, sum(o_totalprice) AS s FROM orders GROUP BY ALL))) WHERE r = 1")
def confidence_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    sums = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("sample_name"), F.col("o_orderpriority").alias("label")).agg(F.sum("o_totalprice").alias("s"))
    shares = sums.withColumn("probability", F.round(F.col("s") / F.sum("s").over(Window.partitionBy("sample_name")), 9))
    return E.confidence(shares).withColumn("confidence", F.round("confidence", 6))


_SHAP = f"(SELECT vec_id, feature, (pos - 5) * 0.25::DOUBLE * (value - avg(value) OVER (PARTITION BY feature)) AS attribution FROM {_LONG})"


def _attributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = spark.createDataFrame([(n, (i - 5) * 0.25) for i, n in enumerate(_NAMES)], "feature string, weight double")
    return E.linear_attributions(long_dims(spark, sf_dir), weights)


@query(f"SELECT vec_id, feature, round(attribution, 6) AS attribution FROM {_SHAP}")
def linear_shap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _attributions(spark, sf_dir).select("vec_id", "feature", F.round("attribution", 6).alias("attribution"))


@query(f"SELECT feature, round(avg(abs(attribution)), 6) AS importance FROM {_SHAP} GROUP BY feature")
def mean_abs_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.mean_absolute(_attributions(spark, sf_dir)).withColumn("importance", F.round("importance", 6))


@query("SELECT column_name AS original, round(sum(importance), 6) AS importance FROM (SELECT 'p' || CAST(p_size % 3 AS VARCHAR) AS column_name, p_retailprice / 1000 AS importance FROM part) GROUP BY 1")
def importance_by_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select(F.concat(F.lit("p"), (F.col("p_size") % 3).cast("string")).alias("original"), (F.col("p_retailprice") / 1000).alias("importance"))
    return E.importance_by_column(rows).withColumn("importance", F.round("importance", 6))


@query("SELECT DISTINCT e.t AS feature, 'missing' AS kind FROM (SELECT p_type AS t FROM part WHERE p_size < 30) e WHERE e.t NOT IN (SELECT p_type FROM part WHERE p_size > 45) UNION ALL SELECT DISTINCT p_type, 'extra' FROM part WHERE p_size > 45 AND p_type NOT IN (SELECT p_type FROM part WHERE p_size < 30)")
def feature_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select(F.col("p_type").alias("feature"), "p_size")
    return E.feature_differences(part.filter("p_size < 30").select("feature").distinct(), part.filter("p_size > 45").select("feature").distinct())


_EVENT_TEXT = """'PROGRESS {"phase":"p' || event_type || '","phase_index":' || CAST(event_id % 5 + 1 AS VARCHAR) || ',"phase_total":5,"completed":' || CAST(CAST(json_extract(props, '$.k') AS INTEGER) AS VARCHAR) || ',"total":' || CAST(event_id % 60 AS VARCHAR) || ',"detail":"x"}'"""
_PROGRESS = "(SELECT event_id, 'p' || event_type AS phase, CAST(event_id % 5 + 1 AS INTEGER) AS phase_index, 5 AS phase_total, CAST(json_extract(props, '$.k') AS INTEGER) AS completed, CAST(event_id % 60 AS INTEGER) AS total FROM events WHERE event_id % 60 > 0 AND event_id % 13 > 0)"


def _progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    json = F.to_json(F.struct(F.concat(F.lit("p"), "event_type").alias("phase"), (F.col("event_id") % 5 + 1).cast("int").alias("phase_index"), F.lit(5).alias("phase_total"), k.cast("int").alias("completed"), (F.col("event_id") % 60).cast("int").alias("total"), F.lit("x").alias("detail")))
    line = F.when(F.col("event_id") % 13 == 0, F.lit("PROGRESS {broken")).otherwise(F.concat(F.lit("PROGRESS "), json))
    return P.parse(table(spark, sf_dir, "events").select("event_id", line.alias("line")), "line", "PROGRESS ")


@query(f"SELECT * FROM {_PROGRESS}")
def progress_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _progress(spark, sf_dir).select("event_id", "phase", "phase_index", "phase_total", "completed", "total")


@query(f"SELECT event_id, round(100 * (phase_index - 1 + least(1, completed / total)) / phase_total, 6) AS percent FROM {_PROGRESS}")
def progress_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.progress_fraction(_progress(spark, sf_dir)).select("event_id", F.round("percent", 6).alias("percent"))


@query("SELECT name, position, CAST(i - 1 AS INTEGER) AS place, round((i * 0.5 - 0.5)::DOUBLE, 4) AS distance, round(percent, 4) AS percent FROM (SELECT '01022023_' || chr(CAST(65 + n_nationkey AS INTEGER)) || '01' AS name, 'pos00' || CAST(n_regionkey + 1 AS VARCHAR) AS position, i, (n_nationkey * i) % 17 + 0.25::DOUBLE AS percent FROM nation, range(1, 6) t(i))")
def occupancy_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text blocks made of nations, then read by the parser."""
    n = F.col("n_nationkey")
    cells = lambda f: F.concat_ws("\t", F.transform(F.sequence(F.lit(1), F.lit(5)), f))
    comma = lambda c: F.replace(c.cast("string"), F.lit("."), F.lit(","))
    head = F.concat(F.lit("Image name:\tx y 01022023_s_Lm_st_L1_p_"), F.chr(65 + n), F.lit("01_pos00"), (F.col("n_regionkey") + 1).cast("string"), F.lit("_tm"))
    lines = F.array(head, F.concat(F.lit("Distance (um)\t\t"), cells(lambda i: comma((i * 0.5 - 0.5).cast("double")))), F.lit("noise"), F.concat(F.lit("Percent:\t\t"), cells(lambda i: comma(((n * i) % 17 + 0.25).cast("double")))))
    text = table(spark, sf_dir, "nation").select(F.lit("f").alias("file"), n.alias("k"), F.posexplode(lines).alias("i", "line")).select("file", (F.col("k") * 10 + F.col("i")).cast("long").alias("line_no"), "line")
    blocks = O.parse_blocks(text)
    return blocks.select("name", "position", F.posexplode(F.arrays_zip("distance", "percent")).alias("place", "p")).select("name", "position", F.col("place").cast("int").alias("place"), F.round("p.distance", 4).alias("distance"), F.round("p.percent", 4).alias("percent"))
