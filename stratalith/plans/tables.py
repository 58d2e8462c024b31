"""Queries over feature tables, names and quality."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names as N
from ..functions import numbers as X
from ..operators import features as A
from ..operators import quality as Q
from .registry import query, table

MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_LONG_SQL = "(SELECT CAST(l_orderkey % 200 AS VARCHAR) AS sample_name, feature, value FROM (UNPIVOT (SELECT l_orderkey, l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem) ON l_quantity, l_extendedprice, l_discount, l_tax INTO NAME feature VALUE value))"
_STATS_SQL = "median(value) AS median, min(value) AS min, max(value) AS max, avg(value) AS mean, quantile_cont(value, 0.1) AS q10, quantile_cont(value, 0.25) AS q25, quantile_cont(value, 0.75) AS q75, quantile_cont(value, 0.9) AS q90, stddev_samp(value) AS std, var_samp(value) AS var"
_ROUNDED = ", ".join(f"round({s}, {2 if s in ('var', 'std', 'mean') else 4}) AS {s}" for s in A.STATISTICS)


def measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as measurements of 200 samples."""
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 200).cast("string").alias("sample_name"), *MEASURES)
    return A.melt(rows, ["sample_name"])


def _digits(statistic: str) -> int:
    return 2 if statistic in ("var", "std", "mean") else 4


@query(f"SELECT sample_name, feature, {_ROUNDED} FROM (SELECT sample_name, feature, {_STATS_SQL} FROM {_LONG_SQL} GROUP BY ALL)")
def layer_stats10(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = A.ten_statistics(measurements(spark, sf_dir))
    return stats.select("sample_name", "feature", *[F.round(s, _digits(s)).alias(s) for s in A.STATISTICS])


_CELLS = [f"{m}-{s}" for m in MEASURES for s in A.STATISTICS]


@query(
    f"SELECT 'L' || CAST(CAST(sample_name AS INTEGER) % 8 AS VARCHAR) AS label, sample_name, "
    + ", ".join(f"round(max({s}) FILTER (feature = '{m}'), {2 if s in ('var', 'std', 'mean') else 4}) AS \"{m}_{s}\"" for m in MEASURES for s in A.STATISTICS)
    + f" FROM (SELECT sample_name, feature, {_STATS_SQL} FROM {_LONG_SQL} GROUP BY ALL) GROUP BY sample_name HAVING 1.0 * sum(CASE WHEN std IS NULL THEN 2 ELSE 0 END) / 41 < 0.8"
)
def feature_table_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scan, melt, ten statistics, melt, null filter, pivot, label: the flagship."""
    rows = A.statistic_rows(A.ten_statistics(measurements(spark, sf_dir)))
    wide = A.pivot(A.keep_measured(rows, len(_CELLS)), _CELLS)
    label = F.concat(F.lit("L"), (F.col("sample_name").cast("int") % 8).cast("string"))
    return wide.select(label.alias("label"), "sample_name", *[F.round(F.col(f"`{c}`"), _digits(c.split("-")[1])).alias(c.replace("-", "_")) for c in _CELLS])


@query(f"""
WITH m AS (SELECT l_orderkey % 500 AS s, l_linenumber, l_quantity, l_tax FROM lineitem),
cells AS (SELECT CAST(s AS VARCHAR) AS sample_name, 'f' || CAST(l_linenumber AS VARCHAR) AS feature, CASE WHEN (s + l_linenumber) % 7 < s % 8 THEN NULL ELSE round(sum(l_quantity), 4) END AS value FROM m GROUP BY s, l_linenumber)
SELECT sample_name, feature, value FROM (SELECT *, (count(*) FILTER (value IS NULL) OVER (PARTITION BY sample_name) + 7 - count(*) OVER (PARTITION BY sample_name)) / 8.0 AS gone FROM cells) WHERE gone < 0.8
""")
def null_fraction_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").groupBy((F.col("l_orderkey") % 500).alias("s"), "l_linenumber").agg(F.round(F.sum("l_quantity"), 4).alias("v"))
    cells = rows.select(F.col("s").cast("string").alias("sample_name"), F.concat(F.lit("f"), F.col("l_linenumber").cast("string")).alias("feature"), F.when((F.col("s") + F.col("l_linenumber")) % 7 >= F.col("s") % 8, F.col("v")).alias("value"))
    return A.keep_measured(cells, 7)


@query("SELECT feature, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT CASE WHEN event_id % 5 = 0 THEN 'Unnamed: 0' WHEN event_id % 5 = 1 THEN 'Unnamed: 0-index' ELSE event_type END AS feature, value FROM events) WHERE feature NOT LIKE 'Unnamed:%' GROUP BY feature")
def artifact_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id") % 5
    long = table(spark, sf_dir, "events").select(F.when(k == 0, "Unnamed: 0").when(k == 1, "Unnamed: 0-index").otherwise(F.col("event_type")).alias("feature"), "value")
    return A.drop_artifact_rows(long).groupBy("feature").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


_INJECT_SQL = "(SELECT event_id, event_type AS feature, CASE WHEN event_id % 11 = 0 THEN 'nan'::DOUBLE WHEN event_id % 13 = 0 THEN 'inf'::DOUBLE WHEN event_id % 17 = 0 THEN '-inf'::DOUBLE WHEN event_id % 19 = 0 THEN NULL ELSE value END AS v FROM events)"


def _injected(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    v = F.when(e % 11 == 0, float("nan")).when(e % 13 == 0, X.INF).when(e % 17 == 0, -X.INF).when(e % 19 == 0, F.lit(None)).otherwise(F.col("value"))
    return table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("feature"), v.alias("v"))


@query(f"""SELECT event_id, feature, round(CASE WHEN v IS NULL OR isnan(v) OR v = '-inf'::DOUBLE OR top IS NULL THEN -666.0 WHEN v = 'inf'::DOUBLE THEN top + 3.14 ELSE v END, 6) AS value
FROM (SELECT *, max(CASE WHEN isfinite(v) THEN v END) OVER (PARTITION BY feature) AS top FROM {_INJECT_SQL})""")
def impute_sentinels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _injected(spark, sf_dir).select("event_id", "feature", F.round(X.impute(F.col("v"), "feature"), 6).alias("value"))


@query(f"""SELECT event_id, feature, CASE WHEN v = '-inf'::DOUBLE THEN -1e300 ELSE round(CASE WHEN v IS NULL OR isnan(v) THEN -666.0 WHEN v = 'inf'::DOUBLE THEN top + 3.14 ELSE v END, 6) END AS value
FROM (SELECT *, max(CASE WHEN NOT isnan(v) AND v <> 'inf'::DOUBLE THEN v END) OVER (PARTITION BY feature) AS top FROM {_INJECT_SQL})""")
def impute_legacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = X.impute_legacy(F.col("v"), "feature")
    return _injected(spark, sf_dir).select("event_id", "feature", F.when(v == -X.INF, F.lit(-1e300)).otherwise(F.round(v, 6)).alias("value"))


@query(f"SELECT event_id, CASE WHEN v IS NULL OR isnan(v) THEN -666.0 WHEN v = 'inf'::DOUBLE THEN 1000.0 WHEN v = '-inf'::DOUBLE THEN -1000.0 ELSE v END AS value FROM {_INJECT_SQL}")
def final_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _injected(spark, sf_dir).select("event_id", X.last_resort(F.col("v")).alias("value"))


@query("""
WITH u AS (SELECT 'a' AS namespace, l_orderkey AS id, l_quantity AS col1, CAST(NULL AS DOUBLE) AS col2, l_linenumber AS line, l_partkey AS part, l_suppkey AS supp FROM lineitem UNION ALL SELECT 'b', o_orderkey, NULL, o_totalprice, 0, 0, 0 FROM orders)
SELECT namespace, id % 10 AS bucket, count(*) AS n, round(sum(col1), 2) AS sum1, round(sum(col2), 2) AS sum2
FROM (SELECT *, row_number() OVER (PARTITION BY namespace, id % 10 ORDER BY id, line, part, supp, col1) AS rn FROM u) WHERE rn <= 100 GROUP BY ALL
""")
def union_ragged(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "lineitem").select(F.lit("a").alias("namespace"), F.col("l_orderkey").alias("id"), F.col("l_quantity").alias("col1"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp"))
    b = table(spark, sf_dir, "orders").select(F.lit("b").alias("namespace"), F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("col2"))
    both = A.union_ragged(a, b).withColumn("bucket", F.col("id") % 10)
    first = A.first_rows(both, ["namespace", "bucket"], ["id", "line", "part", "supp", "col1"], 100)
    return first.groupBy("namespace", "bucket").agg(F.count("*").alias("n"), F.round(F.sum("col1"), 2).alias("sum1"), F.round(F.sum("col2"), 2).alias("sum2"))


# sample names made of orders, customers and nations: date, label = segment, well, position
_FILE_SQL = """(SELECT o.o_orderkey, strftime(o.o_orderdate, '%d%m%Y') || '_s_Lm_st_' || c.c_mktsegment || '_p_' || chr(CAST(65 + n.n_nationkey % 8 AS INTEGER)) || lpad(CAST(c.c_custkey % 12 AS VARCHAR), 2, '0')
 || '_pos' || lpad(CAST(o.o_orderkey % 5 + 1 AS VARCHAR), 3, '0') || '_tm_24_ch_Syto9_z_21' AS base FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey)"""
_BROKEN_SQL = "CASE WHEN o_orderkey % 7 = 0 THEN replace(base, '_s_', '_x_') WHEN o_orderkey % 7 = 1 THEN replace(base, '_pos', '_spot') ELSE base END"


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c, n = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    well = F.concat(F.chr(65 + F.col("n_nationkey") % 8), F.lpad((F.col("c_custkey") % 12).cast("string"), 2, "0"))
    base = F.concat(F.date_format("o_orderdate", "ddMMyyyy"), F.lit("_s_Lm_st_"), F.col("c_mktsegment"), F.lit("_p_"), well, F.lit("_pos"), F.lpad((F.col("o_orderkey") % 5 + 1).cast("string"), 3, "0"), F.lit("_tm_24_ch_Syto9_z_21"))
    return o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).select("o_orderkey", base.alias("base"))


def _broken(files: DataFrame) -> DataFrame:
    k = F.col("o_orderkey") % 7
    return files.select("o_orderkey", F.when(k == 0, F.replace("base", F.lit("_s_"), F.lit("_x_"))).when(k == 1, F.replace("base", F.lit("_pos"), F.lit("_spot"))).otherwise(F.col("base")).alias("base"))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _files(spark, sf_dir).select("o_orderkey", N.sample_from_file(F.col("base")).alias("sample_name"))


@query(f"SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'CustomAlgos' WHEN o_orderkey % 3 = 1 THEN 'DiffGlobal' END AS namespace, replace(base, '_', '--') AS sample_name FROM {_FILE_SQL}")
def sample_name_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey") % 3
    path = F.concat(F.lit("/data/DiffGlobal_run/"), "base", F.when(k == 0, "CustomAlgos").when(k == 1, "DiffGlobal").otherwise(""), F.lit(".txt"))
    return _files(spark, sf_dir).withColumn("path", path).select("o_orderkey", N.namespace_of(F.col("path")).alias("namespace"), N.sample_from_file(F.substring_index("path", "/", -1)).alias("sample_name"))


_SAMPLE_SQL = f"(SELECT o_orderkey, replace(base, '_', '--') AS s FROM {_FILE_SQL})"
_NEW_SAMPLE_SQL = f"(SELECT o_orderkey, replace({_BROKEN_SQL}, '_', '--') AS s FROM {_FILE_SQL})"


@query(f"""SELECT o_orderkey, t[1] AS date, t[5] AS label, CASE WHEN o_orderkey % 7 = 1 THEN t[7] ELSE t[7] END AS well,
 CASE WHEN o_orderkey % 7 = 1 THEN regexp_replace(t[8], '^pos', '') ELSE regexp_extract(t[8], '^pos(.*)$', 1) END AS position, list_aggregate([x FOR x IN t IF NOT contains(x, 'pos')], 'string_agg', '--') AS no_pos,
 substr(s, 1, 8) || '::' || regexp_extract(s, 'st--([^-_]+)-', 1) AS date_strain, regexp_extract(s, 'st[-_]{{1,2}}([^-_]+)[-_]?', 1) AS pool FROM (SELECT *, string_split(s, '--') AS t FROM {_NEW_SAMPLE_SQL})""")
def sample_name_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _broken(_files(spark, sf_dir)).select("o_orderkey", N.sample_from_file(F.col("base")).alias("s"))
    c = F.col("s")
    fields = s.withColumn("fields", N.sample_fields(c))
    return fields.select("o_orderkey", *[F.get("fields", F.lit(N.NAME_FIELDS.index(f))).alias(f) for f in ("date", "label", "well", "position")], N.without_position(c).alias("no_pos"), N.date_and_strain(c).alias("date_strain"), N.pool(c).alias("pool"))


@query(f"SELECT t[1] AS date, t[1] || '::' || t[7] AS well, t[1] || '::' || t[7] || '::' || substr(t[8], 4) AS position, count(*) AS n FROM (SELECT string_split(s, '--') AS t FROM {_SAMPLE_SQL}) GROUP BY ALL")
def replication_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("sample_name")
    return samples(spark, sf_dir).select(*[N.replication_group(c, u).alias(u) for u in ("date", "well", "position")]).groupBy("date", "well", "position").agg(F.count("*").alias("n"))


@query(f"SELECT t[5] AS label, count(DISTINCT t[1]) AS dates, count(DISTINCT t[1] || '::' || t[7]) AS wells, count(DISTINCT t[1] || '::' || t[7] || '::' || t[8]) AS positions, count(*) AS n FROM (SELECT string_split(s, '--') AS t FROM {_SAMPLE_SQL}) GROUP BY 1")
def group_counts_per_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("sample_name")
    rows = samples(spark, sf_dir).select(N.sample_field(c, "label").alias("label"), *[N.replication_group(c, u).alias(u) for u in ("date", "well", "position")])
    return rows.groupBy("label").agg(F.countDistinct("date").alias("dates"), F.countDistinct("well").alias("wells"), F.countDistinct("position").alias("positions"), F.count("*").alias("n"))


@query(f"""WITH f AS (SELECT {_BROKEN_SQL} AS b, o_orderkey % 7 NOT IN (0, 1) AS ok FROM {_FILE_SQL})
SELECT CASE WHEN ok THEN substr(b, 5, 4) END AS year, CASE WHEN ok THEN string_split(b, '_')[5] END AS label, ok, count(*) AS n, CASE WHEN NOT ok THEN list_aggregate(list_sort(list(b))[1:3], 'string_agg', ',') END AS first_invalid FROM f GROUP BY 1, 2, 3""")
def image_name_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.image_names(_broken(_files(spark, sf_dir)).select(F.concat("base", F.lit(".tif")).alias("file")), "file", show=3)


_TEXT_CELLS_SQL = "(SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN '' WHEN o_orderkey % 9 = 1 THEN 'not-a-number' WHEN o_orderkey % 9 = 2 THEN 'inf' WHEN o_orderkey % 9 = 3 THEN '-inf' ELSE CAST(CAST(o_totalprice AS BIGINT) AS VARCHAR) END AS price, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE CAST(o_custkey AS VARCHAR) END AS cust FROM orders)"


@query(f"""SELECT feature, count(*) FILTER (value IS NULL OR trim(value) = '') AS empty_cells, count(*) FILTER (isinf(TRY_CAST(value AS DOUBLE))) AS infinite_cells, count(*) FILTER (trim(value) <> '' AND TRY_CAST(value AS DOUBLE) IS NULL) AS bad_cells
FROM (SELECT 'price' AS feature, price AS value FROM {_TEXT_CELLS_SQL} UNION ALL SELECT 'cust', cust FROM {_TEXT_CELLS_SQL}) GROUP BY feature""")
def table_quality_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey") % 9
    price = F.when(k == 0, "").when(k == 1, "not-a-number").when(k == 2, "inf").when(k == 3, "-inf").otherwise(F.col("o_totalprice").try_cast("decimal(20,0)").cast("string"))
    rows = table(spark, sf_dir, "orders").select(price.alias("price"), F.when(F.col("o_orderkey") % 4 != 0, F.col("o_custkey").cast("string")).alias("cust"))
    return Q.cell_report(rows, ["price", "cust"])


@query("SELECT CAST(coalesce(sum(n) FILTER (n > 1), 0) AS BIGINT) AS duplicate_rows, CAST(coalesce(sum(n) FILTER (lower(trim(coalesce(o_orderpriority, ''))) IN ('', 'unknown', 'missing', 'unlabelled', 'unlabeled')), 0) AS BIGINT) AS unlabelled_rows FROM (SELECT o_custkey, o_orderdate, CASE WHEN o_orderkey % 10 = 0 THEN ' Missing' ELSE o_orderpriority END AS o_orderpriority, count(*) AS n FROM orders GROUP BY ALL) WHERE TRUE AND (SELECT TRUE)")
def duplicate_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", F.when(F.col("o_orderkey") % 10 == 0, " Missing").otherwise(F.col("o_orderpriority")).alias("label"))
    return Q.duplicates(rows, ["o_custkey", "o_orderdate", "label"], "label")


_FAMILY_SQL = " OR ".join(f"starts_with(f, '{p}')" for p in N.FEATURE_PREFIXES)


@query(f"SELECT f AS feature, ({_FAMILY_SQL}) AS generated FROM (SELECT DISTINCT CASE p_partkey % 6 WHEN 0 THEN 'counts(inten<' || CAST(p_size AS VARCHAR) WHEN 1 THEN 'GPT' || p_brand WHEN 2 THEN 'RoughnessThreshold=' || CAST(p_size AS VARCHAR) WHEN 3 THEN 'external_' || p_brand WHEN 4 THEN 'mean' ELSE p_type END AS f FROM part)")
def feature_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, size = F.col("p_partkey") % 6, F.col("p_size").cast("string")
    f = F.when(k == 0, F.concat(F.lit("counts(inten<"), size)).when(k == 1, F.concat(F.lit("GPT"), "p_brand")).when(k == 2, F.concat(F.lit("RoughnessThreshold="), size)).when(k == 3, F.concat(F.lit("external_"), "p_brand")).when(k == 4, "mean").otherwise(F.col("p_type"))
    return table(spark, sf_dir, "part").select(f.alias("feature")).distinct().select("feature", N.is_generated_feature(F.col("feature")).alias("generated"))


@query("SELECT o_orderkey, o_orderpriority, CAST(dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS INTEGER) AS code FROM orders")
def label_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.label_codes(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority").select("o_orderkey", "o_orderpriority", "code")


@query("SELECT o_orderkey, CAST(o_orderstatus = 'F' AS INTEGER) AS \"o_orderstatus_F\", CAST(o_orderstatus = 'O' AS INTEGER) AS \"o_orderstatus_O\", CAST(o_orderstatus = 'P' AS INTEGER) AS \"o_orderstatus_P\" FROM orders")
def one_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.one_hot(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus", ["F", "O", "P"])


@query("SELECT n_nationkey, CAST(r = 0 AS INTEGER) AS r_0, CAST(r = 1 AS INTEGER) AS r_1, CAST(r = 2 AS INTEGER) AS r_2, CAST(r = 3 AS INTEGER) AS r_3, CAST(r = 4 AS INTEGER) AS r_4 FROM (SELECT n_nationkey, n_regionkey AS r FROM nation)")
def one_hot_cardinality_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "nation").select("n_nationkey", F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("id"), F.col("n_regionkey").cast("string").alias("r"))
    return A.one_hot_where_useful(rows, ["id", "r"])


@query("SELECT doc_id, quality, CAST(k AS INTEGER) AS copy FROM labels, range(1, 6) t(k)")
def upsample_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.replicate(table(spark, sf_dir, "labels").select("doc_id", "quality"), 5)


_EXPECTED = ["d0", "d3", "d7", "absent"]


@query("""WITH e(feature, position) AS (VALUES ('d0', 0), ('d3', 1), ('d7', 2), ('absent', 3)), m AS (SELECT CAST(vec_id AS VARCHAR) AS sample_name, 'd' || CAST(i - 1 AS VARCHAR) AS feature, CAST(embedding[i] AS DOUBLE) AS value FROM embeddings, range(1, 9) t(i))
SELECT s.sample_name, e.feature, e.position, round(coalesce(m.value, 0), 6) AS value FROM (SELECT DISTINCT sample_name FROM m) s CROSS JOIN e LEFT JOIN m ON m.sample_name = s.sample_name AND m.feature = e.feature""")
def align_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("sample_name"), F.posexplode(F.slice("embedding", 1, 8)).alias("i", "v")).select("sample_name", F.concat(F.lit("d"), F.col("i").cast("string")).alias("feature"), F.col("v").cast("double").alias("value"))
    expected = spark.createDataFrame([(f, i) for i, f in enumerate(_EXPECTED)], "feature string, position int")
    return A.align(long, expected).withColumn("value", F.round("value", 6))
