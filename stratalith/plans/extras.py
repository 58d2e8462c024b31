"""Queries over predicates, memberships, pools and small reshapes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import names as N
from ..functions import numbers as X
from ..operators import features as A
from ..operators import folds as G
from ..operators import structure as S
from .registry import query, table
from .tables import _NEW_SAMPLE_SQL, _SAMPLE_SQL, _broken, _files, samples

_FEATURES = "(SELECT DISTINCT CASE p_partkey % 4 WHEN 0 THEN 'counts(inten<' || CAST(p_size AS VARCHAR) || ')' WHEN 1 THEN 'ThicknessThreshold=' || CAST(p_size AS VARCHAR) WHEN 2 THEN 'mean-' || p_brand ELSE 'max' END AS feature FROM part)"


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, size = F.col("p_partkey") % 4, F.col("p_size").cast("string")
    f = F.when(k == 0, F.concat(F.lit("counts(inten<"), size, F.lit(")"))).when(k == 1, F.concat(F.lit("ThicknessThreshold="), size)).when(k == 2, F.concat(F.lit("mean-"), "p_brand")).otherwise("max")
    return table(spark, sf_dir, "part").select(f.alias("feature")).distinct()


@query(f"SELECT feature FROM {_FEATURES} WHERE NOT contains(feature, 'counts')")
def exclude_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _features(spark, sf_dir).filter(~F.contains("feature", F.lit("counts")))


@query(f"SELECT feature, row_number() OVER (ORDER BY feature) - 1 AS position FROM {_FEATURES} WHERE contains(feature, 'Threshold')")
def threshold_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of the threshold-only configuration; few, so they are numbered in one window."""
    return _features(spark, sf_dir).filter(F.contains("feature", F.lit("Threshold"))).select("feature", (F.row_number().over(Window.orderBy("feature")) - 1).cast("long").alias("position"))


@query(f"SELECT feature, replace(replace(feature, '(', '-'), '<', '_lt_') AS disk_name, feature || '-SUMMARYCustomAlgos.tsv_q10.txt' AS full_name FROM {_FEATURES}")
def feature_file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = F.col("feature")
    return _features(spark, sf_dir).select(f, N.disk_name(f).alias("disk_name"), N.feature_name(f, F.lit("CustomAlgos"), F.lit("q10")).alias("full_name"))


@query(f"SELECT o_orderkey, s FROM {_SAMPLE_SQL} WHERE regexp_matches(s, '0[12]199[0-9]')")
def date_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples(spark, sf_dir).filter(F.rlike("sample_name", F.lit("0[12]199[0-9]"))).withColumnRenamed("sample_name", "s")


@query(f"WITH t AS (SELECT o_orderkey, array_to_string(string_split(s, '--')[1:5], '_') AS key FROM {_SAMPLE_SQL}) SELECT key, count(*) AS n FROM t WHERE key IN (SELECT key FROM t JOIN orders o USING (o_orderkey) WHERE o.o_orderstatus = 'P') GROUP BY key")
def valid_sample_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples whose first five tokens belong to a given group: a semi join."""
    keyed = samples(spark, sf_dir).select("o_orderkey", F.array_join(F.slice(F.split("sample_name", "--"), 1, 5), "_").alias("key"))
    given = keyed.join(table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").select("o_orderkey"), "o_orderkey", "left_semi").select("key").distinct()
    return keyed.join(given, "key", "left_semi").groupBy("key").agg(F.count("*").alias("n"))


@query(rf"SELECT o_orderkey, regexp_extract(s, 'st[-_]{{1,2}}([^-_]+)[-_]?', 1) AS pool, regexp_extract(s, '(\d{{8}}).+p[-_]{{1,2}}([^-_]+)[-_]?', 1) || '::' || regexp_extract(s, '(\d{{8}}).+p[-_]{{1,2}}([^-_]+)[-_]?', 2) AS sub_pool FROM {_NEW_SAMPLE_SQL}")
def pools(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _broken(_files(spark, sf_dir)).select("o_orderkey", N.sample_from_file(F.col("base")).alias("s"))
    return s.select("o_orderkey", N.pool(F.col("s")).alias("pool"), N.sub_pool(F.col("s")).alias("sub_pool"))


@query("SELECT c_custkey, CASE WHEN c_acctbal >= 0 THEN 1 ELSE 0 END AS trait, CASE c_nationkey % 3 WHEN 0 THEN 'yes' WHEN 1 THEN '0' ELSE 'TRUE ' END AS flag_text, c_nationkey % 3 IN (0, 2) AS flag FROM customer")
def traits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """+ and - as 1 and 0, and texts as booleans."""
    sign = F.when(F.col("c_acctbal") >= 0, "+").otherwise("-")
    text = F.when(F.col("c_nationkey") % 3 == 0, "yes").when(F.col("c_nationkey") % 3 == 1, "0").otherwise("TRUE ")
    rows = table(spark, sf_dir, "customer").select("c_custkey", sign.alias("sign"), text.alias("flag_text"))
    return rows.select("c_custkey", F.when(F.col("sign") == "+", 1).when(F.col("sign") == "-", 0).alias("trait"), "flag_text", N.truthy(F.col("flag_text")).alias("flag"))


@query("SELECT o.o_orderkey, CASE WHEN c.c_custkey % 4 = 0 THEN 'te' ELSE 'tr' END AS part FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey")
def given_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A split given per group: rows of groups without one are not used; an unknown group is looked for by an anti join."""
    split = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.when(F.col("c_custkey") % 4 == 0, "te").otherwise("tr").alias("part"))
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(split, "o_custkey").select("o_orderkey", "part")


@query("SELECT event_type, first_event FROM (SELECT event_type, min(event_id) AS first_event FROM events GROUP BY event_type)")
def distinct_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct values with the place of the first, which gives their order of appearance."""
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.min("event_id").alias("first_event"))


_LABELS = [f"l{i}" for i in range(10)]


@query("SELECT 'd' || CAST(i - 1 AS VARCHAR) AS feature, " + ", ".join(f"round(avg(CAST(embedding[i] AS DOUBLE)) FILTER (label = {i}), 6) AS l{i}" for i in range(10)) + " FROM embeddings, range(1, 65) t(i) GROUP BY i")
def transpose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups as columns, features as rows: what clustering of a few groups reads."""
    cells = table(spark, sf_dir, "embeddings").select("label", F.posexplode(F.col("embedding").cast("array<double>")).alias("i", "v"))
    long = cells.groupBy(F.concat(F.lit("d"), F.col("i").cast("string")).alias("sample_name"), F.concat(F.lit("l"), F.col("label").cast("string")).alias("feature")).agg(F.avg("v").alias("value"))
    return A.pivot(long, _LABELS).select(F.col("sample_name").alias("feature"), *[F.round(c, 6).alias(c) for c in _LABELS])


@query("SELECT CAST(l_linenumber AS INTEGER) AS top_n, round(avg(l_discount), 6) AS accuracy FROM lineitem GROUP BY 1 ORDER BY round(avg(l_discount), 6) DESC, 1 LIMIT 1")
def best_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    curve = table(spark, sf_dir, "lineitem").groupBy(F.col("l_linenumber").cast("int").alias("top_n")).agg(F.round(F.avg("l_discount"), 6).alias("accuracy"))
    return S.best_prefix(curve)


@query("SELECT c_mktsegment, string_agg(name, ',' ORDER BY name) AS names, max(n) AS n FROM (SELECT c_mktsegment, c_name AS name, count(*) OVER (PARTITION BY c_mktsegment) AS n, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_name) AS r FROM customer) WHERE r <= 10 GROUP BY 1")
def first_ten_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first ten names of each group and its size: the window keeps ten rows a group before anything is collected."""
    w = Window.partitionBy("c_mktsegment")
    rows = table(spark, sf_dir, "customer").select("c_mktsegment", "c_name")
    sizes = rows.groupBy("c_mktsegment").agg(F.count("*").alias("n"))
    first = rows.withColumn("r", F.row_number().over(w.orderBy("c_name"))).filter("r <= 10")
    return first.groupBy("c_mktsegment").agg(F.array_join(F.array_sort(F.collect_list("c_name")), ",").alias("names")).join(sizes, "c_mktsegment").select("c_mktsegment", "names", "n")


@query("SELECT o_orderkey, CAST(least(CASE WHEN v < 0 THEN 0 ELSE CAST(floor(v / ((max(v) OVER () + 1) / 18)) AS INTEGER) + 1 END, 19) AS INTEGER) AS bin FROM (SELECT o_orderkey, o_totalprice AS v FROM orders)")
def digitize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bins among evenly spaced edges up to the largest value, which one aggregate finds."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").alias("v"))
    top = rows.agg(F.max("v").alias("top"))
    return rows.join(F.broadcast(top), how="cross").select("o_orderkey", X.digitize(F.col("v"), F.col("top"), 20).alias("bin"))


@query("SELECT o_orderkey, t AS text, TRY_CAST(t AS DOUBLE) AS value FROM (SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN CAST(o_custkey AS VARCHAR) WHEN 1 THEN ' 2.5e3 ' WHEN 2 THEN 'x1' WHEN 3 THEN '' WHEN 4 THEN '.5' ELSE '-7.' END AS t FROM orders)")
def numeric_or_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey") % 6
    t = F.when(k == 0, F.col("o_custkey").cast("string")).when(k == 1, " 2.5e3 ").when(k == 2, "x1").when(k == 3, "").when(k == 4, ".5").otherwise("-7.")
    return table(spark, sf_dir, "orders").select("o_orderkey", t.alias("text")).withColumn("value", X.as_number(F.col("text")))


@query("SELECT vec_id, label FROM embeddings ORDER BY md5(CAST(vec_id AS VARCHAR)), vec_id LIMIT 100")
def explanation_background(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sampling operator of explanations: at most 100 rows."""
    return G.fixed_sample(table(spark, sf_dir, "embeddings").select("vec_id", "label"), "vec_id", 100)


@query(f"""WITH t AS (SELECT string_split(s, '--') AS t FROM {_SAMPLE_SQL}), k AS (SELECT t[5] AS label, t[1] AS date, t[1] || '::' || t[7] AS well, t[1] || '::' || t[7] || '::' || substr(t[8], 4) AS position FROM t),
u AS (SELECT 'date' AS unit, label, date AS g FROM k UNION ALL SELECT 'well', label, well FROM k UNION ALL SELECT 'position', label, position FROM k)
SELECT unit, (SELECT count(DISTINCT g) FROM u x WHERE x.unit = p.unit) AS groups, count(*) AS classes, min(n) AS fewest, CASE WHEN count(*) < 2 OR min(n) < 2 THEN 'unavailable' WHEN min(n) < 3 THEN 'limited' ELSE 'suitable' END AS status
FROM (SELECT unit, label, count(DISTINCT g) AS n FROM u GROUP BY ALL) p GROUP BY unit""")
def replication_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("sample_name")
    rows = samples(spark, sf_dir).withColumn("label", N.sample_field(s, "label"))
    return G.replication_report(rows, "label", {u: N.replication_group(s, u) for u in ("date", "well", "position")})
