"""Queries over estimators: attributions of any model, information by neighbours, bootstrap intervals, quantiles of groups that are split."""

from __future__ import annotations

from pyspark.ml.feature import SQLTransformer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import bootstrap as B
from ..operators import features as A
from ..operators import information as I
from ..operators import kernel_explain as K
from ..operators import quantiles as Q
from . import tables as T
from .registry import ORACLES, query, table

_N = 64


@query(ORACLES["layer_stats10"])
def layer_stats10_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten statistics with no group held by a task."""
    stats = Q.split_statistics(T.measurements(spark, sf_dir))
    return stats.select("sample_name", "feature", *[F.round(s, T._digits(s)).alias(s) for s in A.STATISTICS])


_SMALL = "[" + ", ".join(repr(-I.EULER + sum(1.0 / k for k in range(1, m))) for m in range(1, 21)) + "]"
_PSI = f"CASE WHEN {{0}} <= 20 THEN {_SMALL}[{{0}}] ELSE ln({{0}}) - 0.5 / {{0}} - 1.0 / ({{0}} * {{0}}) * (1.0 / 12 - 1.0 / ({{0}} * {{0}}) * (1.0 / 120 - 1.0 / ({{0}} * {{0}}) / 252)) END"


@query(f"""WITH l AS (SELECT vec_id, label AS c, 'd' || CAST(i - 1 AS VARCHAR) AS feature, CAST(embedding[i] AS DOUBLE) AS v FROM embeddings, range(1, {_N + 1}) t(i)),
w AS (SELECT *, least(3, size - 1) AS k FROM (SELECT *, count(*) OVER (PARTITION BY feature, c) AS size FROM l) WHERE size > 1),
p AS (SELECT a.feature, a.vec_id, a.v, a.size, a.k, abs(a.v - b.v) AS d, b.v AS place, row_number() OVER (PARTITION BY a.feature, a.vec_id ORDER BY abs(a.v - b.v), b.v) AS n FROM w a JOIN w b ON a.feature = b.feature AND a.c = b.c AND a.vec_id <> b.vec_id),
e AS (SELECT *, CASE WHEN place < v THEN place ELSE v - d END AS low, CASE WHEN place > v THEN place ELSE v + d END AS high FROM p WHERE n = k),
m AS (SELECT e.feature, e.vec_id, e.size, e.k, CAST(greatest(1, count(*) FILTER (CASE WHEN e.d = 0 THEN x.v = e.v ELSE x.v > e.low AND x.v < e.high END)) AS DOUBLE) AS m FROM e JOIN w x ON x.feature = e.feature GROUP BY ALL),
z AS (SELECT feature, CAST(count(*) AS DOUBLE) AS n, avg({_PSI.format("k")}) AS pk, avg({_PSI.format("CAST(size AS DOUBLE)").replace("[CAST(size AS DOUBLE)]", "[size]")}) AS pc, avg({_PSI.format("m").replace("[m]", "[CAST(m AS BIGINT)]")}) AS pm FROM m GROUP BY feature)
SELECT feature, round(greatest(0, {_PSI.format("n").replace("[n]", "[CAST(n AS BIGINT)]")} + pk - pc - pm), 6) AS mi FROM z""")
def neighbour_information(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("i", "value"))
    long = cells.select("label", F.concat(F.lit("d"), F.col("i").cast("string")).alias("feature"), "value")
    return I.neighbour_information(long).select("feature", F.round("mi", 6).alias("mi"))


_REPLICATES = 100
_WEIGHT = " + ".join(f"CAST(u >= {s!r}::DOUBLE AS INTEGER)" for s in B.STEPS)


@query(f"""WITH r AS (SELECT o_orderpriority, o_totalprice AS v, CAST(CAST('0x' || substr(md5(CAST(o_orderkey AS VARCHAR) || ':' || CAST(b AS VARCHAR)), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296.0::DOUBLE AS u, b FROM orders, range(0, {_REPLICATES}) t(b)),
s AS (SELECT o_orderpriority, b, sum(w * v) / nullif(sum(w), 0) AS m, avg(v) AS mean, count(*) AS n FROM (SELECT *, {_WEIGHT} AS w FROM r) GROUP BY ALL)
SELECT o_orderpriority, round(max(mean), 4) AS mean, round(quantile_cont(m, 0.025), 4) AS low, round(quantile_cont(m, 0.975), 4) AS high, max(n) AS n FROM s GROUP BY 1""")
def bootstrap_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = B.bootstrap_means(table(spark, sf_dir, "orders"), ["o_orderpriority"], "o_totalprice", "o_orderkey", _REPLICATES)
    return found.select("o_orderpriority", *[F.round(c, 4).alias(c) for c in ("mean", "low", "high")], "n")


_WEIGHTS = [(-1) ** i * (i + 1) / 8 for i in range(8)]


@query(f"""WITH r AS (SELECT vec_id, i, w, CAST(embedding[i] AS DOUBLE) AS v FROM embeddings, (SELECT unnest(range(1, 9)) AS i, unnest({_WEIGHTS}::DOUBLE[]) AS w)),
g AS (SELECT i, avg(v) AS m FROM r WHERE vec_id IN (SELECT vec_id FROM embeddings ORDER BY vec_id LIMIT {K.MOST_BACKGROUND}) GROUP BY i)
SELECT vec_id, i - 1 AS feature, round(w * (v - m), 6) AS attribution FROM r JOIN g USING (i) WHERE vec_id IN (SELECT vec_id FROM embeddings ORDER BY vec_id LIMIT {K.MOST_ROWS})""")
def kernel_attributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A linear model explained as if nothing were known of it: the published numbers of explained and background rows."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.slice("embedding", 1, 8).cast("array<double>").alias("vec"))
    weights = "array(" + ", ".join(f"{w!r}D" for w in _WEIGHTS) + ")"
    model = SQLTransformer(statement=f"SELECT *, aggregate(zip_with(vec, {weights}, (a, b) -> a * b), 0D, (s, x) -> s + x) AS prediction FROM __THIS__")
    found = K.kernel_attributions(model, rows, rows, F.col("prediction"), "vec_id")
    return found.select("vec_id", F.posexplode("attributions").alias("feature", "a")).select("vec_id", F.col("feature").cast("long").alias("feature"), F.round("a", 6).alias("attribution"))
