"""Queries over layered images: embeddings as stacks of eight 8 x 8 layers, events as series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numbers as X
from ..operators import components as C
from ..operators import grid as G
from ..operators import stack_measures as K
from ..scratch import kept
from .registry import query, table

VOXEL = 0.13 * 0.13 * 0.5
_PIX = "(SELECT CAST(vec_id // 8 AS VARCHAR) AS sample_name, vec_id % 8 AS z, CAST((i - 1) // 8 AS BIGINT) AS x, CAST((i - 1) % 8 AS BIGINT) AS y, abs(CAST(embedding[i] AS DOUBLE)) AS v FROM embeddings, range(1, 65) t(i))"
_NORM = f"(SELECT * REPLACE (v / nullif(max(v) OVER (PARTITION BY sample_name, z), 0) AS v) FROM {_PIX})"
_THR = "(SELECT CAST(i AS INTEGER) AS i, 0.01::DOUBLE + i * 0.01::DOUBLE AS threshold FROM range(0, 29) t(i))"


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "v"))
    return rows.select(F.floor(F.col("vec_id") / 8).cast("string").alias("sample_name"), (F.col("vec_id") % 8).alias("z"), F.floor(F.col("i") / 8).alias("x"), (F.col("i") % 8).cast("long").alias("y"), F.abs(F.col("v").cast("double")).alias("v"))


def _round(df: DataFrame, digits: int, *keep: str) -> DataFrame:
    return df.select(*[c if c in keep else F.round(c, digits).alias(c) for c in df.columns])


@query(f"SELECT sample_name, z, round(avg(v), 6) AS mean, round(median(v), 6) AS med, round(max(v), 6) AS max, round(min(v), 6) AS min, round(max(v) - min(v), 6) AS diff, round(stddev_pop(v), 6) AS std, round(var_pop(v), 6) AS var FROM {_PIX} GROUP BY ALL")
def intensity_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(G.intensity(pixels(spark, sf_dir)), 6, *G.LAYER)


@query(f'SELECT sample_name, z, round(avg(CAST(v < m AS INTEGER)), 6) AS "minProp" FROM (SELECT *, avg(v) OVER (PARTITION BY sample_name, z) AS m FROM {_PIX}) GROUP BY ALL')
def emptiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(G.emptiness(pixels(spark, sf_dir)), 6, *G.LAYER)


@query(f'SELECT sample_name, z, round(median(n) * {VOXEL!r}, 6) AS "GPTVolume" FROM (SELECT sample_name, z, floor(v * 40) AS g, count(*) AS n FROM {_PIX} GROUP BY ALL) GROUP BY ALL')
def value_frequency_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(G.value_frequency(pixels(spark, sf_dir).withColumn("v", F.floor(F.col("v") * 40)), VOXEL), 6, *G.LAYER)


@query(f"SELECT sample_name, z, i, round(threshold, 6) AS threshold, count(*) FILTER (v > threshold) AS n FROM {_NORM}, {_THR} GROUP BY ALL")
def threshold_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.threshold_counts(G.normalised(pixels(spark, sf_dir))).withColumn("threshold", F.round("threshold", 6))


@query(f"SELECT sample_name, z, i, round(threshold, 6) AS threshold, count(*) FILTER (v > threshold) AS n FROM (SELECT * REPLACE ((v - avg(v) OVER w) / nullif(max(v) OVER w - min(v) OVER w, 0) AS v) FROM {_PIX} WINDOW w AS (PARTITION BY sample_name, z)), {_THR} GROUP BY ALL")
def centred_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.threshold_counts(G.centred(pixels(spark, sf_dir))).withColumn("threshold", F.round("threshold", 6))


@query(f"SELECT sample_name, z, feature, round(100 * value / nullif(sum(value) OVER (PARTITION BY sample_name, feature), 0), 6) AS share FROM (SELECT sample_name, z, 'mean' AS feature, avg(v) AS value FROM {_PIX} GROUP BY ALL UNION ALL SELECT sample_name, z, 'max', max(v) FROM {_PIX} GROUP BY ALL)")
def share_of_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = pixels(spark, sf_dir).groupBy(*G.LAYER).agg(F.avg("v").alias("mean"), F.max("v").alias("max")).unpivot(G.LAYER, ["mean", "max"], "feature", "value")
    return _round(G.share_of_total(long).select(*G.LAYER, "feature", "share"), 6, *G.LAYER, "feature")


@query(f"SELECT sample_name, i, round(count(*) FILTER (v > threshold) * {VOXEL!r} / 17956, 9) AS biovolume FROM {_NORM}, {_THR} GROUP BY ALL")
def biovolume(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(G.biovolume(G.threshold_counts(G.normalised(pixels(spark, sf_dir))), VOXEL), 9, "sample_name", "i")


@query(f"SELECT sample_name, round(100.0 * count(*) FILTER (v > 0.03::DOUBLE) / 64, 6) AS coverage FROM {_NORM} WHERE z = 0 GROUP BY ALL")
def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(G.coverage(G.threshold_counts(G.normalised(pixels(spark, sf_dir)), (0.01, 0.02, 0.03)), F.lit(64.0), 2), 6, "sample_name")


_THICK = f"""WITH t AS (SELECT * FROM {_THR}), c AS (SELECT sample_name, x, y, i, max(CASE WHEN z = 0 THEN v END) AS ground, max(z) + 1 AS layers, min(CASE WHEN z >= 1 AND v <= threshold THEN z END) AS stop, any_value(threshold) AS threshold FROM {_PIX}, t GROUP BY sample_name, x, y, i),
h AS (SELECT *, CAST(coalesce(stop, layers) AS DOUBLE) AS h, row_number() OVER (PARTITION BY sample_name, i ORDER BY x, y) AS n FROM c WHERE ground > threshold),
d AS (SELECT *, h - lag(h) OVER (PARTITION BY sample_name, i ORDER BY n) AS step FROM h),
keys AS (SELECT DISTINCT sample_name, i FROM c)"""


@query(_THICK + " SELECT k.sample_name, k.i, round(avg(d.h), 6) AS thickness FROM keys k LEFT JOIN d USING (sample_name, i) GROUP BY ALL")
def thickness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(G.thickness(pixels(spark, sf_dir)).select("sample_name", "i", "thickness"), 6, "sample_name", "i")


@query(_THICK + " SELECT k.sample_name, k.i, round(avg(d.step), 6) AS roughness FROM keys k LEFT JOIN d USING (sample_name, i) GROUP BY ALL")
def roughness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(G.thickness(pixels(spark, sf_dir)).select("sample_name", "i", "roughness"), 6, "sample_name", "i")


@query(f"SELECT sample_name, round(sqrt(var_pop(x) + var_pop(y)), 6) AS sxy, round(var_pop(z), 6) AS sz, round(sqrt(var_pop(x) + var_pop(y) + var_pop(z)), 6) AS sxyz FROM {_PIX} WHERE v > 0.1::DOUBLE GROUP BY ALL")
def spatial_spreading(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(G.spreading(pixels(spark, sf_dir).withColumn("v", F.when(F.col("v") > 0.1, F.col("v")).otherwise(0.0))), 6, "sample_name")


_BOX = f"(SELECT sample_name, z, k, count(*) FILTER (s > 0 AND s < k * k) AS boxes FROM (SELECT sample_name, z, k, x // k AS bx, y // k AS by, sum(CAST(v < m AS INTEGER)) AS s FROM (SELECT *, median(v) OVER (PARTITION BY sample_name, z) AS m FROM {_PIX}), (VALUES (8), (4), (2)) s(k) GROUP BY ALL) GROUP BY ALL)"


@query(f"SELECT sample_name, z, k, boxes FROM {_BOX}")
def box_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.box_counts(pixels(spark, sf_dir), [8, 4, 2])


@query(f'SELECT sample_name, z, round(CASE WHEN min(boxes) > 0 THEN -regr_slope(ln(CASE WHEN boxes > 0 THEN boxes END), ln(k)) END, 6) AS "GPTFractalDim" FROM {_BOX} GROUP BY ALL')
def fractal_slope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(G.fractal_dimension(G.box_counts(pixels(spark, sf_dir), [8, 4, 2])), 6, *G.LAYER)


@query(f"""WITH g AS (SELECT sample_name, z, x, y, CAST(floor(v * 20) AS BIGINT) AS v FROM {_PIX}), p AS (SELECT a.sample_name, a.z, a.v AS i, b.v AS j FROM g a JOIN g b ON a.sample_name = b.sample_name AND a.z = b.z AND a.x = b.x AND b.y = a.y + 1),
m AS (SELECT sample_name, z, i, j, count(*) AS n FROM (SELECT * FROM p UNION ALL SELECT sample_name, z, j, i FROM p) GROUP BY ALL),
q AS (SELECT sample_name, z, CAST(sum(n) AS DOUBLE) AS t, sum(n * (i - j) * (i - j)) AS contrast, sum(n * abs(i - j)) AS dissimilarity, sum(n / (1.0::DOUBLE + (i - j) * (i - j))) AS homogeneity, sum(n * n) AS asm, sum(n * i) / sum(n) AS mu, sum(n * i * i) / sum(n) AS ii, sum(n * i * j) / sum(n) AS ij FROM m GROUP BY ALL)
SELECT sample_name, z, round(contrast / t, 6) AS contrast, round(dissimilarity / t, 6) AS dissimilarity, round(homogeneity / t, 6) AS homogeneity, round(sqrt(asm / (t * t)), 6) AS energy,
 round(CASE WHEN ii - mu * mu > 1e-12 THEN (ij - mu * mu) / (ii - mu * mu) ELSE 1 END, 6) AS correlation, round(asm / (t * t), 6) AS asm FROM q""")
def glcm_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(G.cooccurrence(pixels(spark, sf_dir).withColumn("v", F.floor(F.col("v") * 20))), 6, *G.LAYER)


@query(f"""WITH b AS (SELECT sample_name, z, x, y, least(CAST(floor(v / ((max(v) OVER (PARTITION BY sample_name) + 1) / 14)) AS INTEGER) + 1, 15) AS b FROM {_PIX}),
s(dz, dx, dy) AS (VALUES (1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)),
p AS (SELECT a.sample_name, a.b AS i, o.b AS j FROM b a, s, b o WHERE o.sample_name = a.sample_name AND o.z = a.z + s.dz AND o.x = a.z + s.dx AND o.y = a.y + s.dy)
SELECT sample_name, round(avg(1.0::DOUBLE / (1 + (i - j) * (i - j))), 6) AS homogeneity FROM p GROUP BY ALL""")
def transition_homogeneity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(G.transition_homogeneity(pixels(spark, sf_dir), 16), 6, "sample_name")


_DAYS = "(SELECT user_id, CAST(strftime(ts, '%d') AS INTEGER) AS day, avg(value) AS mean FROM events GROUP BY ALL)"


def _days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("user_id", F.dayofmonth("ts").alias("day")).agg(F.avg("value").alias("mean"))


@query(f"SELECT user_id, round(avg(step), 6) AS mdiffs, round(max(step), 6) AS maxdiffs, round(min(step), 6) AS mindiffs FROM (SELECT user_id, mean - lag(mean) OVER (PARTITION BY user_id ORDER BY day) AS step FROM {_DAYS}) GROUP BY user_id")
def layer_diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(G.layer_differences(_days(spark, sf_dir), "user_id", "day", "mean"), 6, "user_id")


@query(f"SELECT user_id, round((arg_max(mean, day) - arg_min(mean, day)) / nullif(count(*) - 1, 0), 6) AS mdiffs FROM {_DAYS} GROUP BY user_id")
def mean_diff_telescoped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(G.mean_step(_days(spark, sf_dir), "user_id", "day", "mean"), 6, "user_id")


@query("SELECT l_linenumber AS z, count(*) AS n, round(sum(l_quantity), 2) AS total FROM lineitem WHERE l_linenumber % 2 = 0 GROUP BY 1")
def thin_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("z"), "l_quantity")
    return G.thin_layers(rows).groupBy("z").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("total"))


def layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each embedding is a layer: no pixel leaves its row."""
    side = F.lit(8).cast("long")
    return table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 8).cast("string").alias("sample_name"), (F.col("vec_id") % 8).alias("z"), side.alias("layers"), side.alias("height"), side.alias("width"), F.transform("embedding", lambda v: F.abs(v.cast("double"))).alias("pixels"))


# an 8 x 8 image is 64 bits; one step of a flood: a bit's neighbours to the left and right, then those above and below
_LEFT, _RIGHT = "'" + "01111111" * 8 + "'::BIT", "'" + "11111110" * 8 + "'::BIT"
_WIDE = f"(fill | ((fill & {_LEFT}) << 1) | ((fill & {_RIGHT}) >> 1))"
_GROWN = f"(({_WIDE} | ({_WIDE} << 8) | ({_WIDE} >> 8)) & mask)"
_NONE = "'" + "0" * 64 + "'::BIT"


def _components(image: str) -> str:
    """SQL for components by flooding: the first pixel left is flooded until nothing is added, then taken off and counted."""
    return f"""WITH RECURSIVE t AS (SELECT * FROM {_THR}),
m AS (SELECT sample_name, z, i, CAST(string_agg(CASE WHEN v IS NULL THEN '1' WHEN v > threshold THEN '1' ELSE '0' END, '' ORDER BY x, y) AS BIT) AS mask FROM {image}, t GROUP BY sample_name, z, i),
f(sample_name, z, i, mask, fill, n) AS (
  SELECT sample_name, z, i, mask, {_NONE}, 0 FROM m
  UNION ALL
  SELECT sample_name, z, i, CASE WHEN fill <> {_NONE} AND {_GROWN} = fill THEN xor(mask, fill) ELSE mask END,
         CASE WHEN fill = {_NONE} THEN set_bit({_NONE}, bit_position('1'::BIT, mask) - 1, 1) WHEN {_GROWN} = fill THEN {_NONE} ELSE {_GROWN} END,
         CASE WHEN fill = {_NONE} THEN n + 1 ELSE n END
  FROM f WHERE mask <> {_NONE}
)
SELECT sample_name, z, i, CAST(max(n) AS BIGINT) AS components FROM f GROUP BY ALL"""


_CENTRE = f"(SELECT * REPLACE (v / nullif(max(v) OVER (PARTITION BY sample_name, z), 0) AS v) FROM (SELECT * REPLACE ((v - avg(v) OVER w) / nullif(max(v) OVER w - min(v) OVER w, 0) AS v) FROM {_PIX} WINDOW w AS (PARTITION BY sample_name, z)))"


@query(_components(_NORM))
def components_udf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components per layer and threshold."""
    return C.layer_components(layers(spark, sf_dir))


@query(_components(_CENTRE))
def components_centred(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of centred layers per threshold."""
    return C.layer_components(layers(spark, sf_dir), centred=True)


@query("SELECT o_orderkey, round(0.2989 * r + 0.5870 * g + 0.1140 * b, 6) AS luma FROM (SELECT o_orderkey, CAST(o_orderkey % 256 AS DOUBLE) AS r, CAST(o_custkey % 256 AS DOUBLE) AS g, CAST((o_orderkey + o_custkey) % 256 AS DOUBLE) AS b FROM orders)")
def luma(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.round(X.luma((k % 256).cast("double"), (c % 256).cast("double"), ((k + c) % 256).cast("double")), 6).alias("luma"))


_NORM_THICK = _THICK.replace(_PIX, _NORM).removeprefix("WITH ")
_STACK = f"""{_components(_NORM).replace("SELECT sample_name, z, i, CAST(max(n) AS BIGINT) AS components FROM f GROUP BY ALL", "")},
cc AS (SELECT sample_name, max(n) AS n FROM f WHERE z = 0 AND i = 2 GROUP BY ALL),
{_NORM_THICK.removeprefix(f"t AS (SELECT * FROM {_THR}), ")},
g AS (SELECT sample_name, z, x, y, CAST(floor(v) AS BIGINT) AS v FROM {_NORM}),
p AS (SELECT a.sample_name, a.z, a.v AS i, b.v AS j FROM g a JOIN g b ON a.sample_name = b.sample_name AND a.z = b.z AND a.x = b.x AND b.y = a.y + 1),
q AS (SELECT sample_name, z, i, j, count(*) AS n FROM (SELECT * FROM p UNION ALL SELECT sample_name, z, j, i FROM p) GROUP BY ALL),
w AS (SELECT sample_name, z, CAST(sum(n) AS DOUBLE) AS t, sum(n * (i - j) * (i - j)) AS c, sum(n * abs(i - j)) AS dis, sum(n / (1.0::DOUBLE + (i - j) * (i - j))) AS hom, sum(n * n) AS asm, sum(n * i) / sum(n) AS mu, sum(n * i * i) / sum(n) AS ii, sum(n * i * j) / sum(n) AS ij FROM q GROUP BY ALL),
x AS (SELECT sample_name, avg(c / t) AS "GPTContrast", avg(dis / t) AS "GPTDissimilarity", avg(hom / t) AS "GPTHomogeneity", avg(sqrt(asm / (t * t))) AS "GPTEnergy", avg(CASE WHEN ii - mu * mu > 1e-12 THEN (ij - mu * mu) / (ii - mu * mu) ELSE 1 END) AS "GPTCorrelation", avg(asm / (t * t)) AS "GPTASM" FROM w GROUP BY ALL),
b AS (SELECT sample_name, z, x, y, least(CAST(floor(v / ((max(v) OVER (PARTITION BY sample_name) + 1) / 254)) AS INTEGER) + 1, 255) AS b FROM {_PIX}),
s(dz, dx, dy) AS (VALUES (1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)),
tr AS (SELECT a.sample_name, a.b AS i, o.b AS j FROM b a, s, b o WHERE o.sample_name = a.sample_name AND o.z = a.z + s.dz AND o.x = a.z + s.dx AND o.y = a.y + s.dy),
la AS (SELECT sample_name, z, avg(v) AS mean FROM {_PIX} GROUP BY ALL),
st AS (SELECT *, mean - lag(mean) OVER (PARTITION BY sample_name ORDER BY z) AS step FROM la),
gl AS (SELECT sample_name, avg(mean) AS "globalMean", avg(step) AS mdiffs, max(step) AS maxdiffs, min(step) AS mindiffs, 1.0::DOUBLE AS eigen FROM st GROUP BY ALL HAVING count(*) > 1),
sp AS (SELECT sample_name, sqrt(var_pop(x) + var_pop(y)) AS "SpreadingHorizontal", var_pop(z) AS "SpreadingVertical", sqrt(var_pop(x) + var_pop(y) + var_pop(z)) AS "SpreadingTotal" FROM {_PIX} WHERE v > 0 GROUP BY ALL),
th AS (SELECT k.sample_name, k.i, avg(d.h) AS thickness, avg(d.step) AS roughness FROM keys k LEFT JOIN d USING (sample_name, i) GROUP BY ALL),
u AS (
  SELECT sample_name, 'SubstratumRelativeCoverage' AS feature, 100.0::DOUBLE * n / 64 AS value FROM cc
  UNION ALL SELECT sample_name, 'Homogenity', avg(1.0::DOUBLE / (1 + (i - j) * (i - j))) FROM tr GROUP BY ALL
  UNION ALL SELECT sample_name, 'ThicknessThreshold=' || CAST(threshold AS VARCHAR), thickness FROM th JOIN t USING (i)
  UNION ALL SELECT sample_name, 'RoughnessThreshold=' || CAST(threshold AS VARCHAR), roughness FROM th JOIN t USING (i)
  UNION ALL FROM (UNPIVOT x ON COLUMNS(* EXCLUDE (sample_name)) INTO NAME feature VALUE value)
  UNION ALL FROM (UNPIVOT sp ON COLUMNS(* EXCLUDE (sample_name)) INTO NAME feature VALUE value)
  UNION ALL FROM (UNPIVOT gl ON COLUMNS(* EXCLUDE (sample_name)) INTO NAME feature VALUE value)
)
SELECT sample_name, feature, round(value, 6) AS value FROM u"""


@query(_STACK)
def stack_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is one for a stack, and its global measures, from one pass over layers."""
    images = layers(spark, sf_dir)
    measured = kept(K.measure(images, VOXEL), "measured")
    tops = K.open_stacks(measured)
    rows = K.stack_rows(measured, None if tops.isEmpty() else K.transitions(images, tops)).unionByName(K.global_rows(measured))
    return rows.select("sample_name", "feature", F.round("value", 6).alias("value"))
