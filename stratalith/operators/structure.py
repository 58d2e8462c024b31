"""Relations between features and samples: correlation and its clusters, rankings, boxes, neighbours, information."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import ROUND_HALF_UP, Context, Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import numbers as X
from ..shipping import ship
from .gramian import block_correlations

_DIGITS = Context(prec=400)


def ranked(scores: DataFrame, score: str = "score", feature: str = "feature") -> DataFrame:
    """`place` from 1 by falling score, then name."""
    return scores.withColumn("place", F.row_number().over(Window.orderBy(F.desc(score), feature)))


def top_features(scores: DataFrame, n: int, score: str = "score", feature: str = "feature") -> DataFrame:
    """The first n by falling score, then name: one ordered limit, no full sort."""
    return scores.orderBy(F.desc(score), feature).limit(n)


def prefixes(scores: DataFrame, step: int = 20) -> DataFrame:
    """Feature subsets of an ablation: the top 1, 1 + step, ... features, all but the last one at most: (top_n, place, feature)."""
    places = ranked(scores)
    total = places.agg(F.count("*").alias("n"))
    sizes = total.select(F.explode(F.when(F.col("n") > 1, F.sequence(F.lit(1), (F.col("n") - 1).cast("int"), F.lit(step))).otherwise(F.array(F.lit(1)))).alias("top_n"))
    return places.join(F.broadcast(sizes), F.col("place") <= F.col("top_n")).select("top_n", "place", "feature")


def best_prefix(ablation: DataFrame) -> DataFrame:
    """The smallest number of features with the highest accuracy."""
    return ablation.orderBy(F.desc("accuracy"), "top_n").limit(1)


def correlations(vectors: DataFrame, names: Sequence[str], vec: str = "vec") -> DataFrame:
    """Pearson correlation of every pair of named components of an array column, over rows where both are finite: (a, b, r, n), a before b. A constant component has none (null)."""
    return block_correlations(vectors, names, vec)


def correlation_clusters(names: Sequence[str], pairs: DataFrame, threshold: float = 0.8) -> list[tuple[str, str]]:
    """(feature, first feature of its cluster) over |r| > threshold. Features are at most a few dozen, so the edges are collected."""
    up = {n: n for n in names}

    def root(x: str) -> str:
        while up[x] != x:
            x = up[x]
        return x

    for r in pairs.filter(F.abs("r") > threshold).select("a", "b").collect():
        a, b = sorted((root(r["a"]), root(r["b"])), key=list(names).index)
        up[b] = a
    return [(n, root(n)) for n in names]


def box_statistics(rows: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Quartiles of finite values and the outermost values within 1.5 interquartile ranges."""
    v = X.finite(F.col(value).cast("double"))
    q = rows.withColumn("_v", v).groupBy(*by).agg(F.percentile("_v", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"), F.count("_v").alias("n"))
    quart = q.select(*by, "n", F.get("q", F.lit(0)).alias("q1"), F.get("q", F.lit(1)).alias("median"), F.get("q", F.lit(2)).alias("q3"))
    fence = 1.5 * (F.col("q3") - F.col("q1"))
    inside = rows.withColumn("_v", v).join(F.broadcast(quart), list(by)).withColumn("_in", F.when((F.col("_v") >= F.col("q1") - fence) & (F.col("_v") <= F.col("q3") + fence), F.col("_v")))
    ends = inside.groupBy(*by).agg(F.min("_in").alias("low"), F.max("_in").alias("high"))
    return quart.join(ends, list(by))


def binned_information(rows: DataFrame, feature: str, label: str) -> DataFrame:
    """Mutual information of a discrete feature and a label, in nats, from their counts."""
    joint = rows.groupBy(feature, label).count()
    n = F.sum("count").over(Window.partitionBy())
    f, x = F.sum("count").over(Window.partitionBy(feature)), F.sum("count").over(Window.partitionBy(label))
    parts = joint.select((F.col("count") / n * F.log(F.col("count") * n / (f * x))).alias("part"))
    return parts.agg(F.sum("part").alias("mi"))


def neighbours(vectors: DataFrame, queries: DataFrame, k: int, metric: str = "euclidean", key: str = "vec_id", block: int = 20_000) -> DataFrame:
    """The k nearest other rows of each query: (query, neighbour, label, distance, place).

    Exact by definition, so every query meets every row. Queries are counted and broadcast as matrices, beyond `block` of them in hash blocks one
    after the other; a task streams its rows past them and sends the k nearest of each query it has met. Vectors that don't fit in a
    matrix (null, of another size, holding nulls or no finite numbers) meet the others in an expression: null components are left out, as in SQL.
    """
    spark = vectors.sparkSession
    ship(spark)
    # the passes are heavy for few bytes, so rows are dealt out to all cores whatever their files are like
    dealt = vectors.select(F.col(key).alias("neighbour"), "label", "vec").filter("neighbour IS NOT NULL").repartition(2 * spark.sparkContext.defaultParallelism)
    asked = queries.select(F.col(key).alias("query"), F.col("vec").alias("q")).filter("query IS NOT NULL")
    n, size = asked.agg(F.count("*"), F.max(F.size("q"))).first()
    blocks = max(1, -(-n // block))
    fits = lambda c: F.coalesce((F.size(c) == (size or 0)) & F.forall(c, lambda x: F.coalesce(F.abs(x) < 1e100, F.lit(False))), F.lit(False))
    plain, odd = dealt.filter(fits("vec")), dealt.filter(~fits("vec"))
    pairs = None
    for b in range(blocks):
        part = asked if blocks == 1 else asked.filter(F.pmod(F.xxhash64("query"), F.lit(blocks)) == b)
        nearest = plain.mapInArrow(nearest_in_task(spark, part.filter(fits("q")), k, metric), T.StructType([asked.schema["query"], *dealt.select("neighbour", "label").schema, T.StructField("distance", T.DoubleType())]))
        for met in (nearest, _met(odd, part, metric), _met(plain, part.filter(~fits("q")), metric)):
            pairs = met if pairs is None else pairs.union(met)
    pairs = pairs.withColumn("distance", F.round("distance", 9))
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.asc_nulls_last("distance"), "neighbour"))
    return pairs.withColumn("place", place).filter(F.col("place") <= k)


def _met(vectors: DataFrame, asked: DataFrame, metric: str) -> DataFrame:
    """(query, neighbour, label, distance) of all pairs, over the components that both have."""
    d = F.zip_with("q", F.slice("vec", F.lit(1), F.greatest(F.size("q"), F.lit(0))), lambda a, b: F.abs(a - b) if metric == "manhattan" else (a - b) * (a - b))
    d = F.filter(d, lambda x: x.isNotNull())
    total = F.when(F.size(d) > 0, F.aggregate(d, F.lit(0.0), lambda a, v: a + v))
    met = vectors.join(F.broadcast(asked), F.col("neighbour") != F.col("query"))
    return met.select("query", "neighbour", "label", (F.sqrt(total) if metric == "euclidean" else total).alias("distance"))


def nearest_in_task(spark: SparkSession, asked: DataFrame, k: int, metric: str, tile: tuple[int, int] = (32, 1024)):
    """A function of batches (neighbour, label, vec) that gives the k nearest of each row of `asked` (query, q), a bounded block: the distance unrounded, ties of rounded ones to the smaller neighbour.

    Distances are summed component by component, as the expression does. What lies beyond the k-th distance found so far is dropped at once, the rest
    whenever it is four times what stays.
    """
    found = asked.toArrow()
    kind = found.schema.field("query").type
    tools = spark.sparkContext.broadcast((found["query"].to_numpy(), np.stack(found["q"].to_numpy()).astype(np.float64) if found.num_rows else np.zeros((0, 0))))

    def run(batches):
        ids, q = tools.value
        columns, most = np.ascontiguousarray(q.T), np.full(len(ids), np.inf)
        held = [np.zeros(0, np.int64), np.zeros(0), None, None]  # query's place, distance, neighbour, label
        new: list[list] = []
        pending = 0

        def cut():
            nonlocal held, new, pending
            who, d = (np.concatenate([held[i], *(x[i] for x in new)]) for i in (0, 1))
            neighbour, label = (pa.chunked_array(([] if held[i] is None else [held[i]]) + [x[i] for x in new]).combine_chunks() for i in (2, 3))
            order = np.lexsort((neighbour.to_numpy(zero_copy_only=False), rounded(d), who))
            first = np.searchsorted(who[order], who[order])
            order = order[np.arange(len(order)) - first < k]
            held = [who[order], d[order], neighbour.take(pa.array(order)), label.take(pa.array(order))]
            full = np.flatnonzero(np.bincount(held[0], minlength=len(ids)) == k)
            ends = np.searchsorted(held[0], full, "right") - 1
            most[full] = held[1][ends] * (1 + 1e-12) + 2e-9
            new, pending = [], 0

        for batch in batches:
            neighbour, label = batch.column("neighbour"), batch.column("label")
            keys = neighbour.to_numpy(zero_copy_only=False)
            v = batch.column("vec").flatten().to_numpy().reshape(len(keys), -1) if len(keys) and len(ids) else np.zeros((0, 0))
            for a in range(0, len(v), tile[1]):
                some = np.ascontiguousarray(v[a : a + tile[1]].T)
                for b in range(0, len(ids), tile[0]):
                    d = np.zeros((len(ids[b : b + tile[0]]), some.shape[1]))
                    t = np.empty_like(d)
                    for x, y in zip(columns[:, b : b + tile[0]], some, strict=True):
                        np.subtract(x[:, None], y, out=t)
                        if metric == "manhattan":
                            np.abs(t, out=t)
                        else:
                            np.multiply(t, t, out=t)
                        d += t
                    if metric == "euclidean":
                        np.sqrt(d, out=d)
                    d[ids[b : b + tile[0], None] == keys[None, a : a + tile[1]]] = np.nan
                    limit = most[b : b + tile[0]]
                    if d.shape[1] > k and np.isinf(limit).any():
                        kth = np.partition(d, k - 1, axis=1)[:, k - 1]
                        limit = np.fmin(limit, kth * (1 + 1e-12) + 2e-9)
                    who, at = np.nonzero(d <= limit[:, None])
                    if len(who):
                        places = pa.array(at + a)
                        new.append([who + b, d[who, at], neighbour.take(places), label.take(places)])
                        pending += len(who)
                        if pending > max(1 << 16, 3 * k * len(ids)):
                            cut()
            if new:
                cut()  # the next batch has closer limits
        if held[2] is not None:
            yield pa.RecordBatch.from_arrays([pa.array(ids[held[0]], kind), held[2], held[3], pa.array(held[1])], names=["query", "neighbour", "label", "distance"])

    return run


def rounded(d: np.ndarray) -> np.ndarray:
    """Spark's round(d, 9), in units of 1e-9: from the decimal digits where the product is too near a half to tell."""
    x = d * 1e9
    out = np.floor(x + 0.5)
    for i in np.flatnonzero(np.abs(x - np.floor(x) - 0.5) < np.maximum(1e-6, x * 1e-15)).tolist():
        if d[i] < 1e300:
            out[i] = float(Decimal(repr(float(d[i]))).quantize(Decimal("1e-9"), ROUND_HALF_UP, _DIGITS).scaleb(9, _DIGITS))
    return out


def vote(near: DataFrame, ks: Sequence[int], weights: Sequence[str] = ("uniform", "distance")) -> DataFrame:
    """Predicted label of every query for each k and weighting, from one table of ranked neighbours; ties go to the smaller label."""
    w = F.when(F.col("weights") == "uniform", 1.0).otherwise(F.try_divide(F.lit(1.0), F.col("distance")))
    rows = near.withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks]))).filter(F.col("place") <= F.col("k")).withColumn("weights", F.explode(F.array(*[F.lit(x) for x in weights])))
    votes = rows.groupBy("query", "k", "weights", "label").agg(F.sum(F.coalesce(w, F.lit(1e12))).alias("v"))
    best = F.row_number().over(Window.partitionBy("query", "k", "weights").orderBy(F.desc(F.round("v", 9)), "label"))
    return votes.withColumn("r", best).filter("r = 1").select("query", "k", "weights", F.col("label").alias("predicted"))


def profile(rows: DataFrame, key: str, values: str) -> DataFrame:
    """Mean, and how far the extremes lie from it, at each position of array profiles: (key, position, average, above, below)."""
    cells = rows.select(key, F.posexplode(values).alias("position", "v"))
    mean = F.avg("v")
    return cells.groupBy(key, "position").agg(mean.alias("average"), (F.max("v") - mean).alias("above"), (mean - F.min("v")).alias("below"))


def centroid_distances(vectors: DataFrame, label: str, n: int, vec: str = "vec") -> DataFrame:
    """Euclidean distances of label centroids: means first, so that only centroids meet."""
    means = vectors.groupBy(label).agg(F.array(*[F.avg(F.get(vec, F.lit(i))) for i in range(n)]).alias("m"))
    a, b = means.select(F.col(label).alias("a"), F.col("m").alias("x")), means.select(F.col(label).alias("b"), F.col("m").alias("y"))
    total = F.aggregate(F.zip_with("x", "y", lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, v: s + v)
    return a.join(F.broadcast(b), F.col("a") < F.col("b")).select("a", "b", F.sqrt(total).alias("distance"))


def ranked_columns(scores: DataFrame, columns: DataFrame, n: int, score: str = "score", feature: str = "feature") -> DataFrame:
    """The first n of a ranking that a table has: `columns` (feature) are the table's, few and counted by their table's width."""
    return top_features(scores.join(columns.select(feature), feature, "left_semi"), n, score, feature)
