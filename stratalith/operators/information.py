"""Mutual information of continuous features and a class by nearest neighbours, without a table of pairs.

In one sort of a feature's values within a class, a value's k nearest are among k to the left and k to the right; in one sort of all its values
together with the ends of their neighbourhoods, running counts tell how many lie inside. Both are windows that Spark sorts and spills; each feature is
worked on by itself.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numbers as X

EULER = 0.5772156649015329


def digamma(n: Column) -> Column:
    """psi of a positive whole number: harmonic sums up to 20, beyond by its asymptotic series, to 12 digits."""
    small = [-EULER + math.fsum(1.0 / k for k in range(1, m)) for m in range(1, 21)]
    x = n.cast("double")
    y = 1.0 / (x * x)
    series = F.log(x) - 0.5 / x - y * (1.0 / 12 - y * (1.0 / 120 - y / 252))
    return F.when(n <= 20, F.get(F.array(*[F.lit(v) for v in small]), n.cast("int") - 1)).otherwise(series)


def neighbour_information(long: DataFrame, label: str = "label", k: int = 3) -> DataFrame:
    """(feature, mi): psi(n) + mean psi(k) - mean psi(class size) - mean psi(neighbours within), not below 0, in nats, of rows (feature, label, value).

    k is at most the class size less 1; classes of one row, values that aren't finite and rows without a class are left out. Neighbours within: values,
    the own one too, nearer than the k-th nearest of the class; if that is at the same place, all values there.
    """
    used = long.select("feature", F.col(label).alias("c"), X.finite(F.col("value").cast("double")).alias("v")).filter("v IS NOT NULL AND c IS NOT NULL")
    by_class = Window.partitionBy("feature", "c")
    order = by_class.orderBy("v")
    counted = used.withColumn("size", F.count("*").over(by_class)).filter("size > 1").withColumn("k", F.least(F.lit(k), F.col("size") - 1).cast("int"))
    sides = [F.struct(F.abs(F.col("v") - step).alias("d"), step.alias("at")) for i in range(1, k + 1) for step in (F.lag("v", i).over(order), F.lead("v", i).over(order))]
    near = F.array_sort(F.filter(F.array(*sides), lambda s: s["d"].isNotNull()))
    kth = counted.withColumn("s", F.get(near, F.col("k") - 1)).select("feature", "v", "size", "k", F.col("s.d").alias("r"), F.col("s.at").alias("at"))
    # the side of the k-th neighbour ends exactly there, the other one as far away
    ends = kth.withColumn("low", F.when(F.col("at") < F.col("v"), F.col("at")).otherwise(F.col("v") - F.col("r"))).withColumn("high", F.when(F.col("at") > F.col("v"), F.col("at")).otherwise(F.col("v") + F.col("r")))
    # at one place: first ends that begin behind it, then values, then ends that begin at it; a neighbourhood of no width takes what is at its place
    flat = F.col("r") == 0
    events = F.array(
        F.struct(F.col("v").alias("at"), F.lit(1).alias("turn"), F.lit(1).alias("value"), F.lit(0).alias("sign")),
        F.struct(F.col("low").alias("at"), F.when(flat, 0).otherwise(2).alias("turn"), F.lit(0).alias("value"), F.lit(-1).alias("sign")),
        F.struct(F.col("high").alias("at"), F.when(flat, 2).otherwise(0).alias("turn"), F.lit(0).alias("value"), F.lit(1).alias("sign")),
    )
    rows = ends.withColumn("id", F.monotonically_increasing_id()).select("feature", "id", "size", "k", F.explode(events).alias("e")).select("feature", "id", "size", "k", "e.*")
    before = F.sum("value").over(Window.partitionBy("feature").orderBy("at", "turn").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    within = rows.withColumn("before", before).groupBy("feature", "id", "size", "k").agg(F.sum(F.col("sign") * F.col("before")).alias("m"))
    terms = within.groupBy("feature").agg(F.count("*").alias("n"), F.avg(digamma(F.col("k"))).alias("pk"), F.avg(digamma(F.col("size"))).alias("pc"), F.avg(digamma(F.greatest(F.col("m"), F.lit(1)))).alias("pm"))
    return terms.select("feature", F.greatest(F.lit(0.0), digamma(F.col("n")) + F.col("pk") - F.col("pc") - F.col("pm")).alias("mi"))
