"""Bootstrap intervals of means in one pass: each row weighs in each replicate by a Poisson number that is a hash of row and replicate."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: cumulative Poisson(1) probabilities: a uniform number's weight is how many of them it reaches
STEPS = [math.fsum(math.exp(-1) / math.factorial(j) for j in range(i + 1)) for i in range(12)]


def weight(key: Column, replicate: Column) -> Column:
    """Poisson(1) weight of a row in a replicate, from the first 32 bits of MD5 of `key:replicate`."""
    u = F.conv(F.substring(F.md5(F.concat(key.cast("string"), F.lit(":"), replicate.cast("string"))), 1, 8), 16, 10).cast("double") / 4294967296.0
    return sum(((u >= F.lit(s)).cast("int") for s in STEPS), F.lit(0))


def bootstrap_means(rows: DataFrame, by: Sequence[str], value: str, key: str, replicates: int = 1000, level: float = 0.95) -> DataFrame:
    """(by, mean, low, high, n): the mean and its percentile interval. Rows are resampled where they are; only sums by group and replicate are shuffled."""
    each = rows.filter(F.col(value).isNotNull()).withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    weighed = each.withColumn("_w", weight(F.col(key), F.col("_b")))
    sums = weighed.groupBy(*by, "_b").agg(F.sum(F.col("_w") * F.col(value)).alias("s"), F.sum("_w").alias("w"), F.sum(value).alias("all"), F.count("*").alias("n"))
    tail = (1 - level) / 2
    ends = F.percentile(F.try_divide(F.col("s"), F.col("w")), F.array(F.lit(tail), F.lit(1 - tail)))
    return sums.groupBy(*by).agg((F.max("all") / F.max("n")).alias("mean"), F.get(ends, F.lit(0)).alias("low"), F.get(ends, F.lit(1)).alias("high"), F.max("n").alias("n"))
