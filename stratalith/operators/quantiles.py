"""The ten statistics of groups that no single task can hold: values are counted, sorted over all tasks, and quantiles read off by rank."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import kept
from .features import STATISTICS

SHARES = {"median": 0.5, "q10": 0.1, "q25": 0.25, "q75": 0.75, "q90": 0.9}


def split_statistics(long: DataFrame, keys: Sequence[str] = ("sample_name", "feature"), value: str = "value") -> DataFrame:
    """As `features.ten_statistics`, whatever the size of a group: one row per key, one column per statistic.

    Equal values are counted first, on the map side too, so many copies of a value are one row. The distinct ones are dealt to tasks by range, so a large group lies
    in many; each task counts its part of a group, the parts' counts (few rows) give where each begins, and the values at the ranks that quantiles need go on.
    """
    keys = list(keys)
    x = F.nanvl(F.col(value).cast("double"), F.lit(None).cast("double"))
    rows = long.select(*keys, x.alias("_x"))
    moments = rows.groupBy(*keys).agg(F.min("_x").alias("min"), F.max("_x").alias("max"), F.avg("_x").alias("mean"), F.stddev_samp("_x").alias("std"), F.var_samp("_x").alias("var"), F.count("_x").alias("_n"))
    counted = rows.filter("_x IS NOT NULL").groupBy(*keys, "_x").agg(F.count("*").alias("_c"))
    # the part a value lies in must not change: it is written with it
    dealt = kept(counted.repartitionByRange(*[F.col(k) for k in keys], F.col("_x")).withColumn("_part", F.spark_partition_id()), "ranges")
    parts = dealt.groupBy(*keys, "_part").agg(F.sum("_c").alias("_c"))
    begins = parts.withColumn("_begin", F.sum("_c").over(Window.partitionBy(*keys).orderBy("_part")) - F.col("_c")).drop("_c")
    here = F.sum("_c").over(Window.partitionBy(*keys, "_part").orderBy("_x"))
    ranked = dealt.withColumn("_upto", here)
    b = begins.select(*[F.col(c).alias(f"_b{i}") for i, c in enumerate([*keys, "_part"])], "_begin")
    ranked = ranked.join(b, [F.col(c).eqNullSafe(F.col(f"_b{i}")) for i, c in enumerate([*keys, "_part"])]).select(*keys, "_x", "_c", (F.col("_begin") + F.col("_upto")).alias("_end"))
    m = moments.select(*[F.col(c).alias(f"_m{i}") for i, c in enumerate(keys)], "_n")
    sized = ranked.join(m, [F.col(c).eqNullSafe(F.col(f"_m{i}")) for i, c in enumerate(keys)])
    picks = {}
    for name, share in SHARES.items():
        at = F.lit(share) * (F.col("_n") - 1)
        for side, rank in (("low", F.floor(at)), ("high", F.ceil(at))):
            picks[f"_{name}_{side}"] = F.max(F.when((rank >= F.col("_end") - F.col("_c")) & (rank < F.col("_end")), F.col("_x")))
    # only values at one of the ranks go on: at most ten for each group
    wanted = F.array(*[f(F.lit(s) * (F.col("_n") - 1)) for s in SHARES.values() for f in (F.floor, F.ceil)])
    few = sized.filter(F.exists(wanted, lambda r: (r >= F.col("_end") - F.col("_c")) & (r < F.col("_end"))))
    found = few.groupBy(*keys).agg(*[v.alias(k) for k, v in picks.items()])
    q = found.select(*[F.col(c).alias(f"_q{i}") for i, c in enumerate(keys)], *picks)
    joined = moments.join(q, [F.col(c).eqNullSafe(F.col(f"_q{i}")) for i, c in enumerate(keys)], "left")
    out = {}
    for name, share in SHARES.items():
        at = F.lit(share) * (F.col("_n") - 1)
        low, high = F.col(f"_{name}_low"), F.col(f"_{name}_high")
        out[name] = F.when(low == high, low).otherwise((F.ceil(at) - at) * low + (at - F.floor(at)) * high)
    return joined.select(*keys, *[(out[s] if s in out else F.col(s)).alias(s) for s in STATISTICS])
