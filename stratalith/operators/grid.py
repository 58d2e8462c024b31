"""Measures of layered images in the pixel form (sample_name, z, x, y, v).

Thresholds become aggregate columns, not rows, so a pixel is read once whatever the number of thresholds; neighbours come
from windows where they lie in one row of pixels, and from an equi-join on the neighbour's place where they don't.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numbers as X

LAYER = ["sample_name", "z"]


def normalised(pixels: DataFrame) -> DataFrame:
    """v divided by the largest v of its layer; a layer of zeros has null."""
    return pixels.withColumn("v", F.try_divide("v", F.max("v").over(Window.partitionBy(*LAYER))))


def centred(pixels: DataFrame) -> DataFrame:
    """(v - mean) / (max - min) of its layer; a flat layer has null."""
    w = Window.partitionBy(*LAYER)
    return pixels.withColumn("v", F.try_divide(F.col("v") - F.avg("v").over(w), F.max("v").over(w) - F.min("v").over(w)))


def _rows(wide: DataFrame, keys: Sequence[str], names: Sequence[str], thresholds: Sequence[float]) -> DataFrame:
    """Columns name_i to rows (keys, i, threshold, names...)."""
    cells = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(t)).alias("threshold"), *[F.col(f"{n}_{i}").alias(n) for n in names]) for i, t in enumerate(thresholds)])
    return wide.select(*keys, F.explode(cells).alias("c")).select(*keys, "c.*")


def intensity(pixels: DataFrame) -> DataFrame:
    """Per layer: mean, med, max, min, diff (range), std and var over all pixels (ddof 0)."""
    return pixels.groupBy(*LAYER).agg(F.avg("v").alias("mean"), F.percentile("v", F.lit(0.5)).alias("med"), F.max("v").alias("max"), F.min("v").alias("min"), (F.max("v") - F.min("v")).alias("diff"), F.stddev_pop("v").alias("std"), F.var_pop("v").alias("var"))


def emptiness(pixels: DataFrame) -> DataFrame:
    """Share of a layer's pixels below its mean."""
    low = F.col("v") < F.avg("v").over(Window.partitionBy(*LAYER))
    return pixels.withColumn("low", low).groupBy(*LAYER).agg(F.avg(F.col("low").cast("double")).alias("minProp"))


def value_frequency(pixels: DataFrame, voxel: float) -> DataFrame:
    """Median number of pixels of a value times the voxel's volume, per layer."""
    return pixels.groupBy(*LAYER, "v").count().groupBy(*LAYER).agg((F.percentile("count", F.lit(0.5)) * voxel).alias("GPTVolume"))


def threshold_counts(pixels: DataFrame, thresholds: Sequence[float] = tuple(X.THRESHOLDS)) -> DataFrame:
    """Pixels above each threshold, per layer: (sample_name, z, i, threshold, n)."""
    wide = pixels.groupBy(*LAYER).agg(*[F.count_if(F.col("v") > float(t)).alias(f"n_{i}") for i, t in enumerate(thresholds)])
    return _rows(wide, LAYER, ["n"], thresholds)


def share_of_total(long: DataFrame, value: str = "value") -> DataFrame:
    """100 * value / sum of its feature over a sample's layers; null if that sum is 0."""
    total = F.sum(value).over(Window.partitionBy("sample_name", "feature"))
    return long.withColumn("share", F.try_divide(100 * F.col(value), total))


def biovolume(counts: DataFrame, voxel: float, side: float = 134.0) -> DataFrame:
    """Sum of a threshold's counts over all layers, times voxel / side^2: (sample_name, i, biovolume)."""
    return counts.groupBy("sample_name", "i").agg((F.sum("n") * voxel / (side * side)).alias("biovolume"))


def coverage(counts: DataFrame, area: Column, i: int) -> DataFrame:
    """100 * count of the first layer at threshold number i over the area of a layer."""
    return counts.filter((F.col("z") == 0) & (F.col("i") == i)).select("sample_name", (100.0 * F.col("n") / area).alias("coverage"))


def thickness(pixels: DataFrame, thresholds: Sequence[float] = tuple(X.THRESHOLDS)) -> DataFrame:
    """Mean thickness and roughness per threshold: (sample_name, i, threshold, thickness, roughness).

    Above a substrate pixel (layer 0, v > threshold) thickness is 1 + the unbroken run of layers above the threshold. Roughness is the
    mean step of thickness in row-major order, which telescopes to (last - first) / (n - 1); null with fewer than two pixels.
    """
    z, v = F.col("z"), F.col("v")
    stops = [F.min(F.when((z >= 1) & (v <= float(t)), z)).alias(f"stop_{i}") for i, t in enumerate(thresholds)]
    columns = pixels.groupBy("sample_name", "x", "y").agg(F.max(F.when(z == 0, v)).alias("ground"), (F.max("z") + 1).alias("layers"), *stops)
    aggs = []
    for i, t in enumerate(thresholds):
        h = F.when(F.col("ground") > float(t), F.coalesce(F.col(f"stop_{i}"), F.col("layers")).cast("double"))
        at = F.when(h.isNotNull(), F.struct("x", "y"))
        aggs += [F.avg(h).alias(f"thickness_{i}"), F.try_divide(F.max_by(h, at) - F.min_by(h, at), F.count(h) - 1).alias(f"roughness_{i}")]
    return _rows(columns.groupBy("sample_name").agg(*aggs), ["sample_name"], ["thickness", "roughness"], thresholds)


def spreading(pixels: DataFrame) -> DataFrame:
    """Spread of pixels above 0: Sxy = sqrt(var x + var y), Sz = var z, Sxyz = sqrt of all three; null for an empty stack."""
    on = F.col("v") > 0
    var = {c: F.var_pop(F.when(on, F.col(c))) for c in "xyz"}
    return pixels.groupBy("sample_name").agg(F.sqrt(var["x"] + var["y"]).alias("sxy"), var["z"].alias("sz"), F.sqrt(var["x"] + var["y"] + var["z"]).alias("sxyz"))


def box_counts(pixels: DataFrame, sizes: Sequence[int]) -> DataFrame:
    """Boxes of side k that are partly filled with pixels below the layer's median: (sample_name, z, k, boxes)."""
    below = pixels.withColumn("on", (F.col("v") < F.percentile("v", F.lit(0.5)).over(Window.partitionBy(*LAYER))).cast("int"))
    out = None
    for k in sizes:
        boxes = below.groupBy(*LAYER, F.floor(F.col("x") / k).alias("bx"), F.floor(F.col("y") / k).alias("by")).agg(F.sum("on").alias("s"))
        part = boxes.groupBy(*LAYER).agg(F.count_if((F.col("s") > 0) & (F.col("s") < k * k)).alias("boxes")).withColumn("k", F.lit(k))
        out = part if out is None else out.unionByName(part)
    return out


def box_sizes(side: int) -> list[int]:
    """Powers of two from the largest within `side` down to 4."""
    return [2**n for n in range(side.bit_length() - 1, 1, -1)]


def fractal_dimension(counts: DataFrame) -> DataFrame:
    """Negative slope of ln boxes over ln k, per layer; null if a size has no box."""
    ln = F.when(F.col("boxes") > 0, F.log("boxes"))
    return counts.groupBy(*LAYER).agg(F.when(F.count(ln) == F.count("*"), -F.regr_slope(ln, F.log("k"))).alias("GPTFractalDim"))


def cooccurrence(pixels: DataFrame) -> DataFrame:
    """Texture of integer grey levels from symmetric pairs of right neighbours: contrast, dissimilarity, homogeneity, energy, correlation, ASM per layer."""
    right = F.lead("v").over(Window.partitionBy(*LAYER, "x").orderBy("y"))
    pairs = pixels.select(*LAYER, F.col("v").cast("long").alias("a"), right.cast("long").alias("b")).filter(F.col("b").isNotNull())
    counted = pairs.groupBy(*LAYER, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).count()
    both = counted.select(*LAYER, F.explode(F.when(F.col("a") == F.col("b"), F.array(F.struct("a", "b", (2 * F.col("count")).alias("n")))).otherwise(F.array(F.struct("a", "b", F.col("count").alias("n")), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), F.col("count").alias("n"))))).alias("p")).select(*LAYER, "p.*")
    n, a, b = F.col("n").cast("double"), F.col("a"), F.col("b")
    d = (a - b).cast("double")
    total = F.sum(n)
    mean = F.sum(n * a) / total
    var = F.sum(n * a * a) / total - mean * mean
    cov = F.sum(n * a * b) / total - mean * mean
    asm = F.sum(n * n) / (total * total)
    return both.groupBy(*LAYER).agg((F.sum(n * d * d) / total).alias("contrast"), (F.sum(n * F.abs(d)) / total).alias("dissimilarity"), (F.sum(n / (1 + d * d)) / total).alias("homogeneity"), F.sqrt(asm).alias("energy"), F.when(var > 1e-12, cov / var).otherwise(1.0).alias("correlation"), asm.alias("asm"))


def transition_homogeneity(pixels: DataFrame, bins: int) -> DataFrame:
    """Sum of p / (1 + (a - b)^2) over transitions of binned values between a place and six others.

    As the published feature has it, the second coordinate of a neighbour is counted from the first: (z + dz, z + dx, y + dy).
    """
    top = F.max("v").over(Window.partitionBy("sample_name"))
    binned = pixels.select("sample_name", "z", "x", "y", X.digitize(F.col("v"), top, bins).alias("b"))
    steps = F.array(*[F.struct(F.lit(p).alias("dz"), F.lit(q).alias("dx"), F.lit(r).alias("dy")) for p, q, r in ((1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1))])
    asked = binned.withColumn("s", F.explode(steps)).select("sample_name", F.col("b").alias("mine"), (F.col("z") + F.col("s.dz")).alias("z"), (F.col("z") + F.col("s.dx")).alias("x"), (F.col("y") + F.col("s.dy")).alias("y"))
    # a place is asked for by every x of a row, with few values: count before joining
    asked = asked.groupBy("sample_name", "z", "x", "y", "mine").count()
    found = asked.join(binned, ["sample_name", "z", "x", "y"])
    d = (F.col("mine") - F.col("b")).cast("double")
    return found.groupBy("sample_name").agg((F.sum(F.col("count") / (1 + d * d)) / F.sum("count")).alias("homogeneity"))


def layer_differences(layers: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Mean, largest and smallest step of a value along the layers."""
    step = F.col(value) - F.lag(value).over(Window.partitionBy(key).orderBy(order))
    return layers.withColumn("step", step).groupBy(key).agg(F.avg("step").alias("mdiffs"), F.max("step").alias("maxdiffs"), F.min("step").alias("mindiffs"))


def mean_step(layers: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """The mean step without a sort: (last - first) / (n - 1)."""
    return layers.groupBy(key).agg(F.try_divide(F.max_by(value, order) - F.min_by(value, order), F.count("*") - 1).alias("mdiffs"))


def thin_layers(layers: DataFrame, z: str = "z") -> DataFrame:
    """Every other layer, from the first."""
    return layers.filter(F.col(z) % 2 == 0)


def thin_stacks(layers: DataFrame, expected: int = 21) -> DataFrame:
    """Every other layer, from the first, of stacks whose name ends in `expected` as their number of layers; those are renumbered, and their name ends in the
    number that is left. Other stacks stay as they are."""
    count = F.regexp_extract("sample_name", "([0-9]+)$", 1)
    thins = count == str(expected)
    renamed = F.when(thins, F.concat(F.regexp_replace("sample_name", "[0-9]+$", ""), F.lit(str((expected + 1) // 2)))).otherwise(F.col("sample_name"))
    return layers.filter(~thins | (F.col("z") % 2 == 0)).withColumn("z", F.when(thins, F.floor(F.col("z") / 2)).otherwise(F.col("z")).cast(layers.schema["z"].dataType)).withColumn("sample_name", renamed)
