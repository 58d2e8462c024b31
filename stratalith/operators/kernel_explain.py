"""Attributions of any model by sampled coalitions: features outside a coalition take the values of background rows.

Mixed rows (explained row x coalition x background row) are made in Arrow batches, scored by the model itself where they are made, and averaged
over the background on the map side, so only one number a coalition and row is shuffled. For each row, values of coalitions are then fitted by weighted least
squares under the constraint that attributions add up to the prediction. If all coalitions fit into the number asked for, they are taken with their
exact weights, and so are the attributions.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.ml import Transformer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..shipping import ship
from .models import vectors

# fixed values: how many rows are explained, and how many stand for what isn't known
MOST_ROWS, MOST_BACKGROUND = 50, 100


def coalitions(features: int, most: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """(members, weights): the empty and the whole coalition first (weight 0, as the constraint holds them), then all others, or a sample drawn by size together with complements."""
    ends = np.array([np.zeros(features, bool), np.ones(features, bool)])
    if features < 2:
        return ends, np.zeros(2)
    if features < 31 and 2**features - 2 <= most:
        numbers = np.arange(1, 2**features - 1)
        members = (numbers[:, None] >> np.arange(features) & 1).astype(bool)
        sizes = members.sum(axis=1)
        weights = np.array([(features - 1) / (math.comb(features, s) * s * (features - s)) for s in sizes.tolist()])
    else:
        rng = np.random.default_rng(seed)
        sizes = np.arange(1, features)
        share = 1.0 / (sizes * (features - sizes))
        drawn = np.zeros((most // 2, features), bool)
        for row, size in zip(drawn, rng.choice(sizes, most // 2, p=share / share.sum()), strict=True):
            row[rng.choice(features, size, replace=False)] = True
        members, counts = np.unique(np.concatenate([drawn, ~drawn]), axis=0, return_counts=True)
        weights = counts.astype(float)
    return np.concatenate([ends, members]), np.concatenate([[0.0, 0.0], weights / weights.sum()])


def solve(members: np.ndarray, weights: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Attributions that add up to values[whole] - values[empty] and fit the other coalitions best."""
    base, whole = values[0], values[1]
    if members.shape[1] == 1:
        return np.array([whole - base])
    z, y, w = members[2:].astype(float), values[2:] - base, np.sqrt(weights[2:])
    left = y - z[:, -1] * (whole - base)
    first = np.linalg.lstsq((z[:, :-1] - z[:, -1:]) * w[:, None], left * w, rcond=None)[0]
    return np.append(first, whole - base - first.sum())


def kernel_attributions(
    model: Transformer, rows: DataFrame, background: DataFrame, output: Column, key: str = "sample_name", vec: str = "vec", most: int | None = None, seed: int = 7, block: int = 64, most_rows: int = MOST_ROWS, most_background: int = MOST_BACKGROUND
) -> DataFrame:
    """(key, base_value, prediction, attributions array<double>) of the first `most_rows` rows by key, against the first `most_background` background rows.

    `model` adds to rows with `vec` and `features` what `output` reads. Coalitions: `most`, by default 2,048 and two for each feature.
    """
    spark = rows.sparkSession
    ship(spark)
    ground = np.array([r[0] for r in background.orderBy(key).limit(most_background).select(vec).collect()], float)  # bounded
    if not len(ground):
        raise ValueError("no background rows")
    members, weights = coalitions(ground.shape[1], most or 2048 + 2 * ground.shape[1], seed)
    held = spark.sparkContext.broadcast((np.packbits(members, axis=1), members.shape[1], weights, ground))
    blocks = -(-len(members) // block)
    asked = rows.orderBy(key).limit(most_rows).select(key, vec)
    units = asked.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).repartition(min(200, blocks * 4), key, "_block")
    made = StructType([asked.schema[key], *StructType.fromDDL("_coalition int").fields, StructField(vec, asked.schema[vec].dataType)])

    def mixed(batches):
        packed, n, _, ground = held.value
        for batch in batches:
            for k in range(batch.num_rows):
                x, number = np.asarray(batch.column(1)[k].values, float), batch.column(2)[k].as_py()
                at = np.arange(number * block, min((number + 1) * block, len(packed)))
                inside = np.unpackbits(packed[at], axis=1, count=n).astype(bool)
                for c, z in zip(at, inside, strict=True):
                    cells = np.where(z, x, ground)
                    offsets = np.arange(0, cells.size + 1, n, dtype=np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array([batch.column(0)[k].as_py()] * len(ground), batch.column(0).type), pa.array(np.full(len(ground), c, np.int32)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(cells.ravel()))], names=[key, "_coalition", vec])

    scored = model.transform(vectors(units.select(key, vec, "_block").mapInArrow(mixed, made), vec))
    values = scored.select(key, "_coalition", output.cast("double").alias("_y")).groupBy(key, "_coalition").agg(F.avg("_y").alias("_y"))

    def fit(table: pa.Table) -> pa.Table:
        packed, n, weights, _ = held.value
        y = np.zeros(len(packed))
        y[table["_coalition"].to_numpy()] = table["_y"].to_numpy()
        found = solve(np.unpackbits(packed, axis=1, count=n).astype(bool), weights, y)
        return pa.table({key: table[key].combine_chunks().slice(0, 1), "base_value": [y[0]], "prediction": [y[1]], "attributions": pa.array([found.tolist()], pa.list_(pa.float64()))})

    return values.groupBy(key).applyInArrow(fit, StructType([asked.schema[key], *StructType.fromDDL("base_value double, prediction double, attributions array<double>").fields]))


def write_attributions(attributions: DataFrame, names: list[str], path: str, key: str = "sample_name") -> None:
    """Comma-separated tables below `path`: `values` (key, a column for each feature) and `importance` (feature, mean absolute attribution, highest first)."""
    from ..sources.tables import write_tsv

    write_tsv(attributions.select(key, *[F.get("attributions", F.lit(i)).alias(n) for i, n in enumerate(names)]), f"{path}/values", sep=",")
    each = attributions.select(F.posexplode("attributions").alias("i", "a")).groupBy("i").agg(F.avg(F.abs("a")).alias("importance"))
    named = each.select(F.get(F.array(*[F.lit(n) for n in names]), F.col("i")).alias("feature"), "importance")
    write_tsv(named.orderBy(F.desc("importance"), "feature").coalesce(1), f"{path}/importance", sep=",")
