"""Correlations of thousands of features: sums of outer products by blocks of features, missing cells by masks."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import numbers as X
from ..shipping import ship

_BLOCK = "a int, b int, salt int, sums binary"


def _sums(x: np.ndarray, m: np.ndarray, y: np.ndarray, n: np.ndarray) -> np.ndarray:
    """For all pairs of columns of two blocks, over rows where both are there: count, sums of either, of its squares, and of products."""
    return np.stack([m.T @ n, x.T @ n, m.T @ y, (x * x).T @ n, m.T @ (y * y), x.T @ y])


def block_correlations(vectors: DataFrame, names: Sequence[str], vec: str = "vec", block: int = 256, salts: int = 32, flat: float = 1e-12) -> DataFrame:
    """Pearson correlation of every pair of named components of an array column, over rows where both are finite: (a, b, r, n), a before b.

    Each task adds up its rows' outer products by pairs of blocks, so its memory and what it sends depend on the number of features only; the tasks' sums are
    added in two steps, first some tasks' each, so that none adds up all. Columns are taken from their least value, so that a constant one is exactly 0;
    one whose variance is below `flat` of its mean square has no correlation (null).
    """
    spark, p = vectors.sparkSession, len(names)
    ship(spark)
    if p < 2:
        return spark.createDataFrame([], "a string, b string, r double, n long")
    cells = vectors.select(F.transform(F.col(vec), lambda v: X.finite(v.cast("double"))).alias("v"))
    lows = cells.select(F.posexplode("v").alias("i", "v")).groupBy("i").agg(F.min("v").alias("low")).collect()  # one number a feature
    low = np.zeros(p)
    for r in lows:
        if r["i"] < p and r["low"] is not None:
            low[r["i"]] = r["low"]
    held = spark.sparkContext.broadcast((low, list(names)))
    starts = list(range(0, p, block))

    def task(batches):
        from pyspark import TaskContext

        low = held.value[0]
        total: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            table = np.array([np.pad(np.asarray(v, float), (0, max(0, p - len(v))), constant_values=np.nan)[:p] for v in batch.column(0).to_pylist() if v is not None], float).reshape(-1, p)
            there = np.isfinite(table)
            values, mask = np.where(there, table - low, 0.0), there.astype(float)
            for i, a in enumerate(starts):
                for j, b in enumerate(starts[i:], i):
                    part = _sums(values[:, a : a + block], mask[:, a : a + block], values[:, b : b + block], mask[:, b : b + block])
                    total[i, j] = total[i, j] + part if (i, j) in total else part
        salt = TaskContext.get().partitionId() % salts
        for (i, j), sums in total.items():
            yield pa.RecordBatch.from_arrays([*[pa.array([v], pa.int32()) for v in (i, j, salt)], pa.array([sums.tobytes()], pa.binary())], names=["a", "b", "salt", "sums"])

    def added(table: pa.Table) -> np.ndarray:
        total = None
        for chunk in table["sums"]:
            one = np.frombuffer(chunk.as_py(), float)
            total = one.copy() if total is None else total + one
        return total

    def some(table: pa.Table) -> pa.Table:
        return pa.table({**{c: table[c].combine_chunks().slice(0, 1) for c in ("a", "b", "salt")}, "sums": pa.array([added(table).tobytes()], pa.binary())})

    def finish(table: pa.Table) -> pa.Table:
        names = held.value[1]
        i, j = table["a"][0].as_py(), table["b"][0].as_py()
        a, b = names[starts[i] : starts[i] + block], names[starts[j] : starts[j] + block]
        n, sx, sy, sxx, syy, sxy = added(table).reshape(6, len(a), len(b))
        with np.errstate(all="ignore"):
            vx, vy = sxx / n - (sx / n) ** 2, syy / n - (sy / n) ** 2
            r = (sxy / n - sx / n * (sy / n)) / np.sqrt(vx * vy)
            none = (n == 0) | (vx <= flat * sxx / n) | (vy <= flat * syy / n) | ~np.isfinite(r)
        rows, columns = np.nonzero(np.triu(np.ones_like(n), 1) if i == j else np.ones_like(n))
        return pa.table({"a": pa.array([a[k] for k in rows], pa.string()), "b": pa.array([b[k] for k in columns], pa.string()), "r": pa.array(np.clip(r, -1, 1)[rows, columns], mask=none[rows, columns], from_pandas=False), "n": pa.array(n[rows, columns].astype(np.int64))})

    sums = cells.mapInArrow(task, _BLOCK).groupBy("a", "b", "salt").applyInArrow(some, _BLOCK)
    return sums.groupBy("a", "b").applyInArrow(finish, "a string, b string, r double, n long")
