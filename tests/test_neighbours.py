"""Neighbours by definition: odd vectors, ties and copies, in one block of queries and in several."""

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from stratalith.operators import structure as R
from stratalith.plans.catalogue import ORACLES, QUERIES
from stratalith.plans.reports import _near_sql


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    """Vectors on a coarse grid, so that distances tie; copies; near copies; null and short ones, and ones with null components, queries among them."""
    rng = np.random.default_rng(5)
    vecs = [(rng.integers(0, 3, 6) / 4).astype(np.float32).tolist() for _ in range(700)]
    vecs[50:150] = [vecs[0]] * 100
    vecs[150:250] = [[x + np.float32(2e-8) * (i % 3) for x in vecs[100]] for i in range(100)]
    for i in (3, 200, 301):
        vecs[i] = None
    for i in (4, 300, 302):
        vecs[i] = [None, *vecs[i][1:]]
    vecs[5], vecs[6] = vecs[5][:3], [None] * 6
    path = tmp_path_factory.mktemp("odd")
    pq.write_table(pa.table({"vec_id": pa.array(range(700), pa.int64()), "embedding": pa.array(vecs, pa.list_(pa.float32())), "label": pa.array([i % 4 for i in range(700)], pa.int32())}), path / "embeddings.parquet")
    return str(path)


@pytest.fixture(scope="module")
def duck(odd):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{odd}/embeddings.parquet'")
    return con


@pytest.mark.parametrize("metric", ["euclidean", "manhattan"])
def test_neighbours_equal_their_sql(spark, odd, duck, metric):
    rows = spark.read.parquet(f"{odd}/embeddings.parquet").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("vec"))
    told = sorted(duck.execute(f"SELECT query, place, neighbour, label, distance FROM {_near_sql(31, metric)}").fetchall())
    for block in (1000, 3):
        got = R.neighbours(rows, rows.filter("vec_id % 100 = 0"), 31, metric, block=block)
        assert sorted(map(tuple, got.select("query", "place", "neighbour", "label", "distance").collect())) == told


@pytest.mark.parametrize("name", ["knn_predict", "knn_grid"])
def test_queries_equal_their_sql(spark, odd, duck, name):
    got = QUERIES[name](spark, odd)
    found = duck.execute(ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(map(tuple, got.select(*names).collect())) == sorted(found.fetchall())


def test_no_table_of_pairs(spark, odd):
    """A task sends the nearest of each query it has met, not the pairs."""
    rows = spark.read.parquet(f"{odd}/embeddings.parquet").select(F.col("vec_id").alias("neighbour"), "label", F.col("embedding").cast("array<double>").alias("vec")).filter("neighbour BETWEEN 400 AND 699").coalesce(1)
    run = R.nearest_in_task(spark, rows.filter("neighbour % 100 = 0").select(F.col("neighbour").alias("query"), F.col("vec").alias("q")), 5, "euclidean", (2, 64))
    assert rows.mapInArrow(run, "query long, neighbour long, label int, distance double").count() == 3 * 5


def test_rounding_is_sparks(spark):
    d = np.concatenate([np.random.default_rng(1).random(2000) * 10, [0.0, 0.1234567885, 0.0000000005, 1.0000000015, 2.0000000025, 12345.6789012345, 1e20]])
    want = [r[0] for r in spark.createDataFrame([(float(x),) for x in d], "d double").select(F.round("d", 9)).collect()]
    assert np.allclose(R.rounded(d) / 1e9, want, rtol=1e-15, atol=0)
