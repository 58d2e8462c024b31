"""Exploded result lists: rows without a key, and lists longer than the SQL's range."""

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq

from stratalith.plans.catalogue import ORACLES, QUERIES


def put(path, ids, labels):
    pq.write_table(pa.table({"vec_id": pa.array(ids, pa.int64()), "embedding": pa.array([[0.5]] * len(ids), pa.list_(pa.float32())), "label": pa.array(labels, pa.int32())}), path / "embeddings.parquet")


def test_rows_without_a_key_have_no_fold(spark, tmp_path):
    """A null key gives a null fold, which the SQL's `fold <> 3` leaves out."""
    put(tmp_path, [*range(-40, 200), *[None] * 3], [None if i % 7 == 3 else i % 10 for i in range(243)])
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet'")
    got = QUERIES["result_explode"](spark, str(tmp_path))
    found = con.execute(f"SELECT {', '.join(got.columns)} FROM ({ORACLES['result_explode']})").fetchall()
    assert found and sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, found))


def test_long_lists_stay_whole(spark, tmp_path):
    put(tmp_path, [12 * i for i in range(10_005)], [i % 10 for i in range(10_005)])
    got = QUERIES["result_explode"](spark, str(tmp_path)).select("position").collect()
    assert sorted(r[0] for r in got) == list(range(10_005))
