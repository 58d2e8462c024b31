"""Folds are fitted at the same time, from rows worked out once."""

import threading

from pyspark.sql import functions as F

from stratalith.operators import models as M


def test_folds_at_once_from_kept_rows(spark, monkeypatch):
    meet, real, plans = threading.Barrier(3, timeout=120), M.learner, []

    class Waits:
        def fit(self, data):
            plans.append(data._jdf.queryExecution().withCachedData().toString())
            meet.wait()
            return real("decisiontree").fit(data)

    monkeypatch.setattr(M, "learner", lambda name: Waits())
    x = (F.col("id") % 7).cast("double")
    rows = spark.range(90).select("id", (F.col("id") % 7 > 3).cast("string").alias("label"), F.array(x, x * x).alias("vec"), (F.col("id") % 3).cast("int").alias("fold"))
    done = M.cross_validate(rows, "any", 3)
    assert all("InMemoryRelation" in p for p in plans) and len(plans) == 3
    assert done.count() == 90 and done.filter("truth = predicted").count() == 90
