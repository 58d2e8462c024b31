"""The features a model takes, as a stage that is saved with it: some places of the vector, then its projection on singular vectors."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml import Transformer
from pyspark.ml.functions import array_to_vector
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship


class ReduceFeatures(Transformer, MLReadable, MLWritable):
    """Adds `features`, a vector of what is taken of the array `vec`: all of it, or its `places`; projected on the columns of `matrix` if there is one.

    The matrix (features x components) goes to the workers once and is saved as a table beside the stage's own data, so its size is no part of a plan.
    """

    def __init__(self, places: Sequence[int] | None = None, matrix: np.ndarray | None = None, vec: str = "vec", features: str = "features"):
        super().__init__()
        self.places = None if places is None else [int(p) for p in places]
        self.matrix = None if matrix is None else np.asarray(matrix, float)
        self.vec, self.features = vec, features

    def takes(self) -> int | None:
        """How many entries a vector must have, if that is known."""
        return None if self.matrix is None or self.places is not None else self.matrix.shape[0]

    def _transform(self, dataset: DataFrame) -> DataFrame:
        used = F.col(self.vec)
        if self.places is not None:
            used = F.transform(F.array(*[F.lit(p) for p in self.places]), lambda p: F.element_at(F.col(self.vec), p + 1))
        if self.matrix is not None:
            spark = dataset.sparkSession
            ship(spark)
            held = spark.sparkContext.broadcast(self.matrix)

            @F.pandas_udf("array<double>")
            def projected(column: pd.Series) -> pd.Series:
                return pd.Series(list(np.stack(column.to_list()) @ held.value) if len(column) else [])

            used = projected(used)
        return dataset.withColumn(self.features, array_to_vector(used))

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader(cls)


class _Writer(MLWriter):
    def __init__(self, stage: ReduceFeatures):
        super().__init__()
        self.stage = stage

    def saveImpl(self, path: str) -> None:
        s = self.stage
        DefaultParamsWriter.saveMetadata(s, path, self.sparkSession, extraMetadata={"places": s.places, "vec": s.vec, "features": s.features, "rows": None if s.matrix is None else len(s.matrix)})
        if s.matrix is not None:
            rows = [(i, row.tolist()) for i, row in enumerate(s.matrix)]
            self.sparkSession.createDataFrame(rows, "i int, row array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/matrix")


class _Reader(MLReader):
    def __init__(self, cls):
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> ReduceFeatures:
        meta = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        matrix = None
        if meta["rows"] is not None:
            matrix = np.array([r["row"] for r in self.sparkSession.read.parquet(f"{path}/matrix").orderBy("i").collect()])
        stage = self.cls(meta["places"], matrix, meta["vec"], meta["features"])
        stage._resetUid(meta["uid"])
        return stage
