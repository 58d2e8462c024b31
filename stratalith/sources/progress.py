"""Progress events: JSON objects on marked log lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "phase string, phase_index int, phase_total int, completed int, total int, detail string, sub_total int"


def parse(lines: DataFrame, column: str, mark: str) -> DataFrame:
    """Rows whose line holds a complete event (all counts present, total over 0), with its fields."""
    event = F.from_json(F.substring(column, len(mark) + 1, 1 << 30), SCHEMA)
    out = lines.filter(F.startswith(column, F.lit(mark))).withColumn("_e", event)
    whole = F.col("_e.phase").isNotNull() & F.col("_e.phase_index").isNotNull() & F.col("_e.phase_total").isNotNull() & F.col("_e.completed").isNotNull() & (F.col("_e.total") > 0)
    return out.filter(whole).select(*[c for c in lines.columns if c != column], "_e.*")
