"""All queries of the library but those of optional subpackages."""

from __future__ import annotations

from . import benchmarks, estimators, extras, grids, learners, reports, tables  # noqa: F401  (register their queries)
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
