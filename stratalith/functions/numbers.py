"""Columns over measured values: cleaning, sentinels, thresholds."""

from __future__ import annotations

import math

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

INF = float("inf")
# fixed values: what stands in for what can't be measured
MISSING, BEYOND = -666.0, 3.14
#: 29 thresholds from 0.01 up to 0.29, as 0.01 + i * 0.01 gives them.
THRESHOLDS = [0.01 + i * 0.01 for i in range(29)]


#: micrometres of a voxel along x, y and z, where nothing else is said
VOXEL = (0.13, 0.13, 0.5)


def voxel_dimensions(x: float | str, y: float | str, z: float | str) -> tuple[float, float, float]:
    """Three positive finite numbers, from numbers or texts; anything else is an error that names its axis."""
    found = []
    for axis, given in zip("xyz", (x, y, z), strict=True):
        try:
            value = float(given)
        except (TypeError, ValueError):
            value = math.nan
        if not 0 < value < INF:
            raise ValueError(f"the voxel's size along {axis} must be a positive number, not {given!r}")
        found.append(value)
    return tuple(found)


def clean(v: Column) -> Column:
    """NaN counts as missing; infinities stay."""
    return F.nanvl(v, F.lit(None).cast("double"))


def finite(v: Column) -> Column:
    """The value if it is finite, else null."""
    return F.when(~F.isnan(v) & (F.abs(v) != INF), v)


def as_number(text: Column) -> Column:
    """A text as a double, null if it is none; unlike a cast, `1d` is none."""
    return F.when(F.rlike(F.trim(text), F.lit(r"(?i)^[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?|inf|infinity|nan)$")), F.trim(text).try_cast("double"))


def impute(v: Column, *by: str) -> Column:
    """+inf becomes the largest finite value of its feature + 3.14; -inf and NaN become -666, as does all of a feature without finite values."""
    top = F.max(finite(v)).over(Window.partitionBy(*by))
    return F.when(v.isNull() | F.isnan(v) | (v == -INF) | top.isNull(), F.lit(MISSING)).when(v == INF, top + BEYOND).otherwise(v)


def impute_legacy(v: Column, *by: str) -> Column:
    """The older rule: only +inf is replaced (largest finite value + 3.14) and NaN becomes -666; -inf stays."""
    top = F.max(F.when(~F.isnan(v) & (v != INF), v)).over(Window.partitionBy(*by))
    return F.when(v.isNull() | F.isnan(v), F.lit(MISSING)).when(v == INF, top + BEYOND).otherwise(v)


def last_resort(v: Column) -> Column:
    """NaN -666, +inf 1000, -inf -1000: the final guard before scoring."""
    return F.when(v.isNull() | F.isnan(v), F.lit(MISSING)).when(v == INF, F.lit(1000.0)).when(v == -INF, F.lit(-1000.0)).otherwise(v)


def luma(r: Column, g: Column, b: Column) -> Column:
    return 0.2989 * r + 0.5870 * g + 0.1140 * b


def digitize(v: Column, top: Column, bins: int) -> Column:
    """Bin of v among bins - 1 edges evenly spaced from 0 to top + 1: edges at or below v."""
    step = (top + 1) / (bins - 2)
    return F.when(v < 0, F.lit(0)).otherwise(F.least(F.floor(v / step).cast("int") + 1, F.lit(bins - 1)))


def planned_fits(search: str, splits: int, draws: int = 0, grid: int = 0) -> int:
    """How many models a search fits."""
    return {"random": draws * splits, "grid": grid * splits}.get(search, 1)


# fixed values: bounds of arguments, low and high, and whether low itself is allowed
BOUNDS = {"threshold": (0, 1, False), "workers": (1, 64, True), "top": (1, 500, True)}


def bounded(name: str, value: float) -> float:
    """The value, if it lies within the bounds of its name; an error that names them if not."""
    low, high, closed = BOUNDS[name]
    if not (low <= value <= high if closed else low < value <= high):
        raise ValueError(f"{name} must be {'at least' if closed else 'above'} {low} and at most {high}, not {value}")
    return value
