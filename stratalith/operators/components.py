"""Connected components of layer images, where no SQL form holds: all thresholds of a layer in one pass over its pixels."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions import numbers as X
from ..shipping import ship
from ..sources.stacks import layer_rows


def _roots(parent: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The root of each place; the places point to it afterwards."""
    root = parent[at]
    while True:
        up = parent[root]
        if np.array_equal(up, root):
            parent[at] = root
            return root
        root = up


def _unite(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> int:
    """Joins the trees of all pairs (a, b); returns how many trees are fewer."""
    fewer = 0
    while True:
        a, b = _roots(parent, a), _roots(parent, b)
        apart = a != b
        if not apart.any():
            return fewer
        a, b = a[apart], b[apart]
        high, low = np.maximum(a, b), np.minimum(a, b)
        np.minimum.at(parent, high, low)  # a root hangs below a smaller one only, so no circle can arise
        fewer += len(np.unique(high))


def components_above(image: np.ndarray, thresholds: Sequence[float]) -> np.ndarray:
    """Number of 8-connected components of `image > t` for every ascending threshold.

    A pixel's level is the number of thresholds below it, an edge's the lower one of its two pixels. Edges are taken by falling level, so what is
    connected above one threshold stays so below: components = pixels - edges that joined two trees, both counted from the top down.
    """
    levels = np.searchsorted(np.asarray(thresholds, float), image, side="left")
    place = np.arange(image.size).reshape(image.shape)
    pairs = [(slice(None), slice(None, -1), slice(None), slice(1, None)), (slice(None, -1), slice(None), slice(1, None), slice(None)), (slice(None, -1), slice(None, -1), slice(1, None), slice(1, None)), (slice(None, -1), slice(1, None), slice(1, None), slice(None, -1))]
    low = np.concatenate([np.minimum(levels[r, c], levels[s, d]).ravel() for r, c, s, d in pairs])
    ends = [np.concatenate([place[x[i], x[i + 1]].ravel() for x in pairs]) for i in (0, 2)]
    order = np.argsort(low, kind="stable")
    cut = np.searchsorted(low[order], np.arange(1, len(thresholds) + 2))
    parent = np.arange(image.size)
    pixels = np.bincount(levels.ravel(), minlength=len(thresholds) + 1)
    found, held, joined = np.zeros(len(thresholds), np.int64), 0, 0
    for i in range(len(thresholds) - 1, -1, -1):
        now = order[cut[i] : cut[i + 1]]
        held += pixels[i + 1]
        if len(now):
            joined += _unite(parent, ends[0][now], ends[1][now])
        found[i] = held - joined
    return found


def count_components(on: np.ndarray) -> int:
    """Number of 8-connected components of a boolean image."""
    return int(components_above(np.asarray(on, float), [0.5])[0])


def relative_components(image: np.ndarray, thresholds: Sequence[float]) -> np.ndarray:
    """Components of `image / max(image) > t`. An image of zeros is one component throughout, as 0 / 0 is no number and isn't cut."""
    top = image.max()
    return np.ones(len(thresholds), np.int64) if top == 0 else components_above(image / top, thresholds)


def centre(image: np.ndarray) -> np.ndarray:
    """(v - mean) / (max - min); a flat image is all zeros, which counts as no number."""
    spread = image.max() - image.min()
    return np.zeros_like(image, dtype=float) if spread == 0 else (image - image.mean()) / spread


def layer_components(layers: DataFrame, thresholds: Sequence[float] = tuple(X.THRESHOLDS), centred: bool = False) -> DataFrame:
    """(sample_name, z, i, components) of layers (sample_name, z, height, width, pixels array), or of pixels (sample_name, z, x, y, v): components above each threshold of the layer by its largest pixel, centred before if asked."""
    ship(layers.sparkSession)
    layers = layers if "pixels" in layers.columns else layer_rows(layers)
    levels = [float(t) for t in thresholds]

    def run(batches):
        for batch in batches:
            names, zs, heights, widths = (batch.column(k).to_pylist() for k in range(4))
            found = []
            for k in range(batch.num_rows):
                image = np.asarray(batch.column(4)[k].values, float).reshape(heights[k], widths[k])
                found.append(relative_components(centre(image) if centred else image, levels))
            if found:
                n = len(levels)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.asarray(names, object), n)), pa.array(np.repeat(np.asarray(zs, np.int64), n)), pa.array(np.tile(np.arange(n, dtype=np.int32), len(found))), pa.array(np.concatenate(found))], names=["sample_name", "z", "i", "components"])

    return layers.select("sample_name", "z", "height", "width", "pixels").mapInArrow(run, "sample_name string, z long, i int, components long")
