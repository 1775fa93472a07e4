"""Kernels over rasters as relations: each image's pixels meet in one task, as an array."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions import kernels as K


def per_image(px: DataFrame, f: Callable[[np.ndarray], dict[str, np.ndarray]], schema: str, value: str = "v") -> DataFrame:
    """``f`` of each image's array gives columns of equal length; ``schema`` has their types. An image must fit a task."""
    def one(table: pa.Table) -> pa.Table:
        y, x, v = (table[c].to_numpy() for c in ("y", "x", value))
        a = np.zeros((int(y.max()) + 1, int(x.max()) + 1), bool if value == "b" else np.uint8)
        a[y, x] = v
        columns = f(a)
        n = len(next(iter(columns.values())))
        return pa.table({"img_id": pa.array([table["img_id"][0].as_py()] * n, table["img_id"].type), **{k: pa.array(c) for k, c in columns.items()}})

    kind = dict(px.dtypes)["img_id"]
    return px.select("img_id", "y", "x", value).groupBy("img_id").applyInArrow(one, f"img_id {kind}, {schema}")


def _pixels(a: np.ndarray, name: str) -> dict[str, np.ndarray]:
    y, x = np.indices(a.shape)
    return {"y": y.ravel().astype(np.int32), "x": x.ravel().astype(np.int32), name: a.ravel()}


def components(bits: DataFrame, eight: bool = True) -> DataFrame:
    """Bounding box (half-open) and size of each component, numbered by first pixel."""
    def f(a):
        labels, n = K.components(a, eight)
        t = K.component_table(labels, n)
        return {"label": np.arange(1, n + 1, dtype=np.int32), **{k: t[:, i] for i, k in enumerate(("x0", "y0", "x1", "y1", "n"))}}

    return per_image(bits, f, "label int, x0 long, y0 long, x1 long, y1 long, n long", "b")


def label_map(bits: DataFrame, eight: bool = True) -> DataFrame:
    return per_image(bits, lambda a: _pixels(K.components(a, eight)[0], "label"), "y int, x int, label int", "b")


def seed_fill(bits: DataFrame, seed: tuple[int, int], eight: bool = True) -> DataFrame:
    """The component of each image at a pixel (y, x), empty if that is white."""
    def f(a):
        start = np.zeros_like(a)
        start[seed] = True
        return _pixels(K.seed_fill(start, a, eight).astype(np.int32), "b")

    return per_image(bits, f, "y int, x int, b int", "b")


def distances(bits: DataFrame) -> DataFrame:
    """Squared distance of each pixel to the nearest black one; images without black give none."""
    def f(a):
        d = K.distance_map(a)[0] if a.any() else np.zeros((0, 0))
        return _pixels(d.astype(np.int64), "d")

    return per_image(bits, f, "y int, x int, d long", "b")


def despeckle(bits: DataFrame, dpi: int = 300, level: float = 2.0) -> DataFrame:
    return per_image(bits, lambda a: _pixels(K.despeckle(a, dpi, level).astype(np.int32), "b"), "y int, x int, b int", "b")


def binarize(px: DataFrame, method: str, window: int = 5) -> DataFrame:
    return per_image(px, lambda a: _pixels(K.binarize(a, method, window).astype(np.int32), "b"), "y int, x int, b int")
