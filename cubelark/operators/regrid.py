"""Bilinear regridding by two small tables of axis weights."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cubelark.cube import Cube, CubeError
from cubelark.operators.reduce import gaussian_latitudes


def axis_weights(source: np.ndarray, target: np.ndarray, wrap: float | None = None) -> list[tuple[float, float, float]]:
    """Linear weights (source, target, weight); outside the source's centres the nearest one, or around a circle."""
    source, target = np.sort(np.asarray(source, float)), np.asarray(target, float)
    known, labels = source, source
    if wrap and len(source) > 1:
        known, labels = np.r_[source[-1] - wrap, source, source[0] + wrap], np.r_[source[-1], source, source[0]]
    at = np.clip(np.searchsorted(known, target, "right") - 1, 0, max(len(known) - 2, 0))
    if len(known) == 1:
        return [(float(labels[0]), float(t), 1.0) for t in target]
    share = np.clip((target - known[at]) / (known[at + 1] - known[at]), 0, 1)
    out = []
    for t, i, w in zip(target.tolist(), at.tolist(), share.tolist(), strict=True):
        out += [(float(labels[j]), t, part) for j, part in ((i, 1 - w), (i + 1, w)) if part > 0]
    return out


def target_grid(crs: str, cubes: dict[str, Cube]) -> tuple[np.ndarray, np.ndarray]:
    """Latitudes and longitudes of ``gaussian~N``, or of the input ``~name``."""
    kind, mark, name = (crs or "").partition("~")
    if not mark:
        raise CubeError("a target grid is required: gaussian~N or ~variable")
    if kind.lower() == "gaussian":
        n = int(name)
        return gaussian_latitudes(n), np.arange(2 * n) * 180.0 / n
    if name not in cubes:
        raise CubeError(f"no input {name} has a grid")
    return cubes[name].coordinates("y"), cubes[name].coordinates("x")


def _table(spark: SparkSession, axis: str, rows: list[tuple[float, float, float]]) -> DataFrame:
    return spark.createDataFrame(rows, f"{axis} double, _{axis} double, _w{axis} double")


def regrid(cube: Cube, lats: np.ndarray, lons: np.ndarray) -> Cube:
    """Values on another grid; missing cells count for nothing, and a cell without valid neighbours is missing."""
    if not {"y", "x"} <= set(cube.axes):
        raise CubeError("regridding needs latitude and longitude")
    ys, xs = cube.coordinates("y"), cube.coordinates("x")
    if np.array_equal(ys, lats) and np.array_equal(xs, lons):
        return cube
    step = np.diff(np.sort(xs)).mean() if len(xs) > 1 else 360
    wrap = 360.0 if xs.max() - xs.min() + 1.5 * step >= 360 else None
    spark = cube.df.sparkSession
    # each table has two rows for each step of a target axis; Spark broadcasts by size
    df = cube.df.withColumn("y", F.col("y").cast("double")).withColumn("x", F.col("x").cast("double"))
    df = df.join(_table(spark, "y", axis_weights(ys, lats)), "y").join(_table(spark, "x", axis_weights(xs, lons, wrap)), "x")
    weight = F.col("_wy") * F.col("_wx")
    keep = [a for a in cube.axes if a in "tz"]
    found = [F.try_divide(F.sum(weight * F.col(v)), F.sum(F.when(F.col(v).isNotNull(), weight))).alias(v) for v in cube.values]
    df = df.groupBy(*keep, F.col("_y").alias("y"), F.col("_x").alias("x")).agg(*found)
    return Cube(df, (*keep, "y", "x"), cube.values)
