"""Reductions over any set of axes: partial and final aggregates by the remaining ones."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cubelark.cube import Cube, CubeError
from cubelark.functions.weights import area_weight, cosine_weight


def reduced_axes(cube: Cube, axes: str) -> tuple[str, ...]:
    """The letters of ``axes``, in any case; none means all. Letters that the cube lacks are left out."""
    letters = axes.lower() or "".join(cube.axes)
    if set(letters) - set("tzyx"):
        raise CubeError(f"unknown axes {axes}")
    return tuple(a for a in cube.axes if a in letters)


def _rms(v: Column, n: Column) -> Column:
    return F.sqrt(F.try_divide(F.sum(v * v), n - 1))


#: Aggregates by kernel name. ``n`` is the number of cells, missing ones too unless asked otherwise.
AGGREGATES = {
    "max": lambda v, n: F.max(v),
    "min": lambda v, n: F.min(v),
    "sum": lambda v, n: F.sum(v),
    "rmsum": lambda v, n: F.sqrt(F.try_divide(F.sum(v), n - 1)),
    "rms": _rms,
    "average": lambda v, n: F.avg(v),
    "std": lambda v, n: F.stddev_pop(v),
    "var": lambda v, n: F.var_pop(v),
    "ptp": lambda v, n: F.max(v) - F.min(v),
    "maxmag": lambda v, n: F.max(F.abs(v)),
    "minmag": lambda v, n: F.min(F.abs(v)),
    "mean": lambda v, n: F.try_divide(F.sum(v), n),
    "count": lambda v, n: F.count(v),
}


def aggregate(name: str, value: Column, count: str = "cells") -> Column:
    """The aggregate of that name; ``count`` is what N means in rms, rmsum and mean: cells or valid ones."""
    if name.lower() not in AGGREGATES:
        raise CubeError(f"unknown reduction {name}")
    return AGGREGATES[name.lower()](value, F.count("*") if count == "cells" else F.count(value))


def cell_edges(cube: Cube, axis: str, low: float | None, high: float | None) -> DataFrame:
    """The steps of an axis with the edges of their cells, half-way between neighbours and clipped.

    The steps, not the cells, of an axis are sorted in one task.
    """
    order = Window.orderBy(axis)
    before, after, own = F.lag(axis).over(order), F.lead(axis).over(order), F.col(axis)
    half = lambda other: (own + other) / 2
    lo = F.coalesce(half(before), own - (half(after) - own), own - 0.5)
    hi = F.coalesce(half(after), own + (own - half(before)), own + 0.5)
    clip = lambda c: c if low is None else F.least(F.greatest(c, F.lit(low)), F.lit(high))
    return cube.own.steps(axis).select(axis, clip(lo).alias(f"{axis}_lo"), clip(hi).alias(f"{axis}_hi"))


def weight_column(cube: Cube, weights: str, axes: tuple[str, ...]) -> tuple[Cube, Column | None]:
    """The cube, with what the weights need, and the weights: none, ``cosine`` of latitude, or ``area``."""
    kind = (weights or "").lower()
    if kind in ("", "none", "equal"):
        return cube, None
    if kind == "cosine":
        return (cube, cosine_weight(F.col("y"))) if "y" in axes else (cube, None)
    if kind in ("area", "generate"):
        if not {"x", "y"} & set(axes):
            return cube, None
        df, parts = cube.df, {"y_lo": F.lit(-90.0), "y_hi": F.lit(90.0), "x_lo": F.lit(0.0), "x_hi": F.lit(1.0)}
        for axis, low, high in (("y", -90.0, 90.0), ("x", None, None)):
            if axis in axes:
                # one row for each step of an axis; Spark broadcasts by its size
                df = df.join(cell_edges(cube, axis, low, high), axis)
                parts |= {f"{axis}_lo": F.col(f"{axis}_lo"), f"{axis}_hi": F.col(f"{axis}_hi")}
        return Cube(df, cube.axes, cube.values, cube.origin, cube.grid), area_weight(F.col("y"), parts["y_lo"], parts["y_hi"], parts["x_lo"], parts["x_hi"])
    raise CubeError(f"unknown weights {weights}")


def weighted_mean(value: Column, weight: Column) -> Column:
    """Mean over valid cells; NULL where their weights sum up to nothing."""
    return F.try_divide(F.sum(weight * value), F.sum(F.when(value.isNotNull(), weight)))


def reduce_cube(cube: Cube, name: str, axes: str = "", weights: str = "", count: str = "cells") -> Cube:
    """All values of a cube reduced over some axes; without axes, over all."""
    over = reduced_axes(cube, axes)
    keep = tuple(a for a in cube.axes if a not in over)
    weight = None
    if name.lower() in ("average", "sum") and weights:
        cube, weight = weight_column(cube, weights, over)
    if weight is not None:
        make = weighted_mean if name.lower() == "average" else lambda v, w: F.sum(v * w)
        found = [make(F.col(v), weight).alias(v) for v in cube.values]
    else:
        found = [aggregate(name, F.col(v), count).alias(v) for v in cube.values]
    return Cube(cube.df.groupBy(*keep).agg(*found), keep, cube.values, (), cube.grid)


def sum_and_count(cube: Cube, axes: str = "") -> Cube:
    """Two outputs for each input: the sum of valid cells and their number."""
    keep = tuple(a for a in cube.axes if a not in reduced_axes(cube, axes))
    found = [f for v in cube.values for f in (F.sum(v).alias(f"{v}_sum"), F.count(v).alias(f"{v}_count"))]
    return Cube(cube.df.groupBy(*keep).agg(*found), keep, tuple(f"{v}_{s}" for v in cube.values for s in ("sum", "count")))


def zonal_season_mean(cube: Cube, season: str = "DJF") -> Cube:
    """Means over a season, months weighted by their days, then equally over longitude."""
    from cubelark.functions.calendar import season_months

    if "t" not in cube.axes:
        raise CubeError("a season needs a time axis")
    rows = cube.df.where(F.month("t").isin(season_months(season)))
    cell = [a for a in cube.axes if a != "t"]
    days = F.dayofmonth(F.last_day("t")).cast("double")
    monthly = rows.groupBy(*cell, F.year("t").alias("_year"), F.month("t").alias("_month")).agg(*(F.avg(v).alias(v) for v in cube.values), F.first(days).alias("_days"))
    means = monthly.groupBy(*cell).agg(*(weighted_mean(F.col(v), F.col("_days")).alias(v) for v in cube.values))
    keep = tuple(a for a in cell if a != "x")
    return Cube(means.groupBy(*keep).agg(*(F.avg(v).alias(v) for v in cube.values)), keep, cube.values)


def max_scaled_difference(a: Cube, b: Cube, value: str, other: str) -> Column:
    """Greatest absolute difference over the mean of ``a``, as a cube of one row."""
    from cubelark.cube import merge

    both = merge([a, b])
    return Cube(both.df.agg(F.try_divide(F.max(F.abs(F.col(value) - F.col(other))), F.avg(value)).alias("difference")), (), ("difference",))


def gaussian_latitudes(n: int) -> np.ndarray:
    """Latitudes of a Gaussian grid, from south to north."""
    return np.degrees(np.arcsin(np.polynomial.legendre.leggauss(n)[0]))
