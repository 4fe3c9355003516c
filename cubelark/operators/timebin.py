"""Binning of the time axis by calendar cycles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cubelark.cube import Cube, CubeError
from cubelark.functions.calendar import bin_item, cycle_bin, general_cycle
from cubelark.operators.reduce import aggregate, reduced_axes


def _start(cube: Cube):
    """The first time of the whole dataset, as a scalar subquery."""
    return cube.df.agg(F.min("t").alias("start")).scalar()


def binned(cube: Cube, cycle: str = "hour", step: str = "month", operation: str = "average", start=None) -> DataFrame:
    """``bin, item`` and values: one row for each place in the cycle and item of the series, over all other axes."""
    if "t" not in cube.axes:
        raise CubeError("binning needs a time axis")
    start = _start(cube) if start is None else start
    keys = [cycle_bin(F.col("t"), cycle).alias("bin"), bin_item(F.col("t"), step, start).alias("item")]
    return cube.df.groupBy(*keys).agg(*(aggregate(operation, F.col(v)).alias(v) for v in cube.values))


def as_series(frame: DataFrame, value: str, bins: int) -> DataFrame:
    """The array form: a column for each bin, a row for each item."""
    return frame.groupBy("item").pivot("bin", list(range(bins))).agg(F.first(value))


def time_bin(cube: Cube, axes: str = "t", unit: str = "month", period: int = 1, mod: int = 12, offset: int = 0) -> Cube:
    """Mean by place in a cycle of ``mod`` steps of ``period`` units; by default by month of the year.

    The bin takes the place of the time axis.
    """
    over = reduced_axes(cube, axes)
    if "t" not in over:
        raise CubeError("timeBin reduces the time axis")
    plain = unit.lower().startswith("month") and (period, mod, offset) == (1, 12, 0)
    place = F.month("t") - 1 if plain else general_cycle(F.col("t"), unit, period, mod, offset, _start(cube))
    keep = [a for a in cube.axes if a not in over]
    df = cube.df.groupBy(place.alias("bin"), *keep).agg(*(F.avg(v).alias(v) for v in cube.values))
    return Cube(df.withColumnRenamed("bin", "t"), ("t", *keep), cube.values)
