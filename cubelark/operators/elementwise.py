"""Point-wise operations on one, two or more inputs."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cubelark.cube import Cube, CubeError, merge
from cubelark.functions.combine import combine, fold, into

#: Means that are broadcast at most.
FEW = 1_000_000
#: Kernels of two inputs and the operation of each.
DUAL = {"min2": "min", "max2": "max", "sum2": "add", "diff2": "sub", "mult2": "mul", "div2": "div"}


def dual(name: str, a: Cube, b: Cube, out: str = "value") -> Cube:
    """``a op b`` in this order, by operation or kernel; the one with fewer axes is broadcast to the other's cells."""
    name = DUAL.get(name, name)
    if len(a.values) != 1 or len(b.values) != 1:
        raise CubeError(f"{name} takes two inputs of one variable each")
    (x,), (y,) = a.values, b.values
    if x == y and a.origin and a.origin == b.origin and a.df is b.df:
        return a.with_values({out: combine(name, F.col(x), F.col(x))})
    if x == y:
        b, y = b.with_values({"_other": F.col(y)}, origin=()), "_other"
    both = merge([a, b])
    return both.with_values({out: combine(name, F.col(x), F.col(y))})


def average(cubes: list[Cube], out: str = "value") -> Cube:
    """Mean of the valid ones of two or more inputs at each cell."""
    named = [c.with_values({f"_{i}_{v}": F.col(v) for v in c.values}) if len({id(x.df) for x in cubes}) > 1 else c for i, c in enumerate(cubes)]
    both = merge(named)
    if len(both.values) < 2:
        raise CubeError("an ensemble mean takes two inputs or more")
    return both.with_values({out: fold([F.col(v) for v in both.values])})


def scalar(name: str, cube: Cube, number: float) -> Cube:
    """``value op number`` where valid; ``eq`` sets the number."""
    return cube.with_values({v: combine(name, F.col(v), F.lit(float(number))) for v in cube.values})


def accumulate(name: str, a: Cube, b: Cube) -> Cube:
    """The in-place form: cells of ``a`` where ``b`` is missing stay as they are."""
    (x,), (y,) = a.values, b.values
    other = b.with_values({"_other": F.col(y)}, origin=())
    return Cube(a.df.join(other.df, list(other.axes), "left"), a.axes, (x, "_other")).with_values({x: into(name, F.col(x), F.col("_other"))})


def mapped(cube: Cube, function) -> Cube:
    """A column function of every value; NULL stays NULL."""
    return cube.with_values({v: F.when(F.col(v).isNotNull(), function(F.col(v))) for v in cube.values})


def anomaly(cube: Cube, axes: str = "t", by: Column | None = None) -> Cube:
    """Values less their mean over the axes, within each ``by`` if given.

    Where cells of several axes remain there are many small groups: one shuffle by these, no join. With one
    axis or none there may be few large groups: the means are aggregated in part before the shuffle, measured,
    and joined; up to ``FEW`` of them are broadcast.
    """
    keep = [a for a in cube.axes if a not in axes.lower()]
    if len(keep) > 1 or "x" in keep:
        window = Window.partitionBy(*keep, *([by] if by is not None else []))
        return cube.with_values({v: F.col(v) - F.avg(v).over(window) for v in cube.values})
    names = [*keep, *(["_by"] if by is not None else [])]
    df = cube.df if by is None else cube.df.withColumn("_by", by)
    means = df.groupBy(*(F.col(n).alias(f"_of_{n}") for n in names)).agg(*(F.avg(v).alias(f"_mean_{v}") for v in cube.values))
    if names:
        means = means.persist()
        means = F.broadcast(means) if means.limit(FEW + 1).count() <= FEW else means
        both = df.join(means, reduce(and_, (F.col(n).eqNullSafe(F.col(f"_of_{n}")) for n in names)))
    else:
        both = df.join(F.broadcast(means))  # one row
    return Cube(both, cube.axes, cube.values, cube.origin, cube.grid).with_values({v: F.col(v) - F.col(f"_mean_{v}") for v in cube.values})


def deviation(cube: Cube, axes: str = "t") -> Cube:
    """Root of the squared anomalies' sum over N - 1, N the number of cells: the fused form of average, difference and rms."""
    keep = tuple(a for a in cube.axes if a not in axes.lower())
    n = F.count("*")
    squares = lambda v: F.var_pop(v) * F.count(v)
    return Cube(cube.df.groupBy(*keep).agg(*(F.sqrt(F.try_divide(squares(v), n - 1)).alias(v) for v in cube.values)), keep, cube.values)


def by_bin(name: str, cube: Cube, bins: DataFrame, place: Column, value: str = "") -> Cube:
    """``v op bin's value``: the second operand is looked up by a bin of each cell, as for values against a cycle.

    ``bins`` has the columns ``bin`` and the values; ``place`` gives the bin of a cell.
    """
    v = value or cube.values[0]
    other = bins.select(F.col("bin").alias("_bin"), F.col(v).alias("_other"))
    df = cube.df.withColumn("_bin", place).join(other, "_bin", "left")
    return Cube(df, cube.axes, (v,)).with_values({v: combine(name, F.col(v), F.col("_other"))})


def overlay(a: Cube, b: Cube) -> Cube:
    """The values of both side by side on the cells that both have; of a name that both use, those of ``b``."""
    rest = tuple(v for v in a.values if v not in b.values)
    return merge([Cube(a.df.select(*a.axes, *rest), a.axes, rest), Cube(b.df, b.axes, b.values)]) if rest else b


def union(cubes: list[Cube]) -> Cube:
    """Slabs of one grid after another along time; the order of a long table doesn't matter."""
    first = cubes[0]
    for c in cubes[1:]:
        if (c.axes, c.values) != (first.axes, first.values):
            raise CubeError("slabs must have the same axes and values")
    df = first.df
    for c in cubes[1:]:
        df = df.unionByName(c.df)
    return Cube(df, first.axes, first.values)
