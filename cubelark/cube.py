"""The data model: a cube is a long DataFrame with axis columns ``t z y x`` and value columns.

Missing cells are NULL: what a source marks as missing, and NaN, becomes NULL at the scan, before any
aggregate. Values are computed in double precision.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field, replace
from functools import cached_property

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AXES = "tzyx"
#: The most steps of an axis whose coordinates may come to the driver.
AXIS_LIMIT = 5_000_000


class CubeError(ValueError):
    """A request that cannot be answered."""


def valid(value: Column, missing: float | None = None) -> Column:
    """The value in double precision; NULL if it is NaN or the missing value."""
    value = value.cast("double")
    ok = ~F.isnan(value)
    return F.when(ok if missing is None else ok & (value != F.lit(float(missing))), value)


class Grid:
    """The axes of a dataset, on which regions are found whatever was cut from it before; what was asked for is kept."""

    def __init__(self, df: DataFrame, axes: Iterable[str]):
        self.df, self.axes = df, tuple(axes)
        self._known: dict = {}

    def _once(self, key: tuple, find):
        if key not in self._known:
            self._known[key] = find()
        return self._known[key]

    def steps(self, axis: str) -> DataFrame:
        """The distinct coordinates of an axis."""
        if axis not in self.axes:
            raise CubeError(f"no axis {axis}: this cube has {''.join(self.axes)}")
        return self.df.select(axis).where(F.col(axis).isNotNull()).distinct()

    def coordinates(self, axis: str) -> np.ndarray:
        """The distinct coordinates of an axis, ascending; only those of up to ``AXIS_LIMIT`` steps come to the driver."""
        found = self._few(axis)
        if found is None:
            raise CubeError(f"axis {axis} has over {AXIS_LIMIT} steps")
        return found

    def _few(self, axis: str) -> np.ndarray | None:
        def find() -> np.ndarray | None:
            rows = self.steps(axis).limit(AXIS_LIMIT + 1).toArrow().column(0).to_numpy()
            return np.sort(rows) if len(rows) <= AXIS_LIMIT else None

        return self._once(("axis", axis), find)

    def between(self, axis: str, first: int, last: int) -> tuple[object, object] | None:
        """Coordinates of the first and last of some steps by their numbers, clipped to the axis; None if none is there."""
        if last < first or first < 0:
            return None
        known = self._few(axis)
        if known is not None:
            return (known[first], known[min(last, len(known) - 1)]) if first < len(known) else None
        at = lambda i: self.steps(axis).orderBy(axis).offset(i).limit(1).toArrow().column(0).to_numpy()
        low = at(first)
        if not len(low):
            return None
        high = at(last)
        return low[0], high[0] if len(high) else self.bounds(axis)[1]

    def bounds(self, axis: str) -> tuple:
        """The least and greatest coordinate; None and None of an empty axis."""
        return self._once(("bounds", axis), lambda: tuple(self.steps(axis).agg(F.min(axis), F.max(axis)).first()))

    def ends(self, axis: str) -> tuple[np.ndarray, np.ndarray]:
        """The two least and the two greatest coordinates."""
        known = self._few(axis)
        if known is not None:
            return known[:2], known[-2:]
        take = lambda c: np.sort(self.steps(axis).orderBy(c).limit(2).toArrow().column(0).to_numpy())
        return self._once(("ends", axis), lambda: (take(F.col(axis)), take(F.col(axis).desc())))

    def nearest(self, axis: str, values: tuple[float, float]) -> tuple:
        """The coordinates nearest to two values; the smaller one of two as near."""
        known = self._few(axis)
        if known is not None:
            return tuple(known[int(np.abs(known.astype(float) - v).argmin())] for v in values)
        near = lambda v: F.min_by(axis, F.struct(F.abs(F.col(axis) - F.lit(float(v))), F.col(axis)))
        return tuple(self.steps(axis).agg(*(near(v).alias(str(i)) for i, v in enumerate(values))).first())

    def floor(self, axis: str, value) -> object:
        """The greatest coordinate up to a value, which a literal column gives; None if there is none."""
        return self._once(("floor", axis, str(value)), lambda: self.df.where(F.col(axis) <= value).agg(F.max(axis)).first()[0])


@dataclass(frozen=True)
class Cube:
    """Axis letters in order, value columns, and the DataFrame that has them.

    ``origin`` says where rows came from: cubes of equal origin have the same cells row by row, so that
    their values can be put side by side without a join. ``grid`` is that of the dataset, where there is one.
    """

    df: DataFrame
    axes: tuple[str, ...]
    values: tuple[str, ...]
    origin: tuple = ()
    grid: Grid | None = field(default=None, compare=False)

    @staticmethod
    def scan(df: DataFrame, axes: dict[str, str | Column], values: Iterable[str | tuple[str, str | Column]], missing: float | None = None, origin: tuple = ()) -> Cube:
        """A cube over the columns of a table; ``axes`` maps letters to columns, in the order t z y x."""
        letters = tuple(a for a in AXES if a in axes)
        if set(axes) - set(AXES):
            raise CubeError(f"unknown axes {sorted(set(axes) - set(AXES))}")
        column = lambda c: F.col(c) if isinstance(c, str) else c
        named = [(v, v) if isinstance(v, str) else v for v in values]
        selected = [column(axes[a]).alias(a) for a in letters] + [valid(column(c), missing).alias(n) for n, c in named]
        df = df.select(*selected)
        return Cube(df, letters, tuple(n for n, _ in named), origin, Grid(df, letters))

    def with_values(self, values: dict[str, Column], origin: tuple | None = None) -> Cube:
        """The same cells with other value columns."""
        df = self.df.select(*self.axes, *(c.alias(n) for n, c in values.items()))
        return Cube(df, self.axes, tuple(values), self.origin if origin is None else origin, self.grid)

    def where(self, predicate: Column, mark: tuple) -> Cube:
        return replace(self, df=self.df.where(predicate), origin=(*self.origin, mark))

    @cached_property
    def own(self) -> Grid:
        """The axes of this cube's own cells."""
        return self.grid if self.grid is not None and self.grid.df is self.df else Grid(self.df, self.axes)

    def coordinates(self, axis: str) -> np.ndarray:
        """The distinct coordinates of an axis of this cube, ascending; an axis is small beside the cube."""
        return self.own.coordinates(axis)

    def extent(self, axes: str = "yx") -> dict[str, tuple]:
        """First and last coordinate of some axes: the bounding box of a grid."""
        own = [a for a in self.axes if a in axes]
        row = self.df.agg(*(f(a).alias(f"{a}_{n}") for a in own for n, f in (("lo", F.min), ("hi", F.max)))).first()
        return {a: (row[f"{a}_lo"], row[f"{a}_hi"]) for a in own}

    def ordered(self) -> DataFrame:
        """Rows in the order of the axes, for a sink."""
        return self.df.orderBy(*self.axes) if self.axes else self.df


def single(cube: Cube) -> Cube:
    """A cube without axes, which must be one row: more are an error when it runs, not cut."""
    one = F.when(F.count("*") <= 1, True).otherwise(F.raise_error(F.lit("an operand without axes has several rows")))
    df = cube.df.agg(one.alias("_one"), *(F.first(v).alias(v) for v in cube.values)).where("_one").drop("_one")
    return replace(cube, df=df)


def merge(cubes: list[Cube]) -> Cube:
    """One cube with the values of all, on the axes of the largest: inner, and broadcasting over axes that a cube lacks.

    Cubes of one origin need no join. Which side of a join is broadcast is left to its measured size.
    """
    if not cubes:
        raise CubeError("an operation needs an input")
    order = sorted(cubes, key=lambda c: -len(c.axes))
    out = order[0]
    if all(c.origin and c.origin == out.origin and c.df is out.df for c in cubes):
        names = list(dict.fromkeys(v for c in cubes for v in c.values))
        return Cube(out.df.select(*out.axes, *names), out.axes, tuple(names), out.origin, out.grid)
    for other in order[1:]:
        if set(other.axes) - set(out.axes):
            raise CubeError(f"axes {''.join(other.axes)} don't broadcast to {''.join(out.axes)}")
        clash = set(other.values) & set(out.values)
        if clash:
            raise CubeError(f"two inputs are called {sorted(clash)}: give them aliases")
        df = out.df.join(other.df, list(other.axes), "inner") if other.axes else out.df.join(F.broadcast(single(other).df))
        out = Cube(df.select(*out.axes, *out.values, *other.values), out.axes, (*out.values, *other.values), (), out.grid)
    return out
