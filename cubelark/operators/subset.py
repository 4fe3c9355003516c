"""Regions of interest: ranges of axes by value or index, seasons and masks, as pushed-down predicates."""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import UTC, datetime
from functools import reduce
from operator import or_

import numpy as np
from dateutil import parser
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cubelark.cube import Cube, CubeError, Grid
from cubelark.functions.calendar import season_months, season_year

#: Beginnings of axis names in requests and the axis that each means.
AXIS_NAMES = (("lat", "y"), ("lon", "x"), ("lev", "z"), ("plev", "z"), ("tim", "t"))


def axis_letter(name: str) -> str | None:
    return next((letter for start, letter in AXIS_NAMES if name.lower().startswith(start)), None)


@dataclass(frozen=True)
class Range:
    """A closed range of an axis, by coordinate values or by indices."""

    axis: str
    start: object
    end: object
    system: str = "values"


@dataclass(frozen=True)
class Domain:
    """Ranges, a mask's name and further metadata of a region."""

    name: str
    ranges: tuple[Range, ...] = ()
    mask: str | None = None
    metadata: tuple[tuple[str, str], ...] = ()

    def get(self, key: str) -> str | None:
        return dict(self.metadata).get(key)


def moment(value: object) -> np.datetime64:
    """A time from an ISO date, a partial date, a date in words with its year, or seconds since 1970."""
    if isinstance(value, int | float):
        return np.datetime64(int(value * 1_000_000), "us")
    text = str(value).strip().rstrip("Z").replace(" ", "T", 1)
    for pattern in (r"\d{4}(-\d{2}(-\d{2})?)?$", r"\d{4}-\d{2}-\d{2}T\d{2}(:\d{2}(:\d{2}(\.\d+)?)?)?$"):
        if re.match(pattern, text):
            return np.datetime64(text).astype("datetime64[us]")
    try:
        found, again = (parser.parse(str(value), default=datetime(year, 1, 1)) for year in (2000, 2004))
    except (ValueError, OverflowError):
        raise CubeError(f"not a date: {value}") from None
    if found.year != again.year:
        raise CubeError(f"a date without a year: {value}")
    if found.tzinfo:
        found = found.astimezone(UTC).replace(tzinfo=None)
    return np.datetime64(found, "us")


def wrapped(value: float, low: float, high: float) -> float:
    """A longitude in the convention of an axis from ``low`` to ``high``: 0 to 360, or -180 to 180."""
    if value < 0 and low >= 0:
        return value + 360
    if value > 180 and high <= 180:
        return value - 360
    return value


def resolve(r: Range, grid: Grid) -> list[tuple[object, object]]:
    """First and last coordinates of a range on a dataset's axis: none, one, or two where longitudes pass the axis' seam."""
    if r.system.startswith("ind"):
        found = grid.between(r.axis, int(r.start), int(r.end))
        return [found] if found else []
    if r.axis == "t":
        lo, hi = moment(r.start), moment(r.end)
        first, last = (np.datetime64(x, "us") if x is not None else None for x in grid.bounds("t"))
        if first is None or lo > last or hi < first or lo > hi:
            return []
        # the step that contains a moment begins at or before it
        step = grid.floor("t", _literal(lo)) if lo > first else None
        return [(np.datetime64(step, "us") if step is not None else lo, hi)]
    lo, hi = float(r.start), float(r.end)
    (low, *after), (*before, high) = map(np.ndarray.tolist, grid.ends(r.axis)) if grid.bounds(r.axis)[0] is not None else ([None], [None])
    if low is None:
        return []
    parts = [(min(lo, hi), max(lo, hi))]
    if r.axis == "x":
        lo, hi, whole = wrapped(lo, low, high), wrapped(hi, low, high), abs(hi - lo) >= 360
        if whole:
            parts = [(float(low), float(high))]
        elif lo <= hi:
            parts = [(lo, hi)]
        elif float(r.start) <= float(r.end) or float(r.start) - float(r.end) > 180:  # over the seam
            parts = [(lo, float("inf")), (float("-inf"), hi)]
        else:
            parts = [(hi, lo)]
    low_edge = low - (after[0] - low) / 2 if after else low
    high_edge = high + (high - before[-1]) / 2 if before else high
    out = []
    for a, b in parts:
        if a <= high_edge and b >= low_edge:
            out.append(grid.nearest(r.axis, (max(a, low), min(b, high))))
    return out


def _literal(value: object) -> Column:
    if isinstance(value, np.datetime64):
        return F.lit(value.astype("datetime64[us]").astype(datetime))
    return F.lit(value.item() if isinstance(value, np.generic) else value)


def cut(cube: Cube, domain: Domain, masks: dict[str, object] | None = None) -> Cube:
    """The cells of a domain. Ranges become predicates on axis columns, which reach the scan.

    They are found on the axes of the dataset, whatever else was cut from it: several regions are their
    intersection, by indices too.
    """
    grid = cube.grid or cube.own
    for r in domain.ranges:
        if r.axis not in cube.axes:
            continue
        found = resolve(r, grid if r.axis in grid.axes else cube.own)
        predicate = reduce(or_, [F.col(r.axis).between(_literal(a), _literal(b)) for a, b in found]) if found else F.lit(False)
        cube = cube.where(predicate, ("range", r.axis, str(r.start), str(r.end), r.system))
    if domain.mask:
        name = domain.mask.lstrip("#")
        if name not in (masks or {}):
            raise CubeError(f"unknown mask {domain.mask}")
        cube = masked(cube, masks[name], name)
    return cube


def inside(y: Column, x: Column, polygon: list[tuple[float, float]]) -> Column:
    """Whether a point is inside a polygon of (lon, lat) corners, by counting crossed edges."""
    crossings = F.lit(0)
    for (x1, y1), (x2, y2) in zip(polygon, [*polygon[1:], polygon[0]], strict=True):
        if y1 != y2:
            at = (y - y1) * ((x2 - x1) / (y2 - y1)) + x1
            crossings = crossings + (((y < y1) != (y < y2)) & (x < at)).cast("int")
    return crossings % 2 == 1


def masked(cube: Cube, mask: object, name: str) -> Cube:
    """Values outside the mask become missing: a polygon, a table of the cells (y, x) inside, or a function that gives such a table for a cube."""
    if callable(mask):
        mask = mask(cube)
    if isinstance(mask, DataFrame):
        df = cube.df.join(mask.select("y", "x").distinct().withColumn("_in", F.lit(True)), ["y", "x"], "left")
        ok = F.col("_in")
    else:
        df, ok = cube.df, inside(F.col("y"), F.col("x"), list(mask))
    return Cube(df, cube.axes, cube.values, (*cube.origin, ("mask", name)), cube.grid).with_values({v: F.when(ok, F.col(v)) for v in cube.values})


def seasons(cube: Cube, names: str, complete_only: bool = False) -> Cube:
    """The months of some seasons; only whole ones (all months of a season's year) if asked."""
    if "t" not in cube.axes:
        raise CubeError("a season needs a time axis")
    picked = [n.strip() for n in names.split(",") if n.strip()]
    months = sorted({m for n in picked for m in season_months(n)})
    out = cube.where(F.month("t").isin(months), ("season", names))
    if complete_only:
        for n in picked:
            own = season_months(n)
            year = season_year(F.col("t"), n)
            full = out.df.where(F.month("t").isin(own)).groupBy(year.alias("_year")).agg(F.count_distinct(F.month("t")).alias("n")).where(F.col("n") == len(own)).select("_year")
            rest = out.df.where(~F.month("t").isin(own))
            kept = out.df.where(F.month("t").isin(own)).withColumn("_year", year).join(full, "_year", "left_semi").drop("_year")
            out = Cube(rest.unionByName(kept), out.axes, out.values, (*out.origin, "whole"), out.grid)
    return out


def sample(cube: Cube, n: int) -> DataFrame:
    """The first n cells in the order of the axes."""
    return cube.df.orderBy(*cube.axes).limit(n)


def intersect(a: tuple[object, object], b: tuple[object, object]) -> tuple[object, object] | None:
    """The common part of two closed ranges."""
    lo, hi = max(a[0], b[0]), min(a[1], b[1])
    return (lo, hi) if lo <= hi else None


def enclosing(a: tuple[object, object], b: tuple[object, object]) -> tuple[object, object]:
    """The smallest closed range that holds both."""
    return min(a[0], b[0]), max(a[1], b[1])


def contains(outer: Domain, inner: Domain) -> bool:
    """Whether every cell of ``inner`` is one of ``outer``: what lets a cached region answer for a smaller one."""
    if outer.mask and outer.mask != inner.mask:
        return False
    own = {r.axis: r for r in inner.ranges}
    for r in outer.ranges:
        i = own.get(r.axis)
        if i is None or i.system != r.system:
            return False
        if r.axis == "x" and not r.system.startswith("ind") and (r.start, r.end) != (i.start, i.end):
            # longitudes turn round: only ranges in the order of the same turn are compared
            if not 0 <= float(r.start) <= float(r.end) <= 180 or not 0 <= float(i.start) <= float(i.end):
                return False
        order = (lambda v: moment(v)) if r.axis == "t" and not r.system.startswith("ind") else float
        if order(i.start) < order(r.start) or order(i.end) > order(r.end):
            return False
    return True
