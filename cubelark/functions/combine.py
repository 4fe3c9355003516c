"""Null-safe combination of values, by the names that requests use."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from cubelark.cube import CubeError

#: Binary operations; NULL if either operand is.
OPERATIONS: dict[str, Callable[[Column, Column], Column]] = {
    "add": lambda a, b: a + b,
    "sum": lambda a, b: a + b,
    "ave": lambda a, b: a + b,
    "sqadd": lambda a, b: a + b * b,
    "sub": lambda a, b: a - b,
    "mul": lambda a, b: a * b,
    "div": lambda a, b: F.try_divide(a, b),
    "max": lambda a, b: F.when(a.isNotNull() & b.isNotNull(), F.greatest(a, b)),
    "min": lambda a, b: F.when(a.isNotNull() & b.isNotNull(), F.least(a, b)),
    "maxmag": lambda a, b: F.when(a.isNotNull() & b.isNotNull(), F.greatest(F.abs(a), F.abs(b))),
    "minmag": lambda a, b: F.when(a.isNotNull() & b.isNotNull(), F.least(F.abs(a), F.abs(b))),
    "eq": lambda a, b: F.when(a.isNotNull(), b),
}


def named(name: str) -> str:
    """The operation that a name means: names are told by their beginnings, except ``min``."""
    name = name.lower()
    if name in OPERATIONS:
        return name
    for known in sorted(OPERATIONS, key=len, reverse=True):
        if known != "min" and name.startswith(known):
            return known
    raise CubeError(f"unknown operation {name}")


def combine(name: str, a: Column, b: Column) -> Column:
    return OPERATIONS[named(name)](a, b)


def into(name: str, a: Column, b: Column) -> Column:
    """In-place form: only where both are valid, else ``a`` stays."""
    return F.coalesce(combine(name, a, b), a)


def fold(values: list[Column], name: str = "ave") -> Column:
    """Sum or mean of the valid ones of several values; NULL if none is."""
    total = reduce(lambda a, b: a + b, [F.coalesce(v, F.lit(0.0)) for v in values])
    count = reduce(lambda a, b: a + b, [v.isNotNull().cast("int") for v in values])
    return F.try_divide(total, count) if named(name) == "ave" else F.when(count > 0, total)
