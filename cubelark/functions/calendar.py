"""Calendar fields of the time axis as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cubelark.cube import CubeError

#: Month initials from January on, twice, in which a season's name is looked up.
MONTH_INITIALS = "JFMAMJJASONDJFMAMJJASOND"


def season(t: Column) -> Column:
    """0 for December to February, 1 for March to May, 2 for June to August, 3 for September to November."""
    return F.floor((F.month(t) % 12) / 3).cast("int")


def season_months(name: str) -> list[int]:
    """The months, 1 to 12 in season order, of a season called by initials such as DJF."""
    at = MONTH_INITIALS.find(name.upper())
    if not name or at < 0 or len(name) > 12:
        raise CubeError(f"unknown season {name}")
    return [(at + i) % 12 + 1 for i in range(len(name))]


def season_year(t: Column, name: str) -> Column:
    """The year in which the season began: January and February of DJF belong to the year before."""
    months = season_months(name)
    turned = months[months.index(1) :] if 1 in months and months[0] != 1 else []
    return F.year(t) - F.when(F.month(t).isin(turned), 1).otherwise(0) if turned else F.year(t)


def cycle_bin(t: Column, cycle: str) -> Column:
    """Place in a cycle: hour of the day, month of the year from 0, or season."""
    cycle = cycle.lower()
    if cycle.startswith(("diurnal", "hour")):
        return F.hour(t)
    if cycle.startswith("month"):
        return F.month(t) - 1
    if cycle.startswith("season"):
        return season(t)
    raise CubeError(f"unknown cycle {cycle}")


def bin_item(t: Column, step: str, start: Column) -> Column:
    """Number of the month or year since ``start``, month of the year for ``monthof``, else one item."""
    step = step.lower()
    if step.startswith("monthof"):
        return F.month(t) - 1
    if step.startswith("month"):
        return (F.year(t) - F.year(start)) * 12 + F.month(t) - F.month(start)
    if step.startswith("year"):
        return F.year(t) - F.year(start)
    return F.lit(0)


def general_cycle(t: Column, unit: str, period: int, mod: int, offset: int, start: Column) -> Column:
    """``((steps since start + offset) / period) % mod`` in units of years, months or days."""
    unit = unit.lower()
    if unit.startswith("year"):
        steps = F.year(t) - F.year(start)
    elif unit.startswith("month"):
        steps = bin_item(t, "month", start)
    elif unit.startswith("day"):
        steps = F.datediff(t, start)
    else:
        raise CubeError(f"unknown unit {unit}")
    return F.pmod(F.floor((steps + F.lit(offset)) / period), F.lit(mod)).cast("int")
