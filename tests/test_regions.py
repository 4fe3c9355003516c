"""Domains: indices, values, clipping, longitudes, seasons and masks."""

import numpy as np
import pytest

import cubelark.cube
from cubelark.cube import CubeError, Grid
from cubelark.functions.calendar import season_months
from cubelark.operators import reduce, subset
from cubelark.operators.subset import Domain, Range

MONTHS = [f"{1999 + (10 + i) // 12}-{(10 + i) % 12 + 1:02d}-22" for i in range(26)]


class Axis(Grid):
    """A grid with known axes."""

    def __init__(self, **axes):
        super().__init__(None, axes)
        self._known = {("axis", a): np.asarray(v) for a, v in axes.items()} | {("bounds", a): (v[0], v[-1]) for a, v in axes.items()}


def test_ranges_resolve_to_coordinates():
    grid = Axis(y=np.array([0.0, 10.0, 20.0, 30.0]))
    at = lambda s, e, how="values", a="y": subset.resolve(Range(a, s, e, how), grid)
    assert at(1, 99, "indices") == [(10.0, 30.0)]
    assert at(4, 9, "indices") == []
    assert at(9, 21) == at(21, 9) == [(10.0, 20.0)]
    assert at(-3, 50) == [(0.0, 30.0)]
    assert at(40, 50) == [] and at(-50, -10) == []


def test_longitudes_wrap_to_the_axis():
    east, both = Axis(x=np.arange(0.0, 360.0)), Axis(x=np.arange(-180.0, 180.0))
    at = lambda grid, s, e: subset.resolve(Range("x", s, e), grid)
    assert at(east, -90, -80) == [(270.0, 280.0)] and at(both, 200, 210) == [(-160.0, -150.0)]
    # over the seam: two ranges, not their complement
    assert at(east, -40, 40) == at(east, 320, 40) == [(320.0, 359.0), (0.0, 40.0)]
    assert at(both, 170, 190) == at(both, 170, -170) == [(170.0, 179.0), (-180.0, -170.0)]
    assert at(both, -40, 40) == [(-40.0, 40.0)] and at(east, 40, 320) == [(40.0, 320.0)] and at(east, 40, 10) == [(10.0, 40.0)]
    assert at(east, -180, 180) == at(east, 0, 360) == [(0.0, 359.0)] and at(both, 0, 360) == [(-180.0, 179.0)]
    assert at(Axis(x=np.arange(0.0, 91.0)), -10, 10) == [(0.0, 10.0)]


def test_regions_are_found_on_the_axis_of_the_dataset(cube, monkeypatch):
    days = [f"2000-01-{d:02d}" for d in range(1, 11)]
    c = cube([float(i) for i in range(10)], days, y=(0.0,), x=(0.0,))
    index = lambda a, b: Domain("d", (Range("t", a, b, "indices"),))
    values = lambda c: sorted(r["v"] for r in c.df.collect())
    for limit in (5_000_000, 3):  # also where the axis is too long for the driver
        monkeypatch.setattr(cubelark.cube, "AXIS_LIMIT", limit)
        c.grid._known.clear()
        twice = subset.cut(subset.cut(c, index(2, 6)), index(3, 4))
        assert values(twice) == [3.0, 4.0]
        assert values(subset.cut(subset.cut(c, index(2, 6)), index(6, 99))) == [6.0] and values(subset.cut(c, index(8, 99))) == [8.0, 9.0]
        assert values(subset.cut(c, index(10, 12))) == []
    # the step that contains the start belongs to a range of time
    time = lambda a, b: Domain("d", (Range("t", a, b),))
    assert values(subset.cut(c, time("2000-01-03T12:00", "2000-01-05T01:00"))) == [2.0, 3.0, 4.0]
    assert values(subset.cut(c, time("2000-01-03T12:00", "2000-01-03T12:00"))) == [2.0]
    assert values(subset.cut(c, time("1999", "2000-01-02"))) == [0.0, 1.0]
    assert values(subset.cut(c, time("2001", "2002"))) == values(subset.cut(c, time("1998", "1999"))) == []


def test_values_on_a_long_axis(cube, monkeypatch):
    c = cube([float(i) for i in range(12)], ["2000-01-01"])
    want = [sorted(r["v"] for r in subset.cut(c, Domain("d", (Range("x", a, b),))).df.collect()) for a, b in ((-100, 10), (80, 200), (400, 500))]
    monkeypatch.setattr(cubelark.cube, "AXIS_LIMIT", 2)
    c.grid._known.clear()
    assert want == [sorted(r["v"] for r in subset.cut(c, Domain("d", (Range("x", a, b),))).df.collect()) for a, b in ((-100, 10), (80, 200), (400, 500))]


def test_cut_pushes_a_predicate(cube):
    c = cube([float(i) for i in range(24)], ["2000-01-01", "2000-02-01"])
    cut = subset.cut(c, Domain("d", (Range("y", -70, -50), Range("t", "2000-01-15", "2000-03-01"))))
    assert sorted(r["v"] for r in cut.df.collect()) == [0.0, 1.0, 2.0, 3.0, 12.0, 13.0, 14.0, 15.0]
    assert subset.cut(c, Domain("d", (Range("y", 80, 90), Range("x", 0, 10)))).df.count() in (0, 1, 2)
    with pytest.raises(CubeError):
        subset.cut(c, Domain("d", mask="#none"))


def test_seasons(cube):
    c = cube([float(i) for i in range(52)], MONTHS, y=(0.0,), x=(0.0, 90.0))
    djf = subset.seasons(c, "DJF")
    assert {r["t"].month for r in djf.df.collect()} == {12, 1, 2}
    whole = subset.seasons(c, "DJF", complete_only=True)
    assert whole.df.count() == 12  # December 2001 alone is no season
    assert season_months("DJF") == [12, 1, 2] and season_months("JJAS") == [6, 7, 8, 9]
    with pytest.raises(CubeError):
        subset.seasons(c, "XYZ")


def test_masks(cube, spark):
    c = cube([1.0] * 12, ["2000-01-01"])
    square = [(-10.0, -70.0), (100.0, -70.0), (100.0, 10.0), (-10.0, 10.0)]
    cut = subset.cut(c, Domain("d", mask="#square"), {"square": square})
    assert reduce.reduce_cube(cut, "count", "").df.first()["v"] == 4
    table = spark.createDataFrame([(0.0, 90.0), (0.0, 90.0)], "y double, x double")
    cut = subset.cut(c, Domain("d", mask="#table"), {"table": table})
    assert reduce.reduce_cube(cut, "count", "").df.first()["v"] == 1


def test_containment():
    outer = Domain("o", (Range("t", "2000-01-01", "2000-12-31"),))
    assert subset.contains(outer, Domain("i", (Range("t", "2000-02-01", "2000-03-01"), Range("y", 0, 1))))
    assert not subset.contains(outer, Domain("i", (Range("t", "1999-02-01", "2000-03-01"),)))
    assert not subset.contains(outer, Domain("i"))
    assert subset.intersect((1, 5), (4, 9)) == (4, 5) and subset.intersect((1, 2), (3, 4)) is None


def test_dates():
    assert subset.moment("2000") == np.datetime64("2000-01-01")
    assert subset.moment("2000-03-04 05:06") == np.datetime64("2000-03-04T05:06")
    assert subset.moment(86400) == np.datetime64("1970-01-02")
    assert subset.moment("5 January 2000 12:30") == subset.moment("Jan 5, 2000 12:30") == np.datetime64("2000-01-05T12:30")
    assert subset.moment("March 2001") == np.datetime64("2001-03-01") and subset.moment("2000-01-05T12:30+02:00") == np.datetime64("2000-01-05T10:30")
    for text in ("next week", "12:30", "5 January"):
        with pytest.raises(CubeError):
            subset.moment(text)
