"""Masked reductions against numpy, on cubes with NULL, NaN and sentinel cells."""

import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from cubelark.cube import Cube, CubeError
from cubelark.operators import reduce

TIMES = ["2000-01-01", "2000-02-01", "2000-03-01", "2000-04-01"]
MISSING = 1e15


def rows(cube: Cube, *keys: str) -> dict:
    return {tuple(r[k] for k in keys): r["v"] for r in cube.df.collect()}


def test_constant_means_are_one(cube):
    c = cube([1.0] * 48, TIMES)
    for axes in ("t", "xy", "tzyx", ""):
        assert {r["v"] for r in reduce.reduce_cube(c, "average", axes).df.collect()} == {1.0}


def test_holes_are_skipped(cube):
    values = [float(i) for i in range(48)]
    values[0], values[12], values[24] = None, math.nan, MISSING
    values[1] = values[13] = values[25] = values[37] = None  # a cell that is missing throughout
    c = cube(values, TIMES, missing=MISSING)
    found = rows(reduce.reduce_cube(c, "average", "t"), "y", "x")
    assert found[(-60.0, 0.0)] == 36.0
    assert found[(-60.0, 90.0)] is None
    assert rows(reduce.reduce_cube(c, "max", "t"), "y", "x")[(-60.0, 90.0)] is None
    assert rows(reduce.reduce_cube(c, "sum", "t"), "y", "x")[(60.0, 270.0)] == 11 + 23 + 35 + 47


def test_maximum_of_negatives(cube):
    c = cube([-float(i + 1) for i in range(48)], TIMES)
    assert reduce.reduce_cube(c, "max", "").df.first()["v"] == -1.0


def test_rms_counts_missing_cells_too(cube):
    values = [3.0, None, 4.0, None] * 12
    c = cube(values, TIMES)
    squares = 12 * 9 + 12 * 16
    assert reduce.reduce_cube(c, "rms", "").df.first()["v"] == pytest.approx(math.sqrt(squares / 47))
    assert reduce.reduce_cube(c, "rms", "", count="valid").df.first()["v"] == pytest.approx(math.sqrt(squares / 23))
    one = cube([2.0], TIMES[:1], y=(0.0,), x=(0.0,))
    assert reduce.reduce_cube(one, "rms", "").df.first()["v"] is None


def test_weights(cube):
    c = cube([float(i) for i in range(12)], TIMES[:1])
    w = np.cos(np.radians([-60, 0, 60])).repeat(4)
    assert reduce.reduce_cube(c, "average", "yx", "cosine").df.first()["v"] == pytest.approx(np.average(np.arange(12), weights=w))
    area = (np.sin(np.radians([-30, 30, 90])) - np.sin(np.radians([-90, -30, 30]))).repeat(4)
    assert reduce.reduce_cube(c, "average", "yx", "area").df.first()["v"] == pytest.approx(np.average(np.arange(12), weights=area))


def test_unknown_axes_and_reductions(cube):
    c = cube([1.0] * 12, TIMES[:1])
    with pytest.raises(CubeError):
        reduce.reduce_cube(c, "average", "q")
    with pytest.raises(CubeError):
        reduce.reduce_cube(c, "mode", "t")


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.none(), st.floats(-1e3, 1e3)), min_size=24, max_size=24), st.sampled_from(["t", "y", "x", "ty", "yx", "tyx"]), st.sampled_from(["max", "min", "sum", "average", "std", "var", "ptp"]))
def test_against_masked_arrays(cube, values, axes, name):
    c = cube(values, TIMES, y=(-45.0, 45.0), x=(0.0, 120.0, 240.0))
    array = np.ma.masked_invalid(np.array([math.nan if v is None else v for v in values], float).reshape(4, 1, 2, 3))
    numpy = {"max": np.ma.max, "min": np.ma.min, "sum": np.ma.sum, "average": np.ma.mean, "std": np.ma.std, "var": np.ma.var, "ptp": np.ma.ptp}[name]
    want = np.ma.masked_array(numpy(array.transpose(*["tzyx".index(a) for a in "tzyx" if a not in axes], *["tzyx".index(a) for a in axes]).reshape(*[n for a, n in zip("tzyx", (4, 1, 2, 3), strict=True) if a not in axes], -1), axis=-1))
    keep = [a for a in "tzyx" if a not in axes]
    found = [r["v"] for r in reduce.reduce_cube(c, name, axes).df.orderBy(*keep).collect()]
    for f, w in zip(found, want.reshape(-1).tolist(), strict=True):
        assert (f is None and w is None) or f == pytest.approx(w, rel=1e-9, abs=1e-6)
