"""Point-wise operations: missing operands, argument order, broadcasting, ensembles and anomalies."""

import pytest
from pyspark.sql import functions as F

from cubelark.cube import Cube, CubeError, merge
from cubelark.functions.combine import named
from cubelark.operators import elementwise, reduce

TIMES = ["2000-01-01", "2000-02-01"]
GRID = {"y": (0.0,), "x": (0.0, 90.0)}


def values(cube: Cube, name: str) -> list:
    return [r[name] for r in cube.ordered().collect()]


def test_missing_operands_give_missing(cube):
    a = cube([1.0, None, 3.0, 4.0], TIMES, **GRID, name="a")
    b = cube([10.0, 20.0, None, 0.0], TIMES, **GRID, name="b")
    assert values(elementwise.dual("sum2", a, b), "value") == [11.0, None, None, 4.0]
    assert values(elementwise.dual("min2", a, b), "value") == [1.0, None, None, 0.0]
    assert values(elementwise.dual("div2", a, b), "value") == [0.1, None, None, None]
    assert values(elementwise.accumulate("add", a, b), "a") == [11.0, None, 3.0, 4.0]
    assert values(elementwise.average([a, b]), "value") == [5.5, 20.0, 3.0, 2.0]


def test_order_of_arguments_is_kept_when_broadcasting(cube):
    a = cube([1.0, 2.0, 5.0, 6.0], TIMES, **GRID, name="a")
    mean = reduce.reduce_cube(a, "average", "t").with_values({"m": F.col("a")})
    assert values(elementwise.dual("diff2", a, mean), "value") == [-2.0, -2.0, 2.0, 2.0]
    assert values(elementwise.dual("diff2", mean, a), "value") == [2.0, 2.0, -2.0, -2.0]


def test_equal_names_and_axis_free_operand(cube):
    a = cube([1.0, 2.0, 5.0, 6.0], TIMES, **GRID, name="a")
    b = cube([1.0, 1.0, 1.0, 1.0], TIMES, **GRID, name="a")
    assert values(elementwise.dual("sum2", a, Cube(b.df, b.axes, b.values)), "value") == [2.0, 3.0, 6.0, 7.0]
    total = reduce.reduce_cube(a, "sum", "")
    assert values(elementwise.dual("div2", a, total), "value") == pytest.approx([1 / 14, 2 / 14, 5 / 14, 6 / 14])


def test_axes_that_dont_fit(cube):
    a = cube([1.0, 2.0, 5.0, 6.0], TIMES, **GRID, name="a")
    t, x = reduce.reduce_cube(a, "sum", "zyx"), reduce.reduce_cube(a, "sum", "tzy")
    with pytest.raises(CubeError):
        merge([t, x.with_values({"b": x.df["a"]})])


def test_anomaly_and_deviation(cube):
    a = cube([1.0, 2.0, 5.0, None], TIMES, **GRID, name="a")
    assert values(elementwise.anomaly(a), "a") == [-2.0, 0.0, 2.0, None]
    fused = elementwise.deviation(a, "t")
    assert values(fused, "a") == [pytest.approx(8**0.5), 0.0]


def test_union_needs_one_grid(cube):
    a = cube([1.0, 2.0], TIMES[:1], **GRID, name="a")
    b = cube([3.0, 4.0], TIMES[1:], **GRID, name="a")
    assert values(elementwise.union([a, b]), "a") == [1.0, 2.0, 3.0, 4.0]
    with pytest.raises(CubeError):
        elementwise.union([a, cube([1.0, 2.0], TIMES[:1], **GRID, name="b")])


def test_names_are_told_by_their_beginnings():
    assert [named(n) for n in ("subt", "average", "multiply", "min", "sqAdd")] == ["sub", "ave", "mul", "min", "sqadd"]
    for wrong in ("minus", "power"):
        with pytest.raises(CubeError):
            named(wrong)


def test_values_against_a_cycle(cube):
    from cubelark.operators import timebin

    a = cube([1.0, 2.0, 5.0, None], TIMES, **GRID, name="a")
    cycle = timebin.binned(a, "month", "all")
    assert values(elementwise.by_bin("sub", a, cycle, F.month("t") - 1), "a") == [-0.5, 0.5, 0.0, None]


def test_overlay_and_extent(cube):
    a = cube([1.0, 2.0, 3.0, 4.0], TIMES, **GRID, name="a")
    b = cube([5.0, 6.0, 7.0, 8.0], TIMES, **GRID, name="b")
    both = elementwise.overlay(a, b)
    assert both.values == ("a", "b") and values(both, "b") == [5.0, 6.0, 7.0, 8.0]
    assert values(elementwise.overlay(both, a), "a") == [1.0, 2.0, 3.0, 4.0]
    assert a.extent() == {"y": (0.0, 0.0), "x": (0.0, 90.0)}
