"""Calendar bins, resampling, regridding, and streams."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cubelark import streaming
from cubelark.cube import CubeError
from cubelark.operators import regrid, resample, timebin

HOURS = [f"2000-01-{30 + i // 24:02d}T{i % 24:02d}:00:00" if i < 48 else f"2000-02-01T{i % 24:02d}:00:00" for i in range(72)]


def test_diurnal_bins_over_a_month_boundary(cube):
    c = cube([float(i) for i in range(72)], HOURS, y=(0.0,), x=(0.0,))
    found = {(r["bin"], r["item"]): r["v"] for r in timebin.binned(c, "diurnal", "month").collect()}
    assert len(found) == 48
    assert found[(3, 0)] == 15.0 and found[(3, 1)] == 51.0


def test_bins_of_negatives_take_their_maximum(cube):
    c = cube([-float(i + 1) for i in range(72)], HOURS, y=(0.0,), x=(0.0,))
    found = {r["bin"]: r["v"] for r in timebin.binned(c, "hour", "all", "max").collect()}
    assert found[0] == -1.0
    with pytest.raises(CubeError):
        timebin.binned(c, "week")


def test_days_late_in_a_month_stay_in_it(cube):
    c = cube([1.0, 2.0, 3.0], ["2000-01-22", "2000-01-31", "2001-02-28"], y=(0.0,), x=(0.0,))
    assert {r["t"]: r["v"] for r in timebin.time_bin(c, "tyx").df.collect()} == {0: 1.5, 1: 3.0}
    quarters = timebin.time_bin(c, "tyx", period=3, mod=4)
    assert {r["t"]: r["v"] for r in quarters.df.collect()} == {0: pytest.approx(2.0)}


def test_resampling_is_linear_and_clamped(cube):
    a = cube([0.0, 10.0, None, 40.0], ["2000-01-01", "2000-01-11", "2000-01-21", "2000-01-31"], y=(0.0,), x=(0.0,))
    b = cube([0.0] * 5, ["1999-12-01", "2000-01-06", "2000-01-11", "2000-01-16", "2000-03-01"], y=(0.0,), x=(0.0,))
    found = [r["v"] for r in resample.resample(a, b).ordered().collect()]
    assert found == [0.0, 5.0, 10.0, None, 40.0]


def test_regridding_is_exact_for_linear_fields(cube):
    ys, xs = np.linspace(-80, 80, 5).tolist(), np.arange(0.0, 360.0, 45.0).tolist()
    c = cube([2 * y + 3 for y in ys for _ in xs], ["2000-01-01"], y=ys, x=xs)
    out = regrid.regrid(c, np.array([-50.0, 0.0, 37.0]), np.array([10.0, 350.0]))
    for r in out.df.collect():
        assert r["v"] == pytest.approx(2 * r["y"] + 3)
    assert regrid.regrid(c, np.array(ys), np.array(xs)) is c
    lats, lons = regrid.target_grid("gaussian~4", {})
    assert len(lats) == 4 and len(lons) == 8 and lats[0] == pytest.approx(-lats[3])
    with pytest.raises(CubeError):
        regrid.target_grid("", {})


def test_missing_neighbours_count_for_nothing(cube):
    c = cube([1.0, None, 3.0, 4.0], ["2000-01-01"], y=(0.0, 10.0), x=(0.0, 10.0))
    out = regrid.regrid(c, np.array([0.0]), np.array([5.0, 10.0]))
    assert {r["x"]: r["v"] for r in out.df.collect()} == {5.0: 1.0, 10.0: None}


def test_streams_of_slabs(spark, cube, tmp_path):
    c = cube([float(i) for i in range(72)], HOURS, y=(0.0,), x=(0.0,))
    c.df.write.parquet(f"file://{tmp_path}/slabs")
    stream = streaming.slabs(spark, f"file://{tmp_path}/slabs", c.df.schema)
    for i, made in enumerate((streaming.windowed(stream, "v", "max", "t", "1 day"), streaming.cycles(stream, "v", "count", "t"))):
        q = made.writeStream.outputMode("complete").format("memory").queryName(f"s{i}").trigger(availableNow=True).start()
        q.awaitTermination()
    assert sorted(r["v"] for r in spark.table("s0").collect()) == [23.0, 47.0, 71.0]
    assert {r["v"] for r in spark.table("s1").collect()} == {3}
    assert spark.table("s1").where(F.col("bin") > 23).count() == 0
