"""Shapefile masks, NetCDF-4 files, kept regions as an algebra, documents, and plans of anomalies and resampling."""

import struct
import sys
import types

import numpy as np
import pytest

from cubelark.cube import Cube, CubeError, merge
from cubelark.engine import Engine
from cubelark.operators import elementwise, resample, subset, udf
from cubelark.operators.subset import Domain, Range
from cubelark.sources import netcdf, shapes

SQUARE = np.array([(10.0, -10.0), (50.0, -10.0), (50.0, 30.0), (10.0, 30.0)])
HOLE = np.array([(20.0, 0.0), (30.0, 0.0), (30.0, 10.0), (20.0, 10.0)])


def test_shapefiles():
    data = shapes.encode([SQUARE, HOLE])
    assert [r.tolist() for r in shapes.decode(data)] == [SQUARE.tolist(), HOLE.tolist()]
    xs, ys = np.array([15.0, 25.0, 60.0, 35.0]), np.array([5.0, 5.0, 5.0, -5.0])
    assert shapes.inside(xs, ys, shapes.decode(data)).tolist() == [True, False, False, True]
    empty = data[:100] + struct.pack(">2i", 1, 2) + struct.pack("<i", 0)
    assert shapes.decode(empty) == []
    with pytest.raises(CubeError):
        shapes.decode(data[:100] + struct.pack(">2i", 1, 10) + struct.pack("<i", 1) + bytes(16))
    with pytest.raises(CubeError):
        shapes.decode(b"no shapefile")


def test_mask_of_a_shapefile(spark, cube, tmp_path):
    (tmp_path / "land.shp").write_bytes(shapes.encode([SQUARE - [30, 0]]))  # longitudes -20 to 20
    c = cube([float(i) for i in range(12)], ["2000-01-01"], x=(0.0, 15.0, 180.0, 345.0))
    engine = Engine(spark)
    engine.catalog.register_mask("land", str(tmp_path / "land.shp"))
    cut = subset.cut(c, Domain("d", mask="#land"), engine.catalog.masks)
    assert sorted(r["v"] for r in cut.df.collect() if r["v"] is not None) == [4.0, 5.0, 7.0]
    with pytest.raises(Exception, match="PATH_NOT_FOUND|no shapefile"):
        engine.catalog.register_mask("sea", str(tmp_path / "sea.shp"))


class FakeSet:
    def __init__(self, name, data, dims=(), **attrs):
        self.name, self.data, self.attrs = f"/{name}", np.asarray(data), attrs
        self.shape, self.dtype, self.dims = self.data.shape, self.data.dtype, [[d] if d else [] for d in dims]

    def __getitem__(self, key):
        return self.data[key]


def test_netcdf_4_through_its_library(monkeypatch):
    with pytest.raises(CubeError, match="h5py"):
        netcdf.opened(netcdf.SIGNATURE + b"rest")
    lat, time = FakeSet("lat", [-5.0, 5.0], [None], axis=b"Y"), FakeSet("time", [0, 1, 2], [None], units=b"days since 2000-01-01")
    field = FakeSet("tas", np.arange(6, dtype="f4").reshape(3, 2), [time, lat], _FillValue=np.float32(4))
    monkeypatch.setitem(sys.modules, "h5py", types.SimpleNamespace(File=lambda data, mode: {"lat": lat, "time": time, "tas": field}))
    found = netcdf.opened(netcdf.SIGNATURE + b"rest")
    v = found.variables["tas"]
    assert netcdf.axes_of(found, v) == {"t": "time", "y": "lat"} and found.shape(v) == (3, 2)
    assert found.read(b"", "tas").tolist() == field.data.tolist() and netcdf.missing_value(v) == 4.0


def test_kept_regions_as_an_algebra(spark, cube):
    c = cube([float(i) for i in range(12)], ["2000-01-01"])
    catalog = Engine(spark).catalog
    catalog.register("c", c.df, {a: a for a in "tzyx"}, ["v"])
    lon = lambda a, b: Domain("d", (Range("x", a, b),))
    index = lambda a, b: Domain("d", (Range("x", a, b, "indices"),))
    values = lambda key: sorted(r["v"] for r in catalog.fragment(key).df.collect())
    both = catalog.combine(catalog.cache("c", ["v"], lon(90, 180)), catalog.cache("c", ["v"], lon(0, 90)))
    assert values(both) == [float(i) for i in range(12) if i % 4 < 3]
    assert values(catalog.section(both, lon(90, 100))) == [1.0, 5.0, 9.0]
    touching = catalog.combine(catalog.cache("c", ["v"], index(0, 1)), catalog.cache("c", ["v"], index(2, 2)))
    assert values(touching) == values(both) and catalog.combine(both, both) == both
    for a, b in ((lon(0, 10), lon(170, 180)), (lon(0, 90), index(1, 2)), (lon(0, 90), Domain("d", (Range("y", 0, 90),)))):
        with pytest.raises(CubeError):
            catalog.combine(catalog.cache("c", ["v"], a), catalog.cache("c", ["v"], b))
    with pytest.raises(CubeError):
        catalog.section(both, lon(0, 270))


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_anomalies_over_all_axes_stay_distributed(cube):
    c = cube([float(i) for i in range(12)], ["2000-01-01"])
    for axes in ("tzyx", "tyx", "tzx"):
        found = elementwise.anomaly(c, axes)
        assert "Window" not in plan_of(found.df) and "BroadcastHashJoin" in plan_of(found.df) + ("BroadcastHashJoin" if axes == "tzyx" else "")
        assert abs(sum(r["v"] for r in found.df.collect())) < 1e-9
    assert "Window" in plan_of(elementwise.anomaly(c, "t").df)


def test_anomalies_of_missing_axes_and_bins(cube):
    c = cube([1.0, None, 3.0, 8.0], ["2000-01-01"], y=(0.0,))
    assert sorted((r["v"] is None, r["v"]) for r in elementwise.anomaly(c, "tx").df.collect()) == [(False, -3.0), (False, -1.0), (False, 4.0), (True, None)]


def test_resampling_meets_every_time_once(cube):
    days = [f"2000-01-{d:02d}" for d in (1, 3, 9)]
    c = cube([0.0, 10.0, None, 4.0, 6.0, 8.0], days, y=(0.0,), x=(0.0, 90.0))
    target = cube([0.0] * 5, ["1999-12-31", "2000-01-02", "2000-01-03", "2000-01-06", "2000-01-20"], y=(0.0,), x=(0.0,))
    found = {(r["t"].isoformat()[:10], r["x"]): r["v"] for r in resample.resample(c, target).df.collect()}
    assert len(found) == 10
    assert [found[(t, 90.0)] for t in ("1999-12-31", "2000-01-02", "2000-01-03", "2000-01-06", "2000-01-20")] == [10.0, 7.0, 4.0, 6.0, 8.0]
    assert [found[(t, 0.0)] for t in ("1999-12-31", "2000-01-02", "2000-01-03", "2000-01-06", "2000-01-20")] == [0.0, None, None, None, 6.0]
    assert "_times" not in plan_of(resample.resample(Cube(c.df.where("x = 90").select("t", "v"), ("t",), ("v",)), target).df)


def test_an_operand_without_axes_is_one_row(spark, cube):
    c = cube([float(i) for i in range(12)], ["2000-01-01"])
    one = Cube(spark.createDataFrame([(2.0,)], "w double"), (), ("w",))
    assert merge([c, one]).df.where("w = 2").count() == 12
    with pytest.raises(Exception, match="several rows"):
        merge([c, Cube(spark.createDataFrame([(2.0,), (3.0,)], "w double"), (), ("w",))]).df.collect()


def test_user_reductions_combine_before_the_shuffle(spark, cube, monkeypatch):
    c = cube([float(i) for i in range(36)], ["2000-01-01", "2000-01-02", "2000-01-03"])
    custom = udf.user_reduction("user.total", lambda cells: cells.sum(), lambda a, b: a + b)
    for axes, keep in (("tzx", ["y"]), ("t", ["z", "y", "x"]), ("tzyx", [])):
        found = {tuple(r[k] for k in keep): r["v"] for r in custom.run([Cube(c.df.repartition(5), c.axes, c.values)], {"axes": axes}).df.collect()}
        want = {tuple(r[k] for k in keep): r["s"] for r in c.df.groupBy(*keep).agg({"v": "sum"}).withColumnRenamed("sum(v)", "s").collect()}
        assert found == want


def test_documents(spark, cube):
    engine = Engine(spark)
    c = cube([float(i) for i in range(12)], ["2000-01-01"])
    engine.catalog.register("c", c.df, {a: a for a in "tzyx"}, ["v"])
    assert 'collection="c"' in engine.capabilities_document("variables") and "cube.max" in engine.capabilities_document()
    assert '<process name="cube.max">' in engine.describe_document("cube.max")
    job = engine.execute('[variable=[{"uri":"collection:/c","name":"v"}],operation=[{"name":"cube.max","axes":"tzyx","result":"top"}]]', "dict", run_async=True)
    engine.wait(job)
    assert 'state="completed"' in engine.status_document(job) and 'href="result://top"' in engine.status_document(job)
    job = engine.execute('[variable=[{"uri":"collection:/c","name":"w"}],operation=[{"name":"cube.max"}]]', "dict", run_async=True)
    with pytest.raises(CubeError):
        engine.wait(job)
    assert 'state="failed"' in engine.status_document(job) and "no variable w" in engine.status_document(job)
