"""Requests: grammar, validation, workflows, plans, responses, the catalog and user operations."""

import pandas as pd
import pytest

from cubelark.cube import CubeError
from cubelark.engine import Engine
from cubelark.operators import kernels, udf
from cubelark.plans.request import parse

TIMES = ["2000-01-01", "2000-02-01", "2000-03-01"]


@pytest.fixture
def engine(spark, cube):
    c = cube([float(i % 7) for i in range(36)], TIMES)
    out = Engine(spark)
    out.catalog.register("field", c.df.withColumn("w", c.df["v"] * 2), {a: a for a in "tzyx"}, ["v", "w"])
    return out


def ask(operation, variable='{"uri":"collection:/field","name":"v"}', domain=""):
    return f"[domain=[{domain}],variable=[{variable}],operation=[{operation}]]"


def test_grammar():
    found = parse(
        '[domain=[{"name":"d0","lat":{"start":-1.5e1,"end":70,"System":"values"},"level":"500","crs":"gaussian~8"}];'
        'variable={"uri":"collection:/c","name":"a:x,b|y","domain":"d0","cache":false},'
        'operation=[{"NAME":"cube.max","input":["x","y"],"axes":"XY","flag":true}]]'
    )
    assert found.domains["d0"].ranges[0].start == -15.0 and found.domains["d0"].get("crs") == "gaussian~8"
    assert list(found.variables) == ["x", "y"] and found.variables["y"].name == "b"
    assert found.operations[0].options == {"axes": "XY", "flag": True}


@pytest.mark.parametrize(
    "text",
    [
        "[domain=[]",
        '[variable=[{"name":"v"}],operation=[]]',
        "[what=[]]",
        '[a=[{"x":"]]>"}]]',
        ask('{"name":"cube.max","input":"nothing"}'),
        ask('{"name":"cube.max","input":"v","domain":"nowhere"}'),
        ask('{"name":"cube.max","input":"b","id":"a"},{"name":"cube.max","input":"a","id":"b"}'),
        ask('{"name":"cube.none","input":"v"}'),
        ask('{"name":"cube.max","input":"v"}', '{"uri":"collection:/gone","name":"v"}'),
        ask('{"name":"cube.max"}', '{"uri":"collection:/field","name":"q"}'),
        ask('{"name":"cube.max"}', '{"uri":"ftp:/field","name":"v"}'),
    ],
)
def test_wrong_requests_are_refused(engine, text):
    with pytest.raises(CubeError):
        engine.execute(text)


def test_workflow_is_fused(engine):
    text = ask('{"name":"cube.average","input":"v","axes":"t","id":"m"},{"name":"cube.diff2","input":"v,m","id":"a"},{"name":"cube.rms","input":"a","axes":"t","result":"out"}')
    (df,) = engine.execute(text).values()
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Window" not in plan
    want = engine.catalog.cube("field", ["v"]).df.toPandas().groupby(["z", "y", "x"])["v"].std()
    got = df.toPandas().set_index(["z", "y", "x"])["v"]
    pd.testing.assert_series_equal(got.sort_index(), want.sort_index(), check_names=False)


def test_variables_of_one_collection_need_no_join(engine):
    (df,) = engine.execute(ask('{"name":"cube.diff2","input":"a,b"}', '{"uri":"collection:/field","name":"v:a,w:b"}')).values()
    assert "Join" not in df._jdf.queryExecution().optimizedPlan().toString()
    assert {r["diff2"] for r in df.collect()} == {-float(i) for i in range(7)}


def test_several_products_and_default_inputs(engine):
    found = engine.execute(ask('{"name":"cube.max","axes":"tzyx","result":"top"},{"name":"cube.min","axes":"tzyx","result":"low"}'))
    assert found["top"].first()[0] == 6.0 and found["low"].first()[0] == 0.0
    assert engine.result("result://top").count() == 1
    assert engine.capabilities("results")[0]["href"] == "result://top"
    engine.utility("util.dres", rid="top")
    with pytest.raises(CubeError):
        engine.result("top")


def test_responses(engine, tmp_path):
    text = ask('{"name":"cube.max","axes":"tzx","result":"m"}')
    assert [r["v"] for r in engine.execute(text, "dict")["m"]["rows"]] == [6.0] * 3
    assert "<data id=\"v\" shape=\"3\">6.0,6.0,6.0</data>" in engine.execute(text, "xml")["m"]
    assert engine.execute(text, "object")["m"].num_rows == 3
    path = engine.execute(text, "file", f"file://{tmp_path}")["m"]
    assert engine.spark.read.parquet(path).count() == 3
    job = engine.execute(text, "dict", run_async=True)
    assert len(engine.wait(job, 60)["m"]["rows"]) == 3 and engine.status(job) == "completed"


def test_regions_are_kept_and_answer_for_smaller_ones(engine):
    (key,) = engine.utility("util.cache", '[domain=[{"name":"d","lat":{"start":-60,"end":0}}],variable=[{"uri":"collection:/field","name":"v","domain":"d"}],operation=[]]')
    assert engine.capabilities("fragments") == [{"key": key}]
    (df,) = engine.execute(ask('{"name":"cube.subset"}', '{"uri":"collection:/field","name":"v","domain":"e"}', '{"name":"e","lat":{"start":0,"end":0}}')).values()
    assert df.count() == 12 and "InMemoryRelation" in df._jdf.queryExecution().withCachedData().toString()
    assert engine.catalog.fragment(f"fragment:/{key}").df.count() == 24
    engine.utility("clearCache")
    assert not engine.capabilities("fragments")


def test_sources(engine, cube, tmp_path):
    c = cube([float(i) for i in range(36)], TIMES)
    axes = {a: a for a in "tzyx"}
    for i, t in enumerate(TIMES):
        c.df.where(f"t = '{t}'").write.parquet(f"file://{tmp_path}/deep/{i}/part.parquet")
    engine.utility("util.magg", sources={"nested": f"{tmp_path}/deep"}, axes=axes, variables=["v"])
    assert engine.catalog.cube("nested").df.count() == 36
    (tmp_path / "list.csv").write_text(f"{tmp_path}/deep/0/part.parquet\n{tmp_path}/deep/2/part.parquet\nreadme\n")
    engine.utility("util.agg", name="listed", source=f"{tmp_path}/list.csv", axes=axes, variables=["v"])
    assert engine.catalog.cube("collection:/LISTED", ["*"]).df.count() == 24
    engine.catalog.save(str(tmp_path / "catalog.json"))
    other = Engine(engine.spark)
    other.catalog.load(str(tmp_path / "catalog.json"))
    assert {c["name"] for c in other.capabilities("collections")} == {"nested", "listed"}
    engine.utility("util.dcol", name="listed")
    assert Engine(engine.spark).catalog.register("f", f"{tmp_path}/deep", axes, ["v"], file_filter="none*").file_filter == "none*"
    for wrong in ("http://host/x.nc", "/data/x.hdf"):
        with pytest.raises(CubeError):
            engine.catalog.register("w", wrong, axes, ["v"])


def test_time_resampling_and_regridding_by_request(engine, cube):
    other = cube([0.0, 0.0], ["2000-01-16", "2000-02-01"], y=(0.0,), x=(0.0,), name="u")
    engine.catalog.register("other", other.df, {a: a for a in "tzyx"}, ["u"])
    inputs = '{"uri":"collection:/field","name":"v"},{"uri":"collection:/other","name":"u"}'
    (df,) = engine.execute(ask('{"name":"cube.subset","input":"v","domain":"d"}', inputs, '{"name":"d","trs":"~u"}')).values()
    assert df.select("t").distinct().count() == 2
    (df,) = engine.execute(ask('{"name":"cdms.regrid","input":"v","domain":"d"}', inputs, '{"name":"d","crs":"gaussian~2"}')).values()
    assert df.select("y", "x").distinct().count() == 8


def test_user_operations(engine):
    udf.user_reduction("my.smallest", lambda cells: cells.min(), lambda a, b: a.combine(b, min))
    (df,) = engine.execute(ask('{"name":"my.smallest","axes":"tx"}')).values()
    assert df.count() == 3 and {r["v"] for r in df.collect()} == {0.0}
    assert engine.describe("my.smallest")["options"] == ["axes"]
    assert "cube.max" in {k["name"] for k in engine.capabilities()}


def test_netcdf_round_trip(engine, cube, tmp_path):
    c = cube([None if i == 5 else i / 4 for i in range(36)], TIMES)
    engine.catalog.register("gaps", c.df, {a: a for a in "tzyx"}, ["v"])
    path = engine.execute(ask('{"name":"cube.subset","result":"all"}', '{"uri":"collection:/gaps","name":"v"}'), "netcdf", str(tmp_path))["all"]
    engine.catalog.register("again", path, variables=["v"])
    back = engine.catalog.cube("again")
    assert back.axes == ("t", "z", "y", "x")
    assert sorted(map(str, back.df.collect())) == sorted(map(str, c.df.collect()))
    assert engine.profile()[0]["response"] in ("netcdf", "frame")
    with pytest.raises(CubeError):
        engine.catalog.register("none", path, variables=["w"])


def test_netcdf_records_and_units(spark, tmp_path):
    import struct

    from cubelark.sources import netcdf

    n = lambda *x: struct.pack(f">{len(x)}i", *x)
    t = lambda s: n(len(s)) + s.encode() + b"\0" * (-len(s) % 4)
    # two record variables (unlimited time, shorts padded to four bytes) and version 1 offsets
    units = n(12, 1) + t("units") + n(2) + t("days since 2000-01-01")
    scaled = n(12, 2) + t("scale_factor") + n(6, 1) + struct.pack(">d", 0.5) + t("missing_value") + n(3, 1) + struct.pack(">hxx", -9)
    make = lambda a, b: b"CDF\x01" + n(3) + n(10, 2) + t("time") + n(0) + t("lat") + n(3) + n(0, 0) + n(11, 2) + t("time") + n(1, 0) + units + n(6, 8, a) + t("v") + n(2, 0, 1) + scaled + n(3, 8, b)
    start = len(make(0, 0))
    data = make(start, start + 8) + b"".join(struct.pack(">d", d) + struct.pack(">3hxx", d, -9, 10 * d) for d in (1, 2, 40))
    (tmp_path / "r.nc").write_bytes(data)
    rows = netcdf.scan(spark, f"file://{tmp_path}/r.nc", "v").ordered().collect()
    assert [r["v"] for r in rows] == [0.5, None, 5.0, 1.0, None, 10.0, 20.0, None, 200.0]
    assert rows[0]["t"].isoformat() == "2000-01-02T00:00:00" and rows[8]["y"] == 2.0
    with pytest.raises(CubeError):
        netcdf.Header(b"\x89HDF")
    with pytest.raises(CubeError):
        netcdf.seconds(rows, "months since 2000-01-01")


def test_command_line(spark, tmp_path, cube, capsys):
    from cubelark.__main__ import main

    cube([1.0] * 36, TIMES).df.write.parquet(f"file://{tmp_path}/d/p.parquet")
    catalog = str(tmp_path / "c.json")
    assert main([catalog, "agg", "d", f"{tmp_path}/d", "t=t,z=z,y=y,x=x", "v"]) == 0 and main([catalog, "list"]) == 0
    assert '"collection": "d"' in capsys.readouterr().out
    assert main([catalog, "run", ask('{"name":"cube.sum","axes":"tzyx","result":"s"}', '{"uri":"collection:/d","name":"v"}')]) == 0
    assert "36.0" in capsys.readouterr().out and main([]) == 2


def test_operations_of_other_packages(engine, tmp_path, monkeypatch):
    (tmp_path / "kernels_of_mine").mkdir()
    (tmp_path / "kernels_of_mine" / "__init__.py").write_text("")
    (tmp_path / "kernels_of_mine" / "twice.py").write_text(
        "from cubelark.operators.elementwise import scalar\nfrom cubelark.operators.udf import Operation, register\nregister(Operation('mine.twice', lambda cubes, o: scalar('mul', cubes[0], 2)))\n"
    )
    monkeypatch.syspath_prepend(str(tmp_path))
    assert udf.load("kernels_of_mine") == ["mine.twice"]
    (df,) = engine.execute(ask('{"name":"mine.twice"}')).values()
    assert {r["v"] for r in df.collect()} == {2.0 * i for i in range(7)}


def test_a_region_reaches_the_scan(spark, cube, tmp_path):
    c = cube([float(i) for i in range(36)], TIMES)
    c.df.withColumn("other", c.df["v"]).write.parquet(f"file://{tmp_path}/f.parquet")
    engine = Engine(spark)
    engine.catalog.register("f", f"file:{tmp_path}/f.parquet", {a: a for a in "tzyx"}, ["v", "other"])
    text = ask('{"name":"cube.average","input":"v","axes":"tzy","domain":"d"}', '{"uri":"collection:/f","name":"v"}', '{"name":"d","time":{"start":"2000-01-15","end":"2000-03-15"},"lat":{"start":-60,"end":0}}')
    (df,) = engine.execute(text).values()
    plan = df._jdf.queryExecution().executedPlan().toString()
    pushed = plan[plan.index("PushedFilters") :].split("ReadSchema")
    assert "GreaterThanOrEqual(t" in pushed[0] and "IsNotNull(y)" in pushed[0]  # Spark cuts the list
    assert "other" not in pushed[1].split("\n")[0]
    assert df.count() == 4


def test_kernels_by_other_module_names():
    assert udf.lookup("Some.Max") is udf.lookup("cube.max") is udf.lookup("max")
    for family, kernel, meant in ((kernels.CDMS, "ave", "cdms.ave"), (kernels.NUMPY, "ave", "cube.average")):
        for module in (family, f"x.{family}Module", f"y.{family}Ext"):
            assert udf.lookup(f"{module}.{kernel}") is udf.lookup(f"{module}.{kernel.upper()}") is udf.lookup(meant)
    with pytest.raises(CubeError):
        udf.lookup("cube.none")
