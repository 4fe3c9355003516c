"""The registered queries of the cube engine over the driver's tables, with SQL for each.

Four views: ``ev`` (events by time, type and user), ``li`` (line items by ship date, a latitude made of
the supplier's number, and part), ``od`` (orders by date and nation of the customer) and ``em`` (embeddings
by vector and position). Derived doubles are rounded in both, as sums depend on the order of rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from xml.etree import ElementTree

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cubelark import streaming
from cubelark.cube import Cube
from cubelark.engine import Engine
from cubelark.functions.calendar import season_year
from cubelark.operators import elementwise, reduce, regrid, resample, subset, timebin, udf
from cubelark.session import shared_folder, ship
from cubelark.sources import shapes

DIGITS = 5
#: Added before rounding, so that exact ties, which sums in another order may fall to either side of, don't occur.
NUDGE = 3.14159e-7

#: SQL of the views.
VIEWS = """
    WITH ev AS (SELECT ts AS t, event_type AS z, user_id AS x, value FROM events),
    em AS (SELECT vec_id AS z, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS x, CAST(unnest(embedding) AS DOUBLE) AS element FROM embeddings),
    od AS (SELECT o_orderdate AS t, CAST(c_nationkey AS DOUBLE) AS y, o_custkey AS x, o_totalprice AS total FROM orders JOIN customer ON o_custkey = c_custkey),
    li AS (SELECT l_shipdate AS t, -90 + 180 * (l_suppkey + 0.5) / (SELECT count(*) FROM supplier) AS y, l_partkey AS x,
        l_quantity AS quantity, l_extendedprice AS price, l_discount AS discount, l_tax AS tax FROM lineitem)
"""


def engine(spark: SparkSession, sf_dir: str) -> Engine:
    """An engine whose catalog has the four views, and two masks."""
    ship(spark)
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    out = Engine(spark)
    c = out.catalog
    c.register("ev", read("events"), {"t": "ts", "z": "event_type", "x": "user_id"}, ["value"], title="events")
    suppliers = read("supplier").agg(F.count("*")).scalar()
    lat = F.lit(-90.0) + F.lit(180.0) * (F.col("l_suppkey") + 0.5) / suppliers
    c.register("li", read("lineitem"), {"t": "l_shipdate", "y": lat, "x": "l_partkey"}, {"quantity": "l_quantity", "price": "l_extendedprice", "discount": "l_discount", "tax": "l_tax"}, title="line items")
    orders = read("orders").join(read("customer"), F.col("o_custkey") == F.col("c_custkey"))
    c.register("od", orders, {"t": "o_orderdate", "y": F.col("c_nationkey").cast("double"), "x": "o_custkey"}, {"total": "o_totalprice"}, title="orders")
    vectors = read("embeddings").select("vec_id", F.posexplode("embedding").alias("place", "element"))
    c.register("em", vectors, {"z": "vec_id", "x": "place"}, ["element"], title="embeddings")
    c.masks["triangle"] = [(0.0, -60.0), (1500.0, -60.0), (0.0, 60.0)]
    return out


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*(F.round(F.col(f.name) + NUDGE, DIGITS).alias(f.name) if f.dataType.typeName() == "double" else F.col(f.name) for f in df.schema))


Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def request(name: str, text: str, sql: str, **renamed: str) -> None:
    """Registers a request in the request language; its only product is the result."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        (df,) = engine(spark, sf_dir).execute(text).values()
        for old, new in renamed.items():
            df = df.withColumnRenamed(old, new)
        return rounded(df)

    QUERIES[name] = run
    ORACLE_SQL[name] = f"{VIEWS} {sql}"


def query(name: str, sql: str | None):
    """Registers a function of an engine."""

    def put(function: Callable[[Engine], DataFrame | Cube]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            found = function(engine(spark, sf_dir))
            return rounded(found.df if isinstance(found, Cube) else found)

        QUERIES[name] = run
        if sql:
            ORACLE_SQL[name] = f"{VIEWS} {sql}"
        return function

    return put


def var(collection: str, names: str, domain: str = "") -> str:
    return f'{{"uri":"collection:/{collection}","name":"{names}"' + (f',"domain":"{domain}"' if domain else "") + "}"


def ask(operation: str, variable: str, domain: str = "") -> str:
    return f"[domain=[{domain}],variable=[{variable}],operation=[{operation}]]"


def r(expression: str, name: str) -> str:
    return f"round({expression} + {NUDGE}, {DIGITS}) + 0.0 AS {name}"  # no negative zero


# Reductions ---------------------------------------------------------------------------------

_SQL_AGGREGATES = {
    "max": "max(value)",
    "min": "min(value)",
    "sum": "sum(value)",
    "average": "avg(value)",
    "rms": "sqrt(sum(value * value) / nullif(count(*) - 1, 0))",
    "rmSum": "sqrt(sum(value) / nullif(count(*) - 1, 0))",
}
for _kernel, _sql in _SQL_AGGREGATES.items():
    request(f"reduce_{_kernel.lower()}_t", ask(f'{{"name":"cube.{_kernel}","input":"value","axes":"t"}}', var("ev", "value")), f"SELECT z, x, {r(_sql, 'value')} FROM ev GROUP BY z, x")
for _kernel, _sql in {"std": "stddev_pop(value)", "var": "var_pop(value)", "ptp": "max(value) - min(value)", "max": "max(value)", "min": "min(value)", "sum": "sum(value)", "ave": "avg(value)", "maxSer": "max(value)", "maxCustRed": "max(value)"}.items():
    request(f"numpy_{_kernel.lower()}_tz", ask(f'{{"name":"numpy.{_kernel}","input":"value","axes":"tz"}}', var("ev", "value")), f"SELECT x, {r(_sql, 'value')} FROM ev GROUP BY x")

request("reduce_all_axes", ask('{"name":"cube.average","axes":""}', var("ev", "value")), f"SELECT {r('avg(value)', 'value')} FROM ev")
request("reduce_many_variables", ask('{"name":"cube.max","axes":"tx"}', var("li", "*")), "SELECT y, max(quantity) AS quantity, max(price) AS price, max(discount) AS discount, max(tax) AS tax FROM (SELECT round(y, 5) AS y, quantity, price, discount, tax FROM li) GROUP BY y")
request("weighted_cosine", ask('{"name":"cube.average","input":"quantity","axes":"xy","weights":"cosine"}', var("li", "quantity")), f"SELECT t, {r('sum(quantity * cos(radians(y))) / sum(cos(radians(y)))', 'quantity')} FROM li GROUP BY t")
request("numpy_avew", ask('{"name":"numpy.avew","input":"quantity","axes":"txy"}', var("li", "quantity")), f"SELECT {r('sum(quantity * cos(radians(y))) / sum(cos(radians(y)))', 'quantity')} FROM li")
_AREA = "sin(radians(least(y + 90.0 / n, 90))) - sin(radians(greatest(y - 90.0 / n, -90)))"
request("cdms_ave", ask('{"name":"cdms.ave","input":"price","axis":"y"}', var("li", "price")), f"SELECT t, x, {r('sum(price * w) / sum(w)', 'price')} FROM (SELECT *, {_AREA} AS w FROM li, (SELECT count(DISTINCT l_suppkey) AS n FROM lineitem)) GROUP BY t, x")
_ZONAL = f"""SELECT round(y, {DIGITS}) AS y, {r('avg(price)', 'price')} FROM (
    SELECT y, x, sum(price * days) / sum(days) AS price FROM (
        SELECT y, x, avg(price) AS price, day(last_day(min(t))) AS days FROM li WHERE month(t) IN (12, 1, 2) GROUP BY y, x, year(t), month(t)
    ) GROUP BY y, x) GROUP BY y"""
request("cdms_zonal_season", ask('{"name":"cdms.zaDemo","input":"price"}', var("li", "price")), _ZONAL)

for _name, _sql in {"maxmag": "max(abs(element))", "minmag": "min(abs(element))", "mean": "sum(element) / count(*)", "count": "count(element)"}.items():

    @query(f"tensor_{_name}", f"SELECT x, {r(_sql, 'element') if _name != 'count' else 'count(element) AS element'} FROM em GROUP BY x")
    def _tensor(e: Engine, name: str = _name) -> Cube:
        return reduce.reduce_cube(e.catalog.cube("em"), name, "z")


@query("sum_and_count", f"SELECT z, {r('sum(value)', 'value_sum')}, count(value) AS value_count FROM ev GROUP BY z")
def _sumw(e: Engine) -> Cube:
    return reduce.sum_and_count(e.catalog.cube("ev"), "tx")


@query("missing_values", f"SELECT x, {r('avg(v)', 'value')} FROM (SELECT x, CASE WHEN value <> 6.55 THEN value END AS v FROM ev) GROUP BY x")
def _missing(e: Engine) -> Cube:
    e.catalog.register("holes", e.catalog.collection("ev").frame, {"t": "ts", "z": "event_type", "x": "user_id"}, ["value"], missing=6.55)
    return reduce.reduce_cube(e.catalog.cube("holes"), "average", "tz")


@query("max_scaled_difference", f"SELECT {r('max(abs(discount - tax)) / avg(discount)', 'difference')} FROM li")
def _difference(e: Engine) -> Cube:
    cube = e.catalog.cube("li")
    one = lambda v: Cube(cube.df, cube.axes, (v,), cube.origin)
    return reduce.max_scaled_difference(one("discount"), one("tax"), "discount", "tax")


# Regions ------------------------------------------------------------------------------------

_JANUARY = '{"name":"d0","time":{"start":"2024-01-03","end":"2024-01-12T12:00:00","system":"values"}}'


def _within(lo: str, hi: str, view: str = "ev") -> str:
    """Steps from the one that contains ``lo`` up to ``hi``; none if the axis ends before ``lo``."""
    return f"t >= coalesce((SELECT max(t) FROM {view} WHERE t <= TIMESTAMP '{lo}'), TIMESTAMP '{lo}') AND t <= TIMESTAMP '{hi}' AND (SELECT max(t) FROM {view}) >= TIMESTAMP '{lo}'"


request("subset_time", ask('{"name":"cube.subset","input":"value","domain":"d0"}', var("ev", "value"), _JANUARY), "SELECT t, z, x, value FROM ev WHERE " + _within("2024-01-03", "2024-01-12 12:00:00"))
request("average_in_time", ask('{"name":"cube.average","input":"value","domain":"d0","axes":"tz"}', var("ev", "value"), _JANUARY), f"SELECT x, {r('avg(value)', 'value')} FROM ev WHERE {_within('2024-01-03', '2024-01-12 12:00:00')} GROUP BY x")
_COORDS = "(SELECT x, row_number() OVER (ORDER BY x) - 1 AS i FROM (SELECT DISTINCT x FROM ev))"
request("subset_indices", ask('{"name":"cube.subset","input":"value","domain":"d0"}', var("ev", "value"), '{"name":"d0","lon":{"start":3,"end":9,"system":"indices"}}'), f"SELECT t, z, ev.x, value FROM ev JOIN {_COORDS} c ON ev.x = c.x WHERE i BETWEEN 3 AND 9")
_NEAR = "(SELECT first(y ORDER BY abs(y - {v}), y) FROM (SELECT DISTINCT y FROM li))"
request("subset_values", ask('{"name":"cube.sum","input":"quantity","domain":"d0","axes":"tx"}', var("li", "quantity"), '{"name":"d0","lat":{"start":-30,"end":31.3,"system":"values"}}'), f"SELECT round(y, {DIGITS}) AS y, sum(quantity) AS quantity FROM li WHERE y BETWEEN {_NEAR.format(v=-30)} AND {_NEAR.format(v=31.3)} GROUP BY y")
request("subset_scalar_axis", ask('{"name":"cube.subset","input":"tax","domain":"d0"}', var("li", "tax"), '{"name":"d0","lat":"10"}'), f"SELECT t, round(y, {DIGITS}) AS y, x, tax FROM li WHERE y = {_NEAR.format(v=10)}")
request("subset_empty", ask('{"name":"cube.subset","input":"tax","domain":"d0"}', var("li", "tax"), '{"name":"d0","lat":{"start":95,"end":99}}'), "SELECT t, y, x, tax FROM li WHERE false")
_TWO = '{"name":"d0","time":{"start":"1996-01-01","end":"1999-12-31"}},{"name":"d1","time":{"start":"1998-01-01","end":"2000-12-31"}},{"name":"d2","lon":{"start":10,"end":60}}'
request("domains_intersected", ask('{"name":"cube.max","input":"price","domain":"d0,d1","axes":"ty"}', var("li", "price", "d2"), _TWO), "SELECT x, max(price) AS price FROM li WHERE " + _within("1998-01-01", "2000-12-31", "li") + " AND " + _within("1996-01-01", "1999-12-31", "li") + " AND x BETWEEN 10 AND 60 GROUP BY x")
request("season_filter", ask('{"name":"cube.average","input":"price","axes":"tx","filter":"DJF"}', var("li", "price")), f"SELECT round(y, {DIGITS}) AS y, {r('avg(price)', 'price')} FROM li WHERE month(t) IN (12, 1, 2) GROUP BY y")
request("partition", ask('{"name":"cube.partition","input":"price","filter":"JJA,SON"}', var("li", "price")), f"SELECT t, round(y, {DIGITS}) AS y, x, price FROM li WHERE month(t) BETWEEN 6 AND 11")
request("variable_alias", ask('{"name":"cube.max","input":"p1","axes":"tx"}', var("li", "price:p1")), f"SELECT round(y, {DIGITS}) AS y, max(price) AS p1 FROM li GROUP BY y")


@query("season_year", f"SELECT year(t) - CASE WHEN month(t) < 3 THEN 1 ELSE 0 END AS year, {r('avg(price)', 'price')} FROM li WHERE month(t) IN (12, 1, 2) GROUP BY 1")
def _season_year(e: Engine) -> DataFrame:
    cube = subset.seasons(e.catalog.cube("li", ["price"]), "DJF")
    return cube.df.groupBy(season_year(F.col("t"), "DJF").cast("bigint").alias("year")).agg(F.avg("price").alias("price"))


_WHOLE = "SELECT year(t) - CASE WHEN month(t) < 3 THEN 1 ELSE 0 END AS s FROM li WHERE month(t) IN (12, 1, 2) GROUP BY 1 HAVING count(DISTINCT month(t)) = 3"


@query("season_complete", f"SELECT count(*) AS n FROM li WHERE month(t) IN (12, 1, 2) AND year(t) - CASE WHEN month(t) < 3 THEN 1 ELSE 0 END IN ({_WHOLE})")
def _season_complete(e: Engine) -> DataFrame:
    return subset.seasons(e.catalog.cube("li", ["price"]), "DJF", complete_only=True).df.agg(F.count("*").alias("n"))


@query("mask_polygon", f"SELECT {r('sum(CASE WHEN y > -60 AND y < 60 AND x < 1500 - (y + 60) * 12.5 THEN price END)', 'price')} FROM li")
def _mask(e: Engine) -> Cube:
    cube = subset.cut(e.catalog.cube("li", ["price"]), subset.Domain("m", mask="#triangle"), e.catalog.masks)
    return reduce.reduce_cube(cube, "sum", "tyx")


@query("mask_table", f"SELECT round(y, {DIGITS}) AS y, {r('sum(CASE WHEN x % 3 = 0 THEN price END)', 'price')} FROM li GROUP BY y")
def _mask_table(e: Engine) -> Cube:
    cube = e.catalog.cube("li", ["price"])
    e.catalog.masks["thirds"] = cube.df.where("x % 3 = 0").select("y", "x")
    return reduce.reduce_cube(subset.cut(cube, subset.Domain("m", mask="#thirds"), e.catalog.masks), "sum", "tx")


@query("sample", "SELECT t, z, x, value FROM ev ORDER BY t, z, x LIMIT 50")
def _sample(e: Engine) -> DataFrame:
    return subset.sample(e.catalog.cube("ev"), 50)


@query("axis_table", "SELECT CAST(row_number() OVER (ORDER BY x) - 1 AS INTEGER) AS idx, x AS coord FROM (SELECT DISTINCT x FROM ev)")
def _axis(e: Engine) -> DataFrame:
    return e.catalog.axis_table("ev", "x")


@query("cached_region", f"SELECT z, {r('max(value)', 'value')} FROM ev WHERE {_within('2024-01-05', '2024-01-08')} GROUP BY z")
def _cached(e: Engine) -> Cube:
    outer = subset.Domain("o", (subset.Range("t", "2024-01-02", "2024-01-20"),))
    e.catalog.cache("ev", ["value"], outer)
    return reduce.reduce_cube(e.catalog.cube("ev", ["value"], subset.Domain("i", (subset.Range("t", "2024-01-05", "2024-01-08"),))), "max", "tx")


# What regions mean: the steps of the dataset's axis, whatever was cut from it before.
_STEP = "t = (SELECT max(t) FROM ev WHERE t <= TIMESTAMP '2024-01-07 05:00:00')"
request("subset_time_containing", ask('{"name":"cube.subset","input":"value","domain":"d0"}', var("ev", "value"), '{"name":"d0","time":{"start":"2024-01-07T05:00:00","end":"2024-01-07T05:00:00"}}'), f"SELECT t, z, x, value FROM ev WHERE {_STEP}")
request("subset_time_words", ask('{"name":"cube.average","input":"value","axes":"tx","domain":"d0"}', var("ev", "value"), '{"name":"d0","time":{"start":"7 January 2024 05:00","end":"Jan 9, 2024"}}'), f"SELECT z, {r('avg(value)', 'value')} FROM ev WHERE {_within('2024-01-07 05:00:00', '2024-01-09')} GROUP BY z")
_NESTED = '{"name":"d0","lon":{"start":2,"end":6,"system":"indices"}},{"name":"d1","lon":{"start":3,"end":4,"system":"indices"}}'
request("domains_nested_indices", ask('{"name":"cube.subset","input":"value","domain":"d1"}', var("ev", "value", "d0"), _NESTED), f"SELECT t, z, ev.x, value FROM ev JOIN {_COORDS} c ON ev.x = c.x WHERE i BETWEEN 2 AND 6 AND i BETWEEN 3 AND 4")
_GLOBE = "SELECT t, CAST(x % 36 * 10 AS DOUBLE) AS x, price FROM li"


def _globe(e: Engine) -> None:
    """A collection on longitudes 0 to 350."""
    li = e.catalog.collection("li")
    e.catalog.register("globe", li.frame, {"t": "l_shipdate", "x": (F.col("l_partkey") % 36 * 10).cast("double")}, {"price": "l_extendedprice"})


def _on_globe(name: str, start: float, end: float, where: str) -> None:
    @query(name, f"SELECT x, {r('sum(price)', 'price')} FROM ({_GLOBE}) WHERE {where} GROUP BY x")
    def run(e: Engine) -> DataFrame:
        _globe(e)
        (df,) = e.execute(ask('{"name":"cube.sum","input":"price","axes":"t","domain":"d0"}', var("globe", "price"), f'{{"name":"d0","lon":{{"start":{start},"end":{end}}}}}')).values()
        return df


_on_globe("subset_seam", -40, 40, "x >= 320 OR x <= 40")
_on_globe("subset_seam_eastward", 300, 20, "x >= 300 OR x <= 20")
_on_globe("subset_turn", -180, 180, "true")


@query("cached_indices", f"SELECT t, z, ev.x, value FROM ev JOIN {_COORDS} c ON ev.x = c.x WHERE i BETWEEN 3 AND 4")
def _cached_indices(e: Engine) -> Cube:
    index = lambda a, b: subset.Domain(f"{a}", (subset.Range("x", a, b, "indices"),))
    e.catalog.cache("ev", ["value"], index(2, 6))
    return e.catalog.cube("ev", ["value"], index(3, 4))


@query("fragment_uri", f"SELECT z, {r('sum(value)', 'value')} FROM ev WHERE x BETWEEN 5 AND 40 GROUP BY z")
def _fragment(e: Engine) -> DataFrame:
    key = e.catalog.cache("ev", ["value"], subset.Domain("d", (subset.Range("x", 5, 40),)))
    (df,) = e.execute(f'[variable=[{{"uri":"fragment:/{key}","name":"value"}}],operation=[{{"name":"cube.sum","input":"value","axes":"tx"}}]]').values()
    return df


def _lons(a: int, b: int) -> subset.Domain:
    return subset.Domain(f"{a}", (subset.Range("x", a, b),))


@query("fragments_combined", f"SELECT z, {r('sum(value)', 'value')}, count(*) AS n FROM ev WHERE x BETWEEN 5 AND 60 GROUP BY z")
def _combined(e: Engine) -> DataFrame:
    keys = [e.catalog.cache("ev", ["value"], _lons(*ends)) for ends in ((5, 40), (30, 60))]
    cube = e.catalog.fragment(e.catalog.combine(*keys))
    return cube.df.groupBy("z").agg(F.sum("value").alias("value"), F.count("*").alias("n"))


@query("fragment_section", "SELECT t, z, x, value FROM ev WHERE x BETWEEN 10 AND 20")
def _section(e: Engine) -> Cube:
    return e.catalog.fragment(e.catalog.section(e.catalog.cache("ev", ["value"], _lons(5, 40)), _lons(10, 20)))


@query("mask_shapefile", f"SELECT {r('sum(CASE WHEN y > -60 AND y < 60 AND (x < 1500 - (y + 60) * 12.5 AND NOT (y > -30 AND y < 0 AND x < 601.5 - (y + 30) * 301.25 / 30) OR x = 360 AND NOT (y > -30 AND y < 0)) THEN price END)', 'price')} FROM li")
def _shapefile(e: Engine) -> Cube:
    """The polygon of ``mask_polygon`` with a hole, from a shapefile; 360 is the meridian of 0."""
    rings = [np.array([(0.0, -60.0), (1500.0, -60.0), (0.0, 60.0)]), np.array([(0.0, -30.0), (601.5, -30.0), (300.25, 0.0), (0.0, 0.0)])]
    decoded = shapes.decode(shapes.encode(rings))
    e.catalog.masks["shape"] = lambda cube: shapes.cells(cube, decoded)
    cube = subset.cut(e.catalog.cube("li", ["price"]), subset.Domain("m", mask="#shape"), e.catalog.masks)
    return reduce.reduce_cube(cube, "sum", "tyx")


# Sources and responses ----------------------------------------------------------------------

_TOTALS = f"SELECT z, {r('sum(value)', 'value')} FROM ev GROUP BY z"
_SUMS = ask('{"name":"cube.sum","input":"value","axes":"tx","result":"totals"}', var("%s", "value"))
_EVENT_AXES = {"t": "ts", "z": "event_type", "x": "user_id"}


def from_source(name: str, make: Callable[[Engine, str], object]) -> None:
    """Registers a query whose collection ``source`` is made of files of the tables' folder."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = engine(spark, sf_dir)
        make(e, sf_dir)
        (df,) = e.execute(_SUMS % "source").values()
        return rounded(df)

    QUERIES[name] = run
    ORACLE_SQL[name] = f"{VIEWS} {_TOTALS}"


def _listed(e: Engine, sf_dir: str) -> None:
    path = f"{shared_folder(e.spark)}/list-{uuid.uuid4().hex}.csv"
    e.spark.createDataFrame([(f"{sf_dir}/events.parquet",)], "value string").coalesce(1).write.text(path)
    e.catalog.register("source", path, _EVENT_AXES, ["value"])


from_source("source_file", lambda e, d: e.catalog.register("source", f"{d}/events.parquet", _EVENT_AXES, ["value"]))
from_source("source_directory", lambda e, d: e.catalog.register("source", d, _EVENT_AXES, ["value"], file_filter="events*.parquet"))
from_source("source_list", _listed)
from_source("source_command", lambda e, d: e.utility("util.agg", name="source", source=f"{d}/events.parquet", axes=_EVENT_AXES, variables=["value"]))
from_source("source_commands", lambda e, d: e.utility("util.magg", sources={"source": f"{d}/events.parquet"}, axes=_EVENT_AXES, variables=["value"]))


def _netcdf(e: Engine, sf_dir: str) -> None:
    """Two files of the cube's classic form, one after the other along time."""
    from cubelark.sources import netcdf

    read = e.spark.read.parquet(f"{sf_dir}/events.parquet")
    rows = read.groupBy(F.date_trunc("month", "ts").cast("timestamp_ntz").alias("t"), (F.col("user_id") % 5).cast("double").alias("x")).agg(F.sum("value").alias("value"))
    folder = f"{shared_folder(e.spark)}/parts-{uuid.uuid4().hex}"
    for i, part in enumerate(("month(t) % 2 = 0", "month(t) % 2 = 1")):
        cube = Cube(rows.where(part), ("t", "x"), ("value",))
        if rows.where(part).head(1):
            netcdf.write(cube.df, cube, f"{folder}/part{i}.nc")
    e.catalog.register("source", f"{folder}/*.nc", variables=["value"])


def _source_netcdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir)
    _netcdf(e, sf_dir)
    return rounded(reduce.reduce_cube(e.catalog.cube("source"), "sum", "t").df)


QUERIES["source_netcdf"] = _source_netcdf
ORACLE_SQL["source_netcdf"] = f"{VIEWS} SELECT CAST(x % 5 AS DOUBLE) AS x, {r('sum(value)', 'value')} FROM ev GROUP BY 1"


def response(name: str, sql: str, make: Callable[[Engine, str], list | DataFrame]) -> None:
    """Registers what a response of the totals by type has."""

    @query(name, sql)
    def run(e: Engine) -> DataFrame:
        found = make(e, _SUMS % "ev")
        return found if isinstance(found, DataFrame) else e.spark.createDataFrame(found, "z string, value double")


def _in_xml(e: Engine, text: str) -> list:
    xml = ElementTree.fromstring(e.execute(text, "xml")["totals"])
    names = [x["z"] for x in e.execute(text, "dict")["totals"]["rows"]]
    return list(zip(names, map(float, xml.find("data").text.split(",")), strict=True))


def _kept(e: Engine, text: str) -> DataFrame:
    e.execute(text)
    return e.result(e.reference("totals"))


def _in_files(e: Engine, text: str) -> DataFrame:
    job = e.execute(text, "file", path=f"{shared_folder(e.spark)}/results-{uuid.uuid4().hex}", run_async=True)
    e.wait(job)
    href = ElementTree.fromstring(e.status_document(job)).find("output").get("href")
    return e.spark.read.parquet(href)


response("response_dict", _TOTALS, lambda e, text: [(x["z"], x["value"]) for x in e.execute(text, "dict")["totals"]["rows"]])
response("response_xml", _TOTALS, _in_xml)
response("response_object", _TOTALS, lambda e, text: [(x["z"], x["value"]) for x in e.execute(text, "object")["totals"].to_pylist()])
response("response_files_async", _TOTALS, _in_files)
response("result_reference", _TOTALS, _kept)


@query("response_netcdf", f"SELECT CAST(x AS DOUBLE) AS x, {r('max(value)', 'value')} FROM ev WHERE x < 50 GROUP BY x")
def _as_netcdf(e: Engine) -> DataFrame:
    from cubelark.sources import netcdf

    text = ask('{"name":"cube.max","input":"value","axes":"tz","result":"top","domain":"d0"}', var("ev", "value"), '{"name":"d0","lon":{"start":0,"end":49}}')
    path = e.execute(text, "netcdf", path=f"{shared_folder(e.spark)}/results-{uuid.uuid4().hex}")["top"]
    return netcdf.scan(e.spark, path, "value").df


_LISTED = "('ev', 'value', 'tzx'), ('li', 'quantity', 'tyx'), ('li', 'price', 'tyx'), ('li', 'discount', 'tyx'), ('li', 'tax', 'tyx'), ('od', 'total', 'tyx'), ('em', 'element', 'zx')"


@query("list_variables", f"SELECT * FROM (VALUES {_LISTED}) v(collection, name, axes)")
def _variables_listed(e: Engine) -> DataFrame:
    items = ElementTree.fromstring(e.capabilities_document("variables")).findall("item")
    return e.spark.createDataFrame([(i.get("collection"), i.get("name"), i.get("axes")) for i in items], "collection string, name string, axes string")


@query("describe_process", "SELECT 'cube.timeBin' AS name, 'axes,period,mod,unit,offset' AS options, 1 AS least, 99 AS most")
def _described(e: Engine) -> DataFrame:
    found = ElementTree.fromstring(e.describe_document("cube.timeBin"))
    inputs = found.find("inputs")
    return e.spark.createDataFrame([(found.get("name"), ",".join(o.text for o in found.findall("option")), int(inputs.get("least")), int(inputs.get("most")))], "name string, options string, least int, most int")


@query("several_products", f"SELECT 'low' AS product, z, {r('min(value)', 'value')} FROM ev GROUP BY z UNION ALL SELECT 'high', z, {r('max(value)', 'value')} FROM ev GROUP BY z")
def _products(e: Engine) -> DataFrame:
    found = e.execute(ask('{"name":"cube.min","input":"value","axes":"tx","result":"low"},{"name":"cube.max","input":"value","axes":"tx","result":"high"}', var("ev", "value")))
    low, high = (found[n].withColumn("product", F.lit(n)) for n in ("low", "high"))
    return low.unionByName(high)


@query("grid_extent", f"SELECT {r('min(y)', 'y_lo')}, {r('max(y)', 'y_hi')}, CAST(min(x) AS DOUBLE) AS x_lo, CAST(max(x) AS DOUBLE) AS x_hi FROM li")
def _extent(e: Engine) -> DataFrame:
    found = e.catalog.cube("li", ["price"]).extent()
    return e.spark.createDataFrame([tuple(map(float, found["y"] + found["x"]))], "y_lo double, y_hi double, x_lo double, x_hi double")


@query("matching_grid", f"SELECT t, round(y, {DIGITS}) AS y, CAST(x AS DOUBLE) AS x, price FROM (SELECT max(t) AS t, y, x, {r('max(price)', 'price')} FROM li GROUP BY y, x)")
def _matching(e: Engine) -> DataFrame:
    cube = e.catalog.cube("li", ["price"])
    tops = Cube(cube.df.groupBy("y", "x").agg(F.max("t").alias("t"), F.max("price").alias("price")), ("t", "y", "x"), ("price",))
    same = regrid.regrid(tops, tops.coordinates("y"), tops.coordinates("x"))
    return same.df.withColumn("x", F.col("x").cast("double"))


# Point-wise ---------------------------------------------------------------------------------

for _kernel, _sql in {"min2": "least(discount, tax)", "max2": "greatest(discount, tax)", "sum2": "discount + tax", "diff2": "discount - tax", "mult2": "discount * tax", "div2": "discount / nullif(tax, 0)"}.items():
    request(f"dual_{_kernel}", ask(f'{{"name":"cube.{_kernel}","input":"discount,tax"}}', var("li", "discount,tax")), f"SELECT t, round(y, {DIGITS}) AS y, x, {r(_sql, _kernel)} FROM li")
request("multi_average", ask('{"name":"cube.multiAverage","input":"discount,tax,quantity"}', var("li", "discount,tax,quantity")), f"SELECT t, round(y, {DIGITS}) AS y, x, {r('(discount + tax + quantity) / 3', 'value')} FROM li")
request(
    "merge_collections",
    ask('{"name":"cube.average","input":"price","axes":"yx","id":"a"},{"name":"cube.average","input":"total","axes":"yx","id":"b"},{"name":"cube.sum2","input":"a,b"}', f"{var('li', 'price')},{var('od', 'total')}"),
    f"SELECT a.t, {r('p + q', 'sum2')} FROM (SELECT t, avg(price) AS p FROM li GROUP BY t) a JOIN (SELECT t, avg(total) AS q FROM od GROUP BY t) b ON a.t = b.t",
)
request(
    "broadcast_difference",
    ask('{"name":"cube.max","input":"price","axes":"tx","id":"top"},{"name":"cube.diff2","input":"price,top"}', var("li", "price")),
    f"SELECT t, round(y, {DIGITS}) AS y, x, {r('price - max(price) OVER (PARTITION BY y)', 'diff2')} FROM li",
)
request(
    "anomaly_fused",
    ask('{"name":"cube.average","input":"value","axes":"t","id":"m"},{"name":"cube.diff2","input":"value,m"}', var("ev", "value")),
    f"SELECT t, z, x, {r('value - avg(value) OVER (PARTITION BY z, x)', 'value')} FROM ev",
)
FLAGSHIP = ask('{"name":"cube.average","input":"value","axes":"tz","id":"m","domain":"d0"},{"name":"cube.diff2","input":"value,m","id":"a","domain":"d0"},{"name":"cube.rms","input":"a","axes":"tz","result":"deviation"}', var("ev", "value"), _JANUARY)
request("workflow_deviation", FLAGSHIP, f"SELECT x, {r('stddev_samp(value)', 'value')} FROM ev WHERE {_within('2024-01-03', '2024-01-12 12:00:00')} GROUP BY x")
request("const_kernel", ask('{"name":"cube.const","input":"tax","value":2.5}', var("li", "tax")), f"SELECT t, round(y, {DIGITS}) AS y, x, 2.5::DOUBLE AS tax FROM li")
request("anomaly_kernel", ask('{"name":"cube.anomaly","input":"element","axes":"z"}', var("em", "element")), f"SELECT z, CAST(x AS INTEGER) AS x, {r('element - avg(element) OVER (PARTITION BY x)', 'element')} FROM em")


@query("anomaly_by_month", f"SELECT t, round(y, {DIGITS}) AS y, x, {r('price - avg(price) OVER (PARTITION BY y, month(t))', 'price')} FROM li")
def _monthly_anomaly(e: Engine) -> Cube:
    return elementwise.anomaly(e.catalog.cube("li", ["price"]), "tx", F.month("t"))


@query("scalar_operations", f"SELECT t, round(y, {DIGITS}) AS y, x, {r('(quantity * 2 - 3) / 7', 'quantity')} FROM li")
def _scalars(e: Engine) -> Cube:
    cube = e.catalog.cube("li", ["quantity"])
    for name, number in (("mul", 2), ("sub", 3), ("div", 7)):
        cube = elementwise.scalar(name, cube, number)
    return cube


@query("accumulate_in_place", f"SELECT z, {r('a + coalesce(b, 0)', 'value')} FROM (SELECT z, sum(value) AS a, max(CASE WHEN z <> 'error' THEN value END) AS b FROM ev GROUP BY z)")
def _accumulate(e: Engine) -> Cube:
    cube = e.catalog.cube("ev")
    tops = reduce.reduce_cube(cube.where(F.col("z") != "error", ("no errors",)), "max", "tx")
    return elementwise.accumulate("add", reduce.reduce_cube(cube, "sum", "tx"), tops)


@query("map_square_root", f"SELECT t, z, x, {r('sqrt(value)', 'value')} FROM ev WHERE value >= 0")
def _map(e: Engine) -> Cube:
    return elementwise.mapped(e.catalog.cube("ev").where(F.col("value") >= 0, ("positive",)), F.sqrt)


@query("union_slabs", "SELECT count(*) AS n, sum(quantity) AS quantity FROM li")
def _union(e: Engine) -> DataFrame:
    cube = e.catalog.cube("li", ["quantity"])
    cube = Cube(cube.df.select(*cube.axes, "quantity"), cube.axes, ("quantity",))
    both = elementwise.union([Cube(cube.df.where(p), cube.axes, cube.values) for p in ("year(t) < 1998", "year(t) >= 1998")])
    return both.df.agg(F.count("*").alias("n"), F.sum("quantity").alias("quantity"))


@query("difference_from_cycle", f"SELECT t, round(y, {DIGITS}) AS y, x, {r('price - avg(price) OVER (PARTITION BY month(t))', 'price')} FROM li")
def _from_cycle(e: Engine) -> Cube:
    cube = e.catalog.cube("li", ["price"])
    cube = Cube(cube.df.select("t", "y", "x", "price"), cube.axes, ("price",))
    bins = cube.df.groupBy((F.month("t") - 1).alias("bin")).agg(F.avg("price").alias("price"))
    return elementwise.by_bin("sub", cube, bins, F.month("t") - 1)


@query("overlay_maps", f"SELECT z, {r('max(value)', 'value')}, {r('min(value)', 'low')} FROM ev GROUP BY z")
def _overlaid(e: Engine) -> Cube:
    cube = e.catalog.cube("ev")
    top, low, mean = (reduce.reduce_cube(cube, n, "tx") for n in ("max", "min", "average"))
    first = Cube(mean.df.join(low.df.withColumnRenamed("value", "low"), "z"), ("z",), ("value", "low"))
    return elementwise.overlay(first, top)  # of both averages and maxima the latter


@query("anomaly_all_axes", f"SELECT t, z, x, {r('value - avg(value) OVER ()', 'value')} FROM ev")
def _anomaly_all(e: Engine) -> Cube:
    return elementwise.anomaly(e.catalog.cube("ev"), "tzx")


@query("anomaly_by_type", f"SELECT t, z, x, {r('value - avg(value) OVER (PARTITION BY z)', 'value')} FROM ev")
def _anomaly_type(e: Engine) -> Cube:
    return elementwise.anomaly(e.catalog.cube("ev"), "tx")


# Calendar -----------------------------------------------------------------------------------

_CYCLES = {"hour": "hour(t)", "month": "month(t) - 1", "season": "CAST(floor((month(t) % 12) / 3) AS BIGINT)"}
_ITEMS = {
    "month": "(year(t) - year((SELECT min(t) FROM li))) * 12 + month(t) - month((SELECT min(t) FROM li))",
    "year": "year(t) - year((SELECT min(t) FROM li))",
    "monthof": "month(t) - 1",
    "all": "0",
}
for _cycle, _bin in _CYCLES.items():
    for _step, _item in _ITEMS.items():
        request(
            f"binave_{_cycle}_{_step}",
            ask(f'{{"name":"cube.binAve","input":"price","cycle":"{_cycle}","bin":"{_step}"}}', var("li", "price")),
            f"SELECT CAST({_bin} AS INTEGER) AS bin, CAST({_item} AS INTEGER) AS item, {r('avg(price)', 'price')} FROM li GROUP BY 1, 2",
        )
request("bin_diurnal_max", ask('{"name":"cube.bin","input":"value","cycle":"diurnal","bin":"all","mapreduceOp":"max"}', var("ev", "value")), "SELECT CAST(hour(t) AS INTEGER) AS bin, 0 AS item, max(value) AS value FROM ev GROUP BY 1")
request("bin_season_sum", ask('{"name":"cube.bin","input":"quantity","cycle":"season","bin":"year"}', var("li", "quantity")), f"SELECT CAST({_CYCLES['season']} AS INTEGER) AS bin, CAST({_ITEMS['year']} AS INTEGER) AS item, sum(quantity) AS quantity FROM li GROUP BY 1, 2")
request("time_bin", ask('{"name":"cube.timeBin","input":"price","axes":"tx"}', var("li", "price")), f"SELECT CAST(month(t) - 1 AS INTEGER) AS bin, round(y, {DIGITS}) AS y, {r('avg(price)', 'price')} FROM li GROUP BY 1, y", t="bin")
request(
    "time_bin_general",
    ask('{"name":"cube.timeBin","input":"price","axes":"txy","unit":"month","period":3,"mod":4,"offset":1}', var("li", "price")),
    f"SELECT CAST(floor(({_ITEMS['month']} + 1) / 3) % 4 AS INTEGER) AS bin, {r('avg(price)', 'price')} FROM li GROUP BY 1",
    t="bin",
)
_PIVOT = ", ".join(r(f'avg(CASE WHEN {_CYCLES["season"]} = {i} THEN price END)', f'"{i}"') for i in range(4))


@query("bin_arrays", f"SELECT CAST({_ITEMS['year']} AS INTEGER) AS item, {_PIVOT} FROM li GROUP BY 1")
def _arrays(e: Engine) -> DataFrame:
    return timebin.as_series(timebin.binned(e.catalog.cube("li", ["price"]), "season", "year"), "price", 4)


@query("calendar_fields", "SELECT CAST(year(t) % 100 AS INTEGER) AS century_year, CAST(month(t) AS INTEGER) AS month, CAST(day(t) AS INTEGER) AS day, max(CAST(dayofyear(t) AS INTEGER)) AS day_of_year, count(*) AS n FROM li GROUP BY 1, 2, 3")
def _fields(e: Engine) -> DataFrame:
    df = e.catalog.cube("li", ["price"]).df
    return df.groupBy((F.year("t") % 100).alias("century_year"), F.month("t").alias("month"), F.dayofmonth("t").alias("day")).agg(F.max(F.dayofyear("t")).alias("day_of_year"), F.count("*").alias("n"))


# Resampling and regridding ------------------------------------------------------------------

_RESAMPLED = f"""SELECT g.t, {r("CASE WHEN n IS NULL OR g.t <= s.t THEN v ELSE v + (nv - v) * (epoch_us(g.t) - epoch_us(s.t)) / (epoch_us(n) - epoch_us(s.t)) END", 'price')}
    FROM (SELECT DISTINCT t FROM od) g
    JOIN (SELECT t, v, lead(t) OVER (ORDER BY t) AS n, lead(v) OVER (ORDER BY t) AS nv, lag(t) OVER (ORDER BY t) AS b FROM (SELECT t, avg(price) AS v FROM li WHERE day(t) IN (3, 17) GROUP BY t)) s
    ON (g.t >= s.t OR b IS NULL) AND (g.t < n OR n IS NULL)"""


@query("resample_time", _RESAMPLED)
def _resample(e: Engine) -> Cube:
    days = e.catalog.cube("li", ["price"]).where(F.dayofmonth("t").isin(3, 17), ("days",))
    return resample.resample(reduce.reduce_cube(days, "average", "yx"), e.catalog.cube("od"))


#: Latitudes and longitudes of the target grid of the regridding query.
TARGET = (np.array([-60.0, -25.0, 0.0, 33.0, 70.0]), np.array([5.0, 95.0, 187.0, 355.0]))


def _weights_sql(axis: str, source: str, target: np.ndarray, wrap: bool) -> str:
    around = f" UNION ALL SELECT max({axis}) - 360, max({axis}) FROM {source} UNION ALL SELECT min({axis}) + 360, min({axis}) FROM {source}" if wrap else ""
    return f"""(SELECT target, {axis}, 1 - w AS w FROM (
        SELECT g AS target, k, n, a AS {axis}, b, CASE WHEN n IS NULL THEN 0 ELSE greatest(0, least(1, (g - k) / (n - k))) END AS w
        FROM (SELECT unnest([{', '.join(map(str, target.tolist()))}]::DOUBLE[]) AS g)
        JOIN (SELECT k, lead(k) OVER (ORDER BY k) AS n, a, lead(a) OVER (ORDER BY k) AS b FROM (SELECT {axis} AS k, {axis} AS a FROM (SELECT DISTINCT {axis} FROM {source}){around})) ON g >= k AND (g < n OR n IS NULL)
    ) UNION ALL SELECT target, b AS {axis}, w FROM (
        SELECT g AS target, a, b, greatest(0, least(1, (g - k) / (n - k))) AS w
        FROM (SELECT unnest([{', '.join(map(str, target.tolist()))}]::DOUBLE[]) AS g)
        JOIN (SELECT k, lead(k) OVER (ORDER BY k) AS n, a, lead(a) OVER (ORDER BY k) AS b FROM (SELECT {axis} AS k, {axis} AS a FROM (SELECT DISTINCT {axis} FROM {source}){around})) ON g >= k AND g < n
    ) WHERE w > 0)"""


def _regrid_sql(lats: np.ndarray, lons: np.ndarray) -> str:
    return f""", field AS (SELECT y, CAST(x % 36 * 10 AS DOUBLE) AS x, avg(price) AS price FROM li GROUP BY y, 2)
    SELECT {r('wy.target', 'y')}, {r('wx.target', 'x')}, {r('sum(wy.w * wx.w * price) / sum(wy.w * wx.w)', 'price')}
    FROM field JOIN {_weights_sql('y', 'field', lats, False)} wy ON field.y = wy.y JOIN {_weights_sql('x', 'field', lons, True)} wx ON field.x = wx.x
    GROUP BY wy.target, wx.target"""


def _field(e: Engine) -> Cube:
    cube = e.catalog.cube("li", ["price"])
    df = cube.df.withColumn("x", (F.col("x") % 36 * 10).cast("double"))
    return reduce.reduce_cube(Cube(df, cube.axes, ("price",)), "average", "t")


@query("regrid_bilinear", _regrid_sql(*TARGET))
def _regrid(e: Engine) -> Cube:
    return regrid.regrid(_field(e), *TARGET)


@query("regrid_gaussian", _regrid_sql(*regrid.target_grid("gaussian~8", {})))
def _gaussian(e: Engine) -> Cube:
    return regrid.regrid(_field(e), *regrid.target_grid("gaussian~8", {}))


# User operations, embeddings and streams ------------------------------------------------------


@query("user_reduction", "SELECT z, max(value) AS value FROM ev GROUP BY z")
def _user_reduction(e: Engine) -> Cube:
    custom = udf.user_reduction("user.largest", lambda cells: cells.max(), lambda a, b: np.maximum(a, b))
    return custom.run([e.catalog.cube("ev")], {"axes": "tx"})


@query("resample_cells", f"""
    , s AS (SELECT z, t, v, lead(t) OVER w AS n, lead(v) OVER w AS nv, lag(t) OVER w AS b FROM (SELECT z, date_trunc('day', t) AS t, avg(value) AS v FROM ev GROUP BY 1, 2) WINDOW w AS (PARTITION BY z ORDER BY t))
    SELECT g.t, z, {r("CASE WHEN n IS NULL OR g.t <= s.t THEN v ELSE v + (nv - v) * (epoch_us(g.t) - epoch_us(s.t)) / (epoch_us(n) - epoch_us(s.t)) END", 'value')}
    FROM (SELECT DISTINCT date_trunc('hour', t) AS t FROM ev WHERE x < 20) g JOIN s ON (g.t >= s.t OR b IS NULL) AND (g.t < n OR n IS NULL)""")
def _resample_cells(e: Engine) -> Cube:
    cube = e.catalog.cube("ev")
    daily = Cube(cube.df.groupBy("z", F.date_trunc("day", "t").cast("timestamp_ntz").alias("t")).agg(F.avg("value").alias("value")), ("t", "z"), ("value",))
    hours = Cube(cube.df.where("x < 20").select(F.date_trunc("hour", "t").cast("timestamp_ntz").alias("t")), ("t",), ())
    return resample.resample(daily, hours)


@query("user_map", f"SELECT t, z, x, {r('value * value + 1', 'value')} FROM ev")
def _user_map(e: Engine) -> Cube:
    return udf.user_map("user.square", lambda s: s * s + 1).run([e.catalog.cube("ev")], {})


@query("embedding_norms", f"SELECT z, {r('sqrt(sum(element * element))', 'element')} FROM em GROUP BY z")
def _norms(e: Engine) -> DataFrame:
    return e.catalog.cube("em").df.groupBy("z").agg(F.sqrt(F.sum(F.col("element") * F.col("element"))).alias("element"))


def _streamed(spark: SparkSession, sf_dir: str, make) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    # a table is one file or a folder of them
    stream = streaming.slabs(spark, f"{sf_dir}/events.parquet*", schema)
    name = f"stream_{uuid.uuid4().hex}"
    run = make(stream).writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.table(name)


def _stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _streamed(spark, sf_dir, lambda s: streaming.windowed(s, "value", "average", "ts", "6 hours", keys=("event_type",)))
    return rounded(found.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "value"))


def _stream_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_streamed(spark, sf_dir, lambda s: streaming.cycles(s, "value", "max", "ts", "hour")))


QUERIES |= {"stream_windows": _stream_windows, "stream_cycles": _stream_cycles}
ORACLE_SQL |= {
    "stream_windows": f"SELECT time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '1970-01-01') AS start, event_type, {r('avg(value)', 'value')} FROM events GROUP BY 1, 2",
    "stream_cycles": "SELECT CAST(hour(ts) AS INTEGER) AS bin, max(value) AS value FROM events GROUP BY 1",
}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deviation by user in a span of time: average, difference and root of squares, fused into one aggregate."""
    return QUERIES["workflow_deviation"](spark, sf_dir)
