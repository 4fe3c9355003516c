"""The kernels by the names that requests use."""

from __future__ import annotations

from cubelark.cube import Cube, CubeError, merge
from cubelark.operators import elementwise, reduce, regrid, subset, timebin
from cubelark.operators.udf import Operation, register

#: Families of kernels; ``lookup`` says which other module names mean them.
MODULE, NUMPY, CDMS = "cube", "numpy", "cdms"


def _all(cubes: list[Cube]) -> Cube:
    return merge(cubes)


def _axes(options: dict) -> str:
    return str(options.get("axes", options.get("axis", "")))


def _reduction(name: str):
    def run(cubes: list[Cube], options: dict) -> Cube:
        return reduce.reduce_cube(_all(cubes), name, _axes(options), str(options.get("weights", "")), str(options.get("n", "cells")))

    return run


for _kernel, _name, _also in (
    ("max", "max", (f"{NUMPY}.max", f"{NUMPY}.maxSer", f"{NUMPY}.maxCustRed")),
    ("min", "min", (f"{NUMPY}.min",)),
    ("sum", "sum", (f"{NUMPY}.sum",)),
    ("rmSum", "rmsum", ()),
    ("rms", "rms", ()),
    ("average", "average", (f"{NUMPY}.ave",)),
):
    register(Operation(f"{MODULE}.{_kernel}", _reduction(_name), (1, 99), f"{_name} of valid cells over axes", ("axes", "weights", "n"), _also))
for _kernel in ("std", "var", "ptp"):
    register(Operation(f"{NUMPY}.{_kernel}", _reduction(_kernel), (1, 99), f"{_kernel} of valid cells over axes", ("axes",)))


def _cosine(cubes: list[Cube], options: dict) -> Cube:
    return reduce.reduce_cube(_all(cubes), "average", _axes(options), str(options.get("weights", "cosine")))


def _area(cubes: list[Cube], options: dict) -> Cube:
    weights = options.get("weights", "generate")
    action = str(options.get("action", "average"))
    if isinstance(weights, list):
        weights = "none" if set(weights) <= {"equal", "unweighted"} else "generate"
    return reduce.reduce_cube(_all(cubes), action, _axes(options) or "xy", str(weights))


register(Operation(f"{NUMPY}.avew", _cosine, (1, 99), "mean weighted by the cosine of the latitude", ("axes",)))
register(Operation(f"{CDMS}.ave", _area, (1, 99), "area-weighted mean", ("axis", "axes", "weights", "action")))
register(Operation(f"{CDMS}.zaDemo", lambda cubes, o: reduce.zonal_season_mean(_all(cubes), str(o.get("season", "DJF"))), (1, 99), "zonal mean of a season", ("season",)))


def _dual(name: str):
    def run(cubes: list[Cube], options: dict) -> Cube:
        if len(cubes) == 1 and len(cubes[0].values) == 2:
            cube = cubes[0]
            cubes = [Cube(cube.df, cube.axes, (v,), cube.origin) for v in cube.values]
        if len(cubes) != 2:
            raise CubeError(f"{name} takes two inputs")
        return elementwise.dual(elementwise.DUAL[name], *cubes, out=str(options.get("result", name)))

    return run


for _kernel in elementwise.DUAL:
    register(Operation(f"{MODULE}.{_kernel}", _dual(_kernel), (1, 2), f"point-wise {elementwise.DUAL[_kernel]} of two inputs", ()))
register(Operation(f"{MODULE}.multiAverage", lambda cubes, o: elementwise.average(cubes), (1, 99), "point-wise mean of the valid inputs", ()))
register(Operation(f"{MODULE}.anomaly", lambda cubes, o: elementwise.anomaly(_all(cubes), _axes(o) or "t"), (1, 99), "values less their mean over axes", ("axes",)))
register(Operation(f"{MODULE}.const", lambda cubes, o: elementwise.scalar("eq", _all(cubes), float(o.get("value", 1.0))), (1, 99), "a constant where valid", ("value",)))
register(Operation(f"{MODULE}.subset", lambda cubes, o: _all(cubes), (1, 99), "the cells of the region", ("filter",)))


def _partition(cubes: list[Cube], options: dict) -> Cube:
    cube = _all(cubes)
    first = cube.axes[0]
    return Cube(cube.df.repartitionByRange(first), cube.axes, cube.values, cube.origin)


register(Operation(f"{MODULE}.partition", _partition, (1, 99), "the cells of the region, dealt by ranges of time", ("filter",)))


def _binned(default: str):
    def run(cubes: list[Cube], options: dict) -> Cube:
        cube = _all(cubes)
        how = str(options.get("mapreduceop", options.get("mapop", default)))
        how = {"ave": "average", "add": "sum"}.get(how.lower(), how)
        df = timebin.binned(cube, str(options.get("cycle", "hour")), str(options.get("bin", "month")), how)
        return Cube(df, ("bin", "item"), cube.values)

    return run


register(Operation(f"{MODULE}.binAve", _binned("average"), (1, 99), "means by place in a calendar cycle and item", ("cycle", "bin")))
register(Operation(f"{MODULE}.bin", _binned("sum"), (1, 99), "reductions by place in a calendar cycle and item", ("cycle", "bin", "mapop", "mapreduceop")))


def _time_bin(cubes: list[Cube], options: dict) -> Cube:
    number = lambda name, default: int(options.get(name, default))
    return timebin.time_bin(_all(cubes), _axes(options) or "t", str(options.get("unit", "month")), number("period", 1), number("mod", 12), number("offset", 0))


register(Operation(f"{MODULE}.timeBin", _time_bin, (1, 99), "means by place in a cycle along time", ("axes", "period", "mod", "unit", "offset")))


def _regrid(cubes: list[Cube], options: dict) -> Cube:
    crs = str(options.get("crs", options.get("gridspec", "")))
    by_name = {n: c for n, c in options.get("_named", {}).items()}
    lats, lons = regrid.target_grid(crs, by_name)
    return merge([regrid.regrid(c, lats, lons) for c in cubes])


register(Operation(f"{CDMS}.regrid", _regrid, (1, 99), "bilinear regridding", ("crs",)))


def prepared(cube: Cube, options: dict) -> Cube:
    """What every kernel does first: the season filter."""
    return subset.seasons(cube, str(options["filter"])) if options.get("filter") and "t" in cube.axes else cube
