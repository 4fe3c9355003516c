"""The catalog: names for datasets, and regions of them that are kept.

A collection is a Parquet file, a directory of such files (also nested), a text file that lists files, a
classic NetCDF file, or a DataFrame, with its axes and variables. OPeNDAP needs a network and is refused
with that reason.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cubelark.cube import Cube, CubeError, Grid, valid
from cubelark.operators.subset import Domain, Range, contains, cut, moment

#: Suffixes that are array files.
ARRAY_FILES = (".nc", ".nc4", ".h5", ".hdf", ".ncml")


@dataclass(frozen=True)
class Collection:
    """``kind`` is parquet, directory, csv (a list of files) or frame; ``axes`` maps letters to columns."""

    name: str
    kind: str
    uri: str
    axes: dict[str, str | Column]
    variables: dict[str, str | Column]
    missing: float | None = None
    title: str = ""
    frame: DataFrame | None = field(default=None, compare=False)
    file_filter: str = "*.parquet"


def _value(r: Range, value: object):
    return moment(value) if r.axis == "t" and not r.system.startswith("ind") else float(value)


def _start(r: Range):
    return _value(r, r.start)


def _end(r: Range):
    return _value(r, r.end)


@dataclass
class Fragment:
    cube: Cube
    domain: Domain
    variables: tuple[str, ...]


class Catalog:
    """Collections, masks and kept fragments of one session. Names are case-insensitive."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.collections: dict[str, Collection] = {}
        self.fragments: dict[str, Fragment] = {}
        self.masks: dict[str, object] = {}
        self._frames: dict[str, DataFrame] = {}
        self._grids: dict[str, Grid] = {}

    def register(self, name: str, source: str | DataFrame, axes: dict | None = None, variables=(), missing: float | None = None, title: str = "", file_filter: str = "*.parquet") -> Collection:
        """Adds or replaces a collection; ``variables`` is a list of columns, or maps names to columns.

        Of NetCDF files (``.nc``, ``.nc4``, ``.h5``) the axes and the missing value are known, and one variable is registered.
        """
        named = dict(variables) if isinstance(variables, dict) else {v: v for v in variables}
        if isinstance(source, DataFrame):
            found = Collection(name, "frame", "", axes, named, missing, title, source)
        else:
            uri = source.removeprefix("file:") if source.startswith("file:/") else source
            if uri.startswith("http"):
                raise CubeError(f"{uri}: OPeNDAP needs a network; register a file that was read from it")
            if uri.endswith((".nc", ".nc4", ".h5")):
                from cubelark.sources.netcdf import scan

                (variable,) = named
                cube = scan(self.spark, uri, variable)
                return self.register(name, cube.df, {a: a for a in cube.axes}, named, missing, title)
            if uri.endswith(ARRAY_FILES):
                raise CubeError(f"{uri}: only NetCDF (.nc, .nc4, .h5) is read; convert others to long Parquet tables")
            kind = "csv" if uri.endswith((".csv", ".txt")) else "parquet" if uri.endswith(".parquet") else "directory"
            found = Collection(name, kind, uri, axes, named, missing, title, None, file_filter)
        self.collections[name.lower()] = found
        self._frames.pop(name.lower(), None)
        self._grids.pop(name.lower(), None)
        return found

    def register_many(self, sources: dict[str, str], axes: dict, variables, **more) -> list[Collection]:
        """One collection for each directory or list."""
        return [self.register(n, s, axes, variables, **more) for n, s in sources.items()]

    def remove(self, name: str) -> None:
        for held in (self.collections, self._frames, self._grids):
            held.pop(name.lower(), None)

    def register_mask(self, name: str, path: str) -> None:
        """A mask from the polygons of a shapefile: their borders decide cell by cell, once for each place of a grid."""
        from cubelark.sources import shapes

        rings = shapes.read(self.spark, path)
        self.masks[name] = lambda cube: shapes.cells(cube, rings)

    def collection(self, uri: str) -> Collection:
        """By ``collection:/name``, ``file:/path`` of a registered one, or a bare name."""
        scheme, mark, rest = uri.partition(":")
        name = rest.strip("/") if mark else uri
        if mark and scheme not in ("collection", "file", "fragment", "http", "https"):
            raise CubeError(f"unknown kind of source {scheme}")
        if mark and scheme.startswith("http"):
            raise CubeError(f"{uri}: OPeNDAP needs a network")
        if mark and scheme == "file":
            name = next((c.name for c in self.collections.values() if c.uri == rest.replace("//", "/")), "")
        found = self.collections.get(name.lower())
        if not found:
            raise CubeError(f"unknown collection {uri}")
        return found

    def table(self, c: Collection) -> DataFrame:
        """The collection's rows; the same DataFrame every time, so that plans can share it."""
        key = c.name.lower()
        if key not in self._frames:
            if c.kind == "frame":
                df = c.frame
            elif c.kind == "csv":
                base = c.uri.rsplit("/", 1)[0]
                lines = [r.value.strip() for r in self.spark.read.text(c.uri).collect()]  # a list of files
                paths = [p if "/" in p else f"{base}/{p}" for p in lines if p.endswith(".parquet")]
                if not paths:
                    raise CubeError(f"{c.uri} lists no files")
                df = self.spark.read.parquet(*paths)
            elif c.kind == "directory":
                df = self.spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", c.file_filter).parquet(c.uri)
            else:
                df = self.spark.read.parquet(c.uri)
            column = lambda x: F.col(x) if isinstance(x, str) else x
            selected = [column(v).alias(a) for a, v in c.axes.items()] + [valid(column(v), c.missing).alias(n) for n, v in c.variables.items()]
            self._frames[key] = df.select(*selected)
        return self._frames[key]

    def grid(self, c: Collection) -> Grid:
        """The axes of a collection; found once, when a region first needs them."""
        return self._grids.setdefault(c.name.lower(), Grid(self.table(c), [a for a in "tzyx" if a in c.axes]))

    def cube(self, uri: str, variables: list[str] | None = None, domain: Domain | None = None) -> Cube:
        """Some or all (``*``) variables of a collection, in a domain; a kept fragment answers if it holds that."""
        if uri.startswith("fragment:"):
            return self.fragment(uri)
        c = self.collection(uri)
        names = list(c.variables) if not variables or variables == ["*"] else variables
        known = {v.lower(): v for v in c.variables}
        unknown = [n for n in names if n.lower() not in known]
        if unknown:
            raise CubeError(f"collection {c.name} has no variable {', '.join(unknown)}")
        names = [known[n.lower()] for n in names]
        domain = domain or Domain("")
        held = self._held(c.name, tuple(names), domain)
        letters = tuple(a for a in "tzyx" if a in c.axes)
        whole = held.cube if held else Cube(self.table(c), letters, tuple(c.variables), (c.name,))
        found = cut(Cube(whole.df, whole.axes, whole.values, whole.origin, self.grid(c)), domain, self.masks)
        return Cube(found.df, found.axes, tuple(names), found.origin, found.grid)

    def _held(self, name: str, variables: tuple[str, ...], domain: Domain) -> Fragment | None:
        fits = (f for k, f in self.fragments.items() if k.split("|")[1] == name.lower() and set(variables) <= set(f.variables) and contains(f.domain, domain))
        return next(fits, None)

    @staticmethod
    def key(name: str, variables: tuple[str, ...], domain: Domain) -> str:
        ranges = ";".join(f"{r.axis},{r.start},{r.end},{r.system}" for r in domain.ranges)
        return f"{','.join(variables)}|{name.lower()}|{ranges}|{domain.mask or ''}"

    def cache(self, uri: str, variables: list[str] | None = None, domain: Domain | None = None) -> str:
        """Keeps a region of a collection and returns its key."""
        cube = self.cube(uri, variables, domain)
        return self._keep(self.collection(uri).name, cube, domain or Domain(""), cube.values)

    def fragment(self, uri: str) -> Cube:
        """A kept region by ``fragment:/key``."""
        key = uri.removeprefix("fragment:").lstrip("/")
        if key not in self.fragments:
            raise CubeError(f"no fragment {key}")
        return self.fragments[key].cube

    def _keep(self, name: str, cube: Cube, domain: Domain, variables: tuple[str, ...]) -> str:
        key = self.key(name, variables, domain)
        if key not in self.fragments:
            df = cube.df.select(*cube.axes, *variables).persist()
            self.fragments[key] = Fragment(Cube(df, cube.axes, variables, ("fragment", key), cube.grid), domain, variables)
        return key

    def _kept(self, key: str) -> tuple[str, Fragment]:
        key = key.removeprefix("fragment:").lstrip("/")
        if key not in self.fragments:
            raise CubeError(f"no fragment {key}")
        return key.split("|")[1], self.fragments[key]

    def section(self, key: str, domain: Domain) -> str:
        """Keeps a part of a kept region, which must hold it, and returns its key."""
        name, found = self._kept(key)
        if not contains(found.domain, domain):
            raise CubeError(f"fragment {key} doesn't hold that region")
        return self._keep(name, cut(found.cube, domain, self.masks), domain, found.variables)

    def combine(self, first: str, second: str) -> str:
        """Keeps the union of two kept regions that differ in the range of one axis and overlap or touch there; returns its key."""
        (name, a), (other, b) = self._kept(first), self._kept(second)
        if name != other or a.variables != b.variables or a.domain.mask != b.domain.mask:
            raise CubeError("only regions of one collection, its variables and mask can be combined")
        mine, theirs = ({r.axis: r for r in f.domain.ranges} for f in (a, b))
        differ = [x for x in mine if mine[x] != theirs.get(x)]
        if set(mine) != set(theirs) or len(differ) > 1:
            raise CubeError("only regions that differ in the range of one axis can be combined")
        if not differ:
            return first
        low, high = sorted((mine[differ[0]], theirs[differ[0]]), key=_start)
        touching = int(high.start) <= int(low.end) + 1 if low.system.startswith("ind") else _start(high) <= _end(low)
        if low.system != high.system or not touching:
            raise CubeError("regions that don't touch can't be combined")
        whole = Range(low.axis, low.start, max((low, high), key=_end).end, low.system)
        domain = Domain("", tuple(whole if r.axis == low.axis else r for r in a.domain.ranges), a.domain.mask)
        # cells of both are of one collection: those of the second that the first has are left out
        again = cut(b.cube, a.domain).df
        rest = b.cube.df.join(again.select(*a.cube.axes).distinct(), list(a.cube.axes), "left_anti")
        return self._keep(name, Cube(a.cube.df.unionByName(rest), a.cube.axes, a.variables, (), a.cube.grid), domain, a.variables)

    def drop(self, key: str | None = None) -> None:
        """Forgets one fragment, or all."""
        for k in [key] if key else list(self.fragments):
            if found := self.fragments.pop(k, None):
                found.cube.df.unpersist()

    def axis_table(self, uri: str, axis: str) -> DataFrame:
        """``idx, coord`` of an axis of a collection."""
        cube = self.cube(uri)
        rows = [(i, x.item() if hasattr(x, "item") and axis != "t" else x.astype("datetime64[us]").astype(object)) for i, x in enumerate(cube.coordinates(axis))]
        return self.spark.createDataFrame(rows, f"idx int, coord {cube.df.schema[axis].dataType.simpleString()}")

    def save(self, path: str) -> None:
        """Writes the collections that are files to a JSON file."""
        rows = [{"name": c.name, "uri": c.uri, "axes": c.axes, "variables": c.variables, "missing": c.missing, "title": c.title} for c in self.collections.values() if c.kind != "frame"]
        with open(path, "w") as out:
            json.dump(rows, out, indent=1)

    def load(self, path: str) -> None:
        with open(path) as lines:
            for r in json.load(lines):
                self.register(r["name"], r["uri"], r["axes"], r["variables"], r["missing"], r["title"])
