"""NetCDF files as long tables, classic ones (versions 1 and 2) also written.

Files are read by Spark's binary source, so that any path that Spark reads will do, and unpacked by numpy
in one task a file; a file must therefore fit a task (``MOST`` bytes; the source itself ends at twice that).
NetCDF-4 files need ``h5py`` on the executors.
"""

from __future__ import annotations

import io
import re
import struct
from dataclasses import dataclass
from datetime import UTC, datetime

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from cubelark.cube import Cube, CubeError
from cubelark.operators.subset import axis_letter

MOST = 1 << 30
#: Cells that are put into the long form at once.
SLAB = 1 << 20
#: Fixed value: the first bytes of a NetCDF-4 file.
SIGNATURE = b"\x89HDF"
#: The format's numbers of types, and of lists in a header.
TYPES = {1: "i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8"}
DIMENSIONS, VARIABLES, ATTRIBUTES = 10, 11, 12
#: Seconds in the units of a time axis.
UNITS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400}


@dataclass
class Variable:
    name: str
    dims: list[int]
    attributes: dict
    kind: str
    size: int
    begin: int


class Header:
    """Dimensions, attributes and variables of a file, from its first bytes."""

    def __init__(self, data: bytes):
        if data[:3] != b"CDF" or data[3] not in (1, 2):
            raise CubeError("not a classic NetCDF file")
        self.data, self.at, self.wide = data, 4, data[3] == 2
        self.records = self._int()
        self.dims = self._list(DIMENSIONS, lambda: (self._text(), self._int()))
        self.attributes = dict(self._list(ATTRIBUTES, self._attribute))
        self.variables = {v.name: v for v in self._list(VARIABLES, self._variable)}
        growing = [v.size for v in self.variables.values() if self.grows(v)]
        self.record = growing[0] if len(growing) == 1 else sum(growing)
        if len(growing) == 1:  # a single one isn't padded
            v = next(v for v in self.variables.values() if self.grows(v))
            self.record = int(np.prod([self.dims[d][1] for d in v.dims[1:]], dtype=np.int64)) * np.dtype(v.kind).itemsize

    def _int(self) -> int:
        self.at += 4
        return struct.unpack(">i", self.data[self.at - 4 : self.at])[0]

    def _text(self) -> str:
        n = self._int()
        start, self.at = self.at, self.at + n + -n % 4
        return self.data[start : start + n].decode()

    def _list(self, mark: int, item) -> list:
        kind, n = self._int(), self._int()
        if kind not in (0, mark):
            raise CubeError("damaged NetCDF header")
        return [item() for _ in range(n)]

    def _attribute(self):
        name, kind, n = self._text(), np.dtype(TYPES[self._int()]), self._int()
        size = n * kind.itemsize
        start, self.at = self.at, self.at + size + -size % 4
        raw = self.data[start : start + size]
        found = raw.decode(errors="replace") if kind == "S1" else np.frombuffer(raw, kind).tolist()
        return name, found[0] if isinstance(found, list) and len(found) == 1 else found

    def _variable(self) -> Variable:
        name = self._text()
        dims = [self._int() for _ in range(self._int())]
        attributes = dict(self._list(ATTRIBUTES, self._attribute))
        kind, size = TYPES[self._int()], self._int()
        begin = self._int() if not self.wide else self._int() << 32 | self._int() & 0xFFFFFFFF
        return Variable(name, dims, attributes, kind, size, begin)

    def grows(self, v: Variable) -> bool:
        return bool(v.dims) and self.dims[v.dims[0]][1] == 0

    def shape(self, v: Variable) -> tuple[int, ...]:
        return tuple(n or self.records for _, n in (self.dims[d] for d in v.dims))

    def read(self, data: bytes, name: str) -> np.ndarray:
        """The values of a variable; ``data`` is the whole file."""
        v, shape = self.variables[name], self.shape(self.variables[name])
        count = int(np.prod(shape, dtype=np.int64))
        if not self.grows(v):
            return np.frombuffer(data, v.kind, count, v.begin).reshape(shape)
        each = count // max(shape[0], 1)
        rows = [np.frombuffer(data, v.kind, each, v.begin + i * self.record) for i in range(shape[0])]
        return np.stack(rows).reshape(shape) if rows else np.zeros(shape, v.kind)


def missing_value(v: Variable) -> float | None:
    """The first attribute whose name has ``missing`` in it, else ``_FillValue``."""
    found = next((x for n, x in v.attributes.items() if "missing" in n.lower()), v.attributes.get("_FillValue"))
    return None if found is None else float(found)


def axes_of(header: Header, v: Variable) -> dict[str, str]:
    """Axis letters and the coordinate variable of each dimension, by CF axis attribute or by name."""
    out = {}
    for d in v.dims:
        name = header.dims[d][0]
        own = header.variables.get(name)
        letter = str(own.attributes.get("axis", "")).lower() if own else ""
        out[letter if letter in ("t", "z", "y", "x") else axis_letter(name) or name.lower()[0]] = name
    if set(out) - set("tzyx") or len(out) < len(v.dims):
        raise CubeError(f"variable {v.name}: unknown axes {', '.join(header.dims[d][0] for d in v.dims)}")
    return out


def seconds(values: np.ndarray, units: str) -> np.ndarray:
    """Microseconds since 1970 of a time axis ``<unit>s since <date>``."""
    found = re.match(r"\s*(second|minute|hour|day)s?\s+since\s+(\d{1,4})-(\d{1,2})-(\d{1,2})(?:[T ](\d{1,2}):(\d{1,2})(?::(\d{1,2}))?)?", units)
    if not found:
        raise CubeError(f"unknown time units {units}")
    unit, *parts = found.groups()
    start = datetime(*(int(p or 0) for p in parts), tzinfo=UTC).timestamp()
    return np.round((values.astype(float) * UNITS[unit] + start) * 1e6).astype(np.int64)


class Hdf:
    """A NetCDF-4 file, through ``h5py``: what ``Header`` has of a classic one."""

    def __init__(self, data: bytes):
        try:
            import h5py
        except ImportError:
            raise CubeError("NetCDF-4 files need the h5py library") from None
        self.file = h5py.File(io.BytesIO(data), "r")
        sizes: dict[str, int] = {}
        self.variables = {}
        for name, found in self.file.items():
            if not hasattr(found, "shape"):
                continue
            own = [d[0].name.rsplit("/", 1)[-1] if len(d) else name for d in found.dims] if found.shape else []
            sizes |= dict(zip(own, found.shape, strict=True))
            notes = {k: v.decode() if isinstance(v, bytes) else v.item() if getattr(v, "size", 0) == 1 else v for k, v in found.attrs.items()}
            self.variables[name] = Variable(name, own, notes, found.dtype.str, 0, 0)
        names = list(sizes)
        self.dims = list(sizes.items())
        for v in self.variables.values():
            v.dims = [names.index(d) for d in v.dims]

    def shape(self, v: Variable) -> tuple[int, ...]:
        return tuple(self.dims[d][1] for d in v.dims)

    def read(self, data: bytes, name: str) -> np.ndarray:
        return np.asarray(self.file[name][...])


def opened(data: bytes) -> Header | Hdf:
    """A file of either format, by its first bytes."""
    return Hdf(data) if data[:4] == SIGNATURE else Header(data)


def scan(spark: SparkSession, path: str, variable: str) -> Cube:
    """A variable of all files of a path (a file, a folder, or a pattern), joined along time."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{nc,nc4,h5}").load(path)

    def letters_of(batches):
        """The axes of the variable, of the first file alone; the header may be of any size."""
        for batch in batches:
            for content in batch.column("content").to_pylist():
                own = opened(content)
                found = "".join(axes_of(own, own.variables[variable])) if variable in own.variables else None
                yield pa.RecordBatch.from_arrays([pa.array([found], pa.string())], ["axes"])

    first = files.select("content").limit(1).mapInArrow(letters_of, "axes string").first()
    if first is None:
        raise CubeError(f"{path} has no NetCDF files")
    if first["axes"] is None:
        raise CubeError(f"{path} has no variable {variable}")
    letters = [a for a in "tzyx" if a in first["axes"]]
    kinds = {a: "timestamp_ntz" if a == "t" else "double" for a in letters}

    def cells(batches):
        for batch in batches:
            for content, size in zip(batch.column("content").to_pylist(), batch.column("length").to_pylist(), strict=True):
                if size > MOST:
                    raise CubeError(f"a NetCDF file of {size} bytes: split it along time, {MOST} are read at once")
                own = opened(content)
                v = own.variables[variable]
                names = axes_of(own, v)
                values = own.read(content, variable).astype(float).reshape(-1)
                scale, offset, gap = float(v.attributes.get("scale_factor", 1)), float(v.attributes.get("add_offset", 0)), missing_value(v)
                hole = np.isnan(values) if gap is None else np.isnan(values) | (values == np.float64(np.dtype(v.kind).type(gap)))
                coordinates = {}
                for i, a in enumerate(names):
                    c = own.read(content, names[a]) if names[a] in own.variables else np.arange(own.shape(v)[i])
                    coordinates[a] = seconds(c, str(own.variables[names[a]].attributes.get("units", "seconds since 1970-01-01"))) if a == "t" else c.astype(float)
                for low in range(0, len(values), SLAB):  # the long form of a slab at a time
                    high = min(low + SLAB, len(values))
                    grid = dict(zip(names, np.unravel_index(np.arange(low, high), own.shape(v)), strict=True))
                    columns = [pa.array(coordinates[a][grid[a]], pa.timestamp("us") if a == "t" else pa.float64()) for a in letters]
                    columns.append(pa.array(values[low:high] * scale + offset, mask=hole[low:high]))
                    yield pa.RecordBatch.from_arrays(columns, [*letters, variable])

    schema = ", ".join([*(f"{a} {kinds[a]}" for a in letters), f"`{variable}` double"])
    df = files.select("content", "length").mapInArrow(cells, schema)
    return Cube(df, tuple(letters), (variable,), ("netcdf", path, variable))


def encode(axes: dict[str, np.ndarray], values: np.ndarray, name: str, missing: float = 1e20) -> bytes:
    """A classic file of one variable over its axes; times are seconds since 1970."""
    names = {"t": "time", "z": "level", "y": "lat", "x": "lon"}
    text = lambda s: struct.pack(">i", len(s)) + s.encode() + b"\0" * (-len(s) % 4)
    number = lambda *x: struct.pack(f">{len(x)}i", *x)
    string = lambda k, s: text(k) + number(2) + text(s)
    dims = list(axes)
    arrays = [(names[a], [i], np.asarray(axes[a], ">f8"), [("axis", a.upper())] + ([("units", "seconds since 1970-01-01 00:00:00")] if a == "t" else [])) for i, a in enumerate(dims)]
    filled = np.where(np.isnan(values), missing, values).astype(">f8")
    arrays.append((name, list(range(len(dims))), filled, []))

    def head(begins: list[int]) -> bytes:
        out = b"CDF\x02" + number(0) + (number(DIMENSIONS, len(dims)) if dims else number(0, 0))
        out += b"".join(text(names[a]) + number(len(axes[a])) for a in dims) + number(0, 0) + number(VARIABLES, len(arrays))
        for (n, d, data, notes), begin in zip(arrays, begins, strict=True):
            own = [string(*x) for x in notes] + ([text("missing_value") + number(6, 1) + struct.pack(">d", missing)] if n == name else [])
            out += text(n) + number(len(d), *d) + (number(ATTRIBUTES, len(own)) + b"".join(own) if own else number(0, 0)) + number(6, data.nbytes) + struct.pack(">q", begin)
        return out

    start = len(head([0] * len(arrays)))
    begins = (start + np.r_[0, np.cumsum([a[2].nbytes for a in arrays])[:-1]]).astype(int).tolist()
    return head(begins) + b"".join(a[2].tobytes() for a in arrays)


def write(df: DataFrame, cube: Cube, path: str, most: int = 5_000_000) -> str:
    """Writes a small result, of one variable, as a NetCDF file; larger ones belong in Parquet."""
    (name,) = cube.values
    found = df.select(*cube.axes, name).limit(most + 1)
    if found.count() > most:  # before anything comes to the driver
        raise CubeError(f"over {most} cells: write Parquet instead")
    rows = found.toPandas()
    axes = {a: np.sort(rows[a].unique()) for a in cube.axes}
    values = np.full([len(v) for v in axes.values()], np.nan)
    values[tuple(np.searchsorted(axes[a], rows[a].to_numpy()) for a in axes)] = rows[name].to_numpy()
    as_seconds = {a: v.astype("datetime64[us]").astype(np.int64) / 1e6 if a == "t" else v.astype(float) for a, v in axes.items()}
    spark = df.sparkSession  # by Spark's file systems, so that executors can read it wherever it is
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = place.getFileSystem(spark._jsc.hadoopConfiguration()).create(place, True)
    try:
        out.write(bytearray(encode(as_seconds, values, name)))
    finally:
        out.close()
    return path
