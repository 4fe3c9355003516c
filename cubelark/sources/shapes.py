"""Polygons of shapefiles as masks."""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cubelark.cube import Cube, CubeError

#: The format's file code, its version, and its types of polygons (plain, with heights, with measures).
CODE, VERSION, POLYGONS = 9994, 1000, (5, 15, 25)

Rings = list[np.ndarray]


def decode(data: bytes) -> Rings:
    """All rings (arrays of lon, lat corners) of a shapefile's polygons."""
    if len(data) < 100 or struct.unpack(">i", data[:4])[0] != CODE:
        raise CubeError("not a shapefile")
    rings, at = [], 100
    while at + 12 <= len(data):
        words, kind = struct.unpack(">i", data[at + 4 : at + 8])[0], struct.unpack("<i", data[at + 8 : at + 12])[0]
        if kind in POLYGONS:
            parts, points = struct.unpack("<2i", data[at + 44 : at + 52])
            starts = [*struct.unpack(f"<{parts}i", data[at + 52 : at + 52 + 4 * parts]), points]
            corners = np.frombuffer(data, "<f8", 2 * points, at + 52 + 4 * parts).reshape(-1, 2)
            rings += [corners[a:b] for a, b in zip(starts, starts[1:], strict=False)]
        elif kind:
            raise CubeError(f"a shapefile of shapes of type {kind}, not of polygons")
        at += 8 + 2 * words
    return rings


def encode(rings: Rings) -> bytes:
    """A shapefile of one polygon."""
    corners = np.concatenate([np.asarray(r, "<f8") for r in rings])
    box = struct.pack("<4d", *corners.min(axis=0), *corners.max(axis=0))
    starts = np.cumsum([0, *map(len, rings)])[:-1].astype("<i4")
    shape = struct.pack("<i", POLYGONS[0]) + box + struct.pack("<2i", len(rings), len(corners)) + starts.tobytes() + corners.tobytes()
    size = (100 + 8 + len(shape)) // 2
    head = struct.pack(">7i", CODE, 0, 0, 0, 0, 0, size) + struct.pack("<2i", VERSION, POLYGONS[0]) + box + bytes(32)
    return head + struct.pack(">2i", 1, len(shape) // 2) + shape


def read(spark: SparkSession, path: str) -> Rings:
    """The rings of a shapefile that Spark can read; borders of a map, which every executor gets."""
    row = spark.read.format("binaryFile").load(path).select("content").first()
    if row is None:
        raise CubeError(f"no shapefile {path}")
    return decode(bytes(row["content"]))


def inside(xs: np.ndarray, ys: np.ndarray, rings: Rings) -> np.ndarray:
    """Whether points are inside: an odd number of edges is crossed on the way east, holes being rings of their own."""
    odd = np.zeros(len(xs), bool)
    for ring in rings:
        for (x1, y1), (x2, y2) in zip(ring, np.roll(ring, -1, axis=0), strict=True):
            if y1 != y2:
                odd ^= ((ys < y1) != (ys < y2)) & (xs < (ys - y1) * ((x2 - x1) / (y2 - y1)) + x1)
    return odd


def cells(cube: Cube, rings: Rings) -> DataFrame:
    """``y, x`` of a cube's columns of cells whose centres are inside; each is tested once."""

    def run(batches):
        for batch in batches:
            xs, ys = (batch.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in ("x", "y"))
            # longitudes of the other convention, too
            other = np.where((xs > 180) & (xs <= 360), xs - 360, np.where((xs < 0) & (xs >= -180), xs + 360, xs))
            hit = inside(xs, ys, rings) | inside(other, ys, rings)
            yield batch.filter(pa.array(hit))

    centres = cube.df.select("y", "x").where(F.col("y").isNotNull() & F.col("x").isNotNull()).distinct()
    return centres.mapInArrow(run, centres.schema)
