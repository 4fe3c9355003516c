"""The registry of operations, and operations made by users.

A user operation maps pandas blocks: ``map`` gets the cells of a group and returns rows; with ``reduce``
set, partial results of blocks are reduced by a second function. Built-ins never run Python.
"""

from __future__ import annotations

import functools
import importlib
import pkgutil
from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import functions as F

from cubelark.cube import Cube, CubeError

#: Partial results that a task of a custom reduction holds.
HELD = 50_000


@dataclass(frozen=True)
class Operation:
    """``run(cubes, options)`` gives a cube or a DataFrame; ``inputs`` is the least and most number of inputs."""

    name: str
    run: Callable
    inputs: tuple[int, int] = (1, 1)
    description: str = ""
    options: tuple[str, ...] = ()
    aliases: tuple[str, ...] = field(default=())


REGISTRY: dict[str, Operation] = {}


def register(operation: Operation) -> Operation:
    """Adds an operation under its name and aliases, which are case-insensitive."""
    for name in (operation.name, *operation.aliases):
        REGISTRY[name.lower()] = operation
    return operation


def lookup(name: str) -> Operation:
    """By full name; else by family and kernel, where a family may end in ``module`` or ``ext``; else the kernel of ``cube``.

    So requests that call kernels by other modules' names are understood.
    """
    *path, kernel = name.lower().split(".")
    family = path[-1].removesuffix("module").removesuffix("ext") if path else "cube"
    for known in (name.lower(), f"{family}.{kernel}", f"cube.{kernel}"):
        if known in REGISTRY:
            return REGISTRY[known]
    raise CubeError(f"unknown operation {name}")


def user_reduction(name: str, map_: Callable[[pd.DataFrame], pd.Series], reduce_: Callable[[pd.Series, pd.Series], pd.Series]) -> Operation:
    """A reduction given by a function of a block of cells (to one number for each value) and one of two results.

    ``reduce_`` must be associative and commutative. Blocks are mapped and combined where the cells are, before any
    shuffle; partial results are then combined as a tree, so that no task holds all of a group.
    """

    def run(cubes: list[Cube], options: dict) -> Cube:
        from cubelark.operators.reduce import reduced_axes

        (cube,) = cubes
        keep = [a for a in cube.axes if a not in reduced_axes(cube, options.get("axes", ""))]
        kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cube.df.select(*keep).schema)
        schema = ", ".join(filter(None, [kinds, *(f"{v} double" for v in cube.values)]))
        values = list(cube.values)

        def combined(held: list[pd.DataFrame]) -> pd.DataFrame:
            """One row for each group of partial results."""
            rows = pd.concat(held, ignore_index=True)
            groups = rows.groupby(keep, dropna=False, sort=False).indices.values() if keep else [range(len(rows))]
            partial = rows[values]
            out = [(places[0], functools.reduce(reduce_, (partial.iloc[i] for i in places))) for places in groups]
            first = rows.iloc[[i for i, _ in out]].reset_index(drop=True)
            return first[keep].assign(**{v: [float(r[v]) for _, r in out] for v in values}) if keep else pd.DataFrame({v: [float(r[v]) for _, r in out] for v in values})

        def blocks(frames):
            """Results of blocks, combined as they come: a task gives a row for each of its groups."""
            held, n = [], 0
            for cells in frames:
                if cells.empty:
                    continue
                groups = [(cells.iloc[i[:1]][keep], map_(cells.iloc[i][values])) for i in cells.groupby(keep, dropna=False, sort=False).indices.values()] if keep else [(None, map_(cells[values]))]
                found = pd.DataFrame({v: [r[v] for _, r in groups] for v in values})
                held.append(pd.concat([pd.concat([k for k, _ in groups], ignore_index=True), found], axis=1) if keep else found)
                n += len(found)
                if n > HELD:
                    held = [combined(held)]
                    n = len(held[0])
                    if n > HELD // 2:  # mostly different groups: nothing is won by waiting
                        yield held[0]
                        held, n = [], 0
            if held:
                yield combined(held)

        partial = cube.df.select(*keep, *values).mapInPandas(blocks, schema)
        # a tree: groups with many partial results are first combined in parts
        parts = max(1, int(cube.df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))
        dealt = partial.withColumn("_part", F.pmod(F.monotonically_increasing_id(), F.lit(max(1, int(parts**0.5)))))
        once = dealt.groupBy(*keep, "_part").applyInPandas(lambda rows: combined([rows]), schema)
        return Cube(once.groupBy(*keep).applyInPandas(lambda rows: combined([rows]), schema), tuple(keep), cube.values)

    return register(Operation(name, run, description="user reduction", options=("axes",)))


def user_map(name: str, function: Callable[[pd.Series], pd.Series]) -> Operation:
    """A point-wise operation given by a function of a pandas series of values."""

    def run(cubes: list[Cube], options: dict) -> Cube:
        (cube,) = cubes
        apply = F.pandas_udf(function, "double")
        return cube.with_values({v: apply(F.col(v)) for v in cube.values})

    return register(Operation(name, run, description="user map"))


def load(*packages: str) -> list[str]:
    """Imports modules, or all modules of packages, whose operations register themselves; returns the new names."""
    before = set(REGISTRY)
    for name in packages:
        module = importlib.import_module(name)
        for found in pkgutil.iter_modules(getattr(module, "__path__", [])):
            importlib.import_module(f"{name}.{found.name}")
    return sorted(set(REGISTRY) - before)


def capabilities() -> list[dict]:
    """Names and descriptions of all operations."""
    return [{"name": k, "description": o.description, "options": list(o.options), "inputs": list(o.inputs)} for k, o in sorted(REGISTRY.items())]
