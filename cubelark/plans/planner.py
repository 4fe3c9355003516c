"""From a request to a DataFrame for each product.

Nodes are planned once each, in topological order; domains become predicates on the inputs; average,
difference and root of squares over one source are fused into one aggregate without a join.
"""

from __future__ import annotations

from graphlib import CycleError, TopologicalSorter

from pyspark.sql import functions as F

from cubelark.cube import Cube, CubeError
from cubelark.operators import elementwise, kernels, resample, subset
from cubelark.operators.udf import lookup
from cubelark.plans.request import Node, Request
from cubelark.sources.catalog import Catalog

#: What a node gives: a cube.
Planned = dict[str, Cube]


def _order(request: Request) -> list[Node]:
    nodes = {n.rid: n for n in request.operations}
    try:
        order = TopologicalSorter({n.rid: [x for x in n.inputs if x in nodes] for n in request.operations}).static_order()
        return [nodes[x] for x in order]
    except CycleError as e:
        raise CubeError(f"operations depend on each other: {' -> '.join(e.args[1])}") from None


def _is(node: Node | None, kernel: str) -> bool:
    return node is not None and node.name.lower().endswith(f".{kernel}")


def _fused(node: Node, nodes: dict[str, Node], request: Request, load) -> Cube | None:
    """``rms(diff2(v, average(v)))`` over the same axes, and ``diff2(v, average(v))``, from one scan of ``v``."""
    diff = nodes.get(node.inputs[0]) if _is(node, "rms") and len(node.inputs) == 1 else node
    if not _is(diff, "diff2") or len(diff.inputs) != 2 or diff.inputs[0] not in request.variables:
        return None
    mean = nodes.get(diff.inputs[1])
    if not _is(mean, "average") or mean.inputs != diff.inputs[:1] or mean.options.get("weights"):
        return None
    if mean.domains != diff.domains or mean.options.get("filter") != diff.options.get("filter"):
        return None
    axes = str(mean.options.get("axes", "")).lower()
    if node is diff:
        source = load(diff, diff.inputs[0])
        return elementwise.anomaly(source, axes or "".join(source.axes))
    if node.domains not in ((), diff.domains) or node.options.get("filter") or sorted(str(node.options.get("axes", "")).lower()) != sorted(axes):
        return None
    source = load(diff, diff.inputs[0])
    return elementwise.deviation(source, axes or "".join(source.axes))


def plan(request: Request, catalog: Catalog) -> Planned:
    """A lazy cube for each product of the request, by its result's name."""
    nodes = {n.rid: n for n in request.operations}
    sources: dict[tuple, Cube] = {}
    done: dict[str, Cube] = {}

    def load(node: Node, name: str) -> Cube:
        """An input, cut to its own domain and the node's."""
        if name in done:
            cube = done[name]
        else:
            v = request.variables[name]
            key = (v.uri, v.domain, v.name)
            if key not in sources:
                found = catalog.cube(v.uri, [v.name], request.domains.get(v.domain))
                sources[key] = found
            cube = sources[key]
        for d in node.domains:
            cube = subset.cut(cube, request.domains[d], catalog.masks)
            trs = request.domains[d].get("trs")
            if trs and trs.startswith("~"):
                target = load(Node("", (), ()), trs[1:])
                if trs[1:] != name:
                    cube = resample.resample(cube, target)
        return kernels.prepared(cube, node.options)

    def aliased(name: str, cube: Cube) -> Cube:
        """One variable under its alias; a node's under its own name."""
        if len(cube.values) == 1 and name in request.variables and cube.values[0] != name:
            return Cube(cube.df.withColumnRenamed(cube.values[0], name), cube.axes, (name,), (), cube.grid)
        return cube

    for node in _order(request):
        fused = _fused(node, nodes, request, load)
        if fused is not None:
            done[node.rid] = fused
            continue
        operation = lookup(node.name)
        loaded = {x: load(node, x) for x in node.inputs}
        inputs = shared(loaded) or [aliased(x, c) for x, c in loaded.items()]
        low, high = operation.inputs
        if not low <= len(inputs) <= high:
            raise CubeError(f"{node.name} takes {low} to {high} inputs, not {len(inputs)}")
        named = {x: load(Node("", ()), x) for x in request.variables} if "crs" in operation.options else {}
        crs = next((request.domains[d].get("crs") for d in node.domains if request.domains[d].get("crs")), None)
        options = ({"crs": crs} if crs else {}) | node.options | {"_named": named}
        done[node.rid] = operation.run(inputs, options)
    return {n.rid: done[n.rid] for n in request.operations if not n.id}


def shared(named: dict[str, Cube]) -> list[Cube] | None:
    """The inputs on one DataFrame, under their aliases, if all are variables of the same cells: no join is planned."""
    cubes = list(named.values())
    first = cubes[0]
    if len(cubes) < 2 or not first.origin or any(c.origin != first.origin or len(c.values) > 1 for c in cubes):
        return None
    df = first.df.select(*first.axes, *(F.col(c.values[0]).alias(x) for x, c in named.items()))
    return [Cube(df, c.axes, (x,), c.origin, c.grid) for x, c in named.items()]
