"""The engine: runs requests and utility commands, and gives results in the form that is asked for."""

from __future__ import annotations

import time
import uuid
from collections import OrderedDict
from concurrent.futures import Future, ThreadPoolExecutor
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import DataFrame, SparkSession

from cubelark.cube import Cube, CubeError
from cubelark.operators import udf
from cubelark.plans.planner import plan
from cubelark.plans.request import Request, build, parse
from cubelark.sources.catalog import Catalog

#: Results that are kept.
RESULTS = 128
#: The most rows that an inline response may have.
INLINE_ROWS = 1_000_000


def _plain(value: object) -> str:
    return ",".join(map(str, value)) if isinstance(value, list | tuple) else str(value)


class Engine:
    """A catalog, the operations, and the latest results."""

    def __init__(self, spark: SparkSession, catalog: Catalog | None = None, workers: int = 4):
        self.spark = spark
        self.catalog = catalog or Catalog(spark)
        self.results: OrderedDict[str, Cube] = OrderedDict()
        self.jobs: dict[str, Future] = {}
        self.times: list[dict] = []
        self._pool = ThreadPoolExecutor(workers)

    def plan(self, request: str | dict | Request) -> dict[str, Cube]:
        """Lazy cubes for the products of a request."""
        if not isinstance(request, Request):
            request = parse(request) if isinstance(request, str) else build(request)
        return plan(request, self.catalog)

    def execute(self, request: str | dict | Request, response: str = "frame", path: str | None = None, run_async: bool = False):
        """Runs a request. Responses: ``frame`` (DataFrames), ``dict``, ``xml``, ``object`` (Arrow), ``file`` (Parquet at ``path``), ``netcdf`` (small results).

        Asynchronous runs return the job's id at once.
        """
        if run_async:
            job = uuid.uuid4().hex[:12]
            self.jobs[job] = self._pool.submit(self.execute, request, "file" if response == "frame" and path else response, path)
            return job
        began = time.perf_counter()
        found = self.plan(request)
        planned = time.perf_counter()
        for rid, cube in found.items():
            self.results[rid] = cube
            self.results.move_to_end(rid)
            while len(self.results) > RESULTS:
                self.results.popitem(last=False)
        out = {rid: self._formed(rid, cube, response, path) for rid, cube in found.items()}
        self.times.append({"products": list(found), "response": response, "plan_s": planned - began, "run_s": time.perf_counter() - planned})
        del self.times[:-RESULTS]
        return out

    def profile(self) -> list[dict]:
        """Seconds of planning and running of the latest requests (frames run later), slowest first."""
        return sorted(self.times, key=lambda t: -(t["plan_s"] + t["run_s"]))

    def _formed(self, rid: str, cube: Cube, response: str, path: str | None):
        if response == "frame":
            return cube.df
        if response == "file":
            if not path:
                raise CubeError("a file response needs a path")
            target = f"{path.rstrip('/')}/{rid}.parquet"
            cube.df.write.mode("overwrite").parquet(target)
            return target
        if response == "netcdf":
            from cubelark.sources.netcdf import write

            if not path:
                raise CubeError("a NetCDF response needs a path")
            return write(cube.df, cube, f"{path.rstrip('/')}/{rid}.nc")
        if response == "object":
            found = cube.ordered().limit(INLINE_ROWS + 1).toArrow()
            if found.num_rows > INLINE_ROWS:
                raise CubeError(f"over {INLINE_ROWS} rows: ask for a file")
            return found
        rows = cube.ordered().limit(INLINE_ROWS + 1).collect()
        if len(rows) > INLINE_ROWS:
            raise CubeError(f"over {INLINE_ROWS} rows: ask for a file")
        if response == "dict":
            return {"axes": list(cube.axes), "values": list(cube.values), "rows": [r.asDict() for r in rows]}
        if response == "xml":
            data = "".join(f"<data id={quoteattr(v)} shape={quoteattr(str(len(rows)))}>{escape(','.join('' if r[v] is None else repr(r[v]) for r in rows))}</data>" for v in cube.values)
            return f"<result rid={quoteattr(rid)} href={quoteattr(self.reference(rid))}>{data}</result>"
        raise CubeError(f"unknown response {response}")

    @staticmethod
    def reference(rid: str) -> str:
        return f"result://{rid}"

    def result(self, rid: str) -> DataFrame:
        """A kept result by its id or reference."""
        rid = rid.removeprefix("result://")
        if rid not in self.results:
            raise CubeError(f"no result {rid}")
        return self.results[rid].df

    def status(self, job: str) -> str:
        if job not in self.jobs:
            raise CubeError(f"no job {job}")
        future = self.jobs[job]
        return "executing" if not future.done() else "failed" if future.exception() else "completed"

    def wait(self, job: str, timeout: float | None = None):
        return self.jobs[job].result(timeout)

    def utility(self, command: str, request: str | dict | None = None, **more):
        """``agg, magg, cache, dfrag, dres, dcol, clearCache``, also with ``util.`` before them."""
        name = command.lower().removeprefix("util.")
        if name == "agg":
            return self.catalog.register(**more)
        if name == "magg":
            return self.catalog.register_many(**more)
        if name == "cache":
            read = parse(request) if isinstance(request, str) else build(request)
            return [self.catalog.cache(v.uri, [v.name], read.domains.get(v.domain)) for v in read.variables.values()]
        if name == "dfrag":
            return self.catalog.drop(more["key"])
        if name == "clearcache":
            return self.catalog.drop()
        if name == "dres":
            return self.results.pop(more["rid"].removeprefix("result://"), None) and None
        if name == "dcol":
            return self.catalog.remove(more["name"])
        raise CubeError(f"unknown command {command}")

    def capabilities(self, kind: str = "") -> list[dict]:
        """Lists of kernels (also ``op``), collections, variables, fragments, results or jobs."""
        kind = kind.lower() or "kernels"
        if kind.startswith(("kern", "op", "getcap")):
            return udf.capabilities()
        if kind.startswith("coll"):
            return [{"name": c.name, "kind": c.kind, "uri": c.uri, "title": c.title} for c in self.catalog.collections.values()]
        if kind.startswith("var"):
            return [{"collection": c.name, "name": v, "axes": "".join(c.axes)} for c in self.catalog.collections.values() for v in c.variables]
        if kind.startswith("frag"):
            return [{"key": k} for k in self.catalog.fragments]
        if kind.startswith("res"):
            return [{"rid": r, "href": self.reference(r)} for r in self.results]
        if kind.startswith("job"):
            return [{"job": j, "status": self.status(j)} for j in self.jobs]
        raise CubeError(f"no list of {kind}")

    def status_document(self, job: str) -> str:
        """What became of an asynchronous run: its status with references to its results, files' paths, or the error."""
        state = self.status(job)
        rows = ""
        if state == "failed":
            rows = f"<error>{escape(str(self.jobs[job].exception()))}</error>"
        elif state == "completed":
            found = self.jobs[job].result()
            rows = "".join(f"<output id={quoteattr(r)} href={quoteattr(x if isinstance(x, str) and not x.startswith('<') else self.reference(r))}/>" for r, x in found.items())
        return f"<status job={quoteattr(job)} state={quoteattr(state)}>{rows}</status>"

    def capabilities_document(self, kind: str = "") -> str:
        """The list of that kind as XML."""
        items = "".join(f"<item {' '.join(f'{k}={quoteattr(_plain(v))}' for k, v in row.items())}/>" for row in self.capabilities(kind))
        return f"<capabilities kind={quoteattr(kind or 'kernels')}>{items}</capabilities>"

    def describe_document(self, name: str) -> str:
        """What an operation takes and does, as XML."""
        found = self.describe(name)
        options = "".join(f"<option>{escape(o)}</option>" for o in found["options"])
        low, high = found["inputs"]
        return f"<process name={quoteattr(found['name'])}><abstract>{escape(found['description'])}</abstract><inputs least=\"{low}\" most=\"{high}\"/>{options}</process>"

    def describe(self, name: str) -> dict:
        """What an operation takes and does."""
        found = udf.lookup(name)
        return {"name": found.name, "description": found.description, "options": list(found.options), "inputs": list(found.inputs)}
