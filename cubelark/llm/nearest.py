"""Exact top-k inner products by columnar branch and bound.

Vectors are packed in vertical layout (a row for each dimension), candidates by classes of their norm.
A task holds one pack of queries and streams packs of candidates, those of large norm first: partial
products are accumulated ``STEP`` dimensions at a time, and candidates whose partial product plus
the product of the remaining norms is below the query's k-th best score so far are dropped, the
survivors compacted; packs of too small a norm are not looked at.

Scores of vectors below ``LARGE`` are integers below 2**53, which doubles hold exactly. Vectors with
larger components are compared in whole numbers of any size, on a path of their own.

Queries are split into packs of bounded size and candidates into parts, so that a task's memory
and work don't depend on the table; each task returns k rows for a query, merged by a window.

Defined results: vectors that are null, have no id, or hold a null or non-finite component take no part;
vectors are compared with those of their own length; equal scores go to the smaller id; scores beyond a
long are its end, but ranked by their whole value; fewer candidates than k give all; an empty table gives
an empty table; of a repeated id each row is a candidate for the others, and a query of its own with k
results under that id.
"""

from __future__ import annotations

from heapq import nsmallest
from operator import mul

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Vectors of a pack of queries, of a pack of candidates, and packs that one task streams.
QUERY_PACK = 2048
CANDIDATE_PACK = 1024
STREAMED = 16
STEP = 16
#: Classes of norms.
CLASSES = 16
#: Vectors whose norm could be this large are compared in whole numbers.
LARGE = float(1 << 26)
PACKED = "d int, part int, class int, pack int, ids binary, turns binary, data binary, large boolean"


def whole(vector: Column, scale: float) -> Column:
    """The vector with each component times ``scale``, rounded down; null if a component is null, or not finite then."""
    scaled = F.transform(vector.cast("array<double>"), lambda x: x * F.lit(scale))
    bad = F.exists(scaled, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    # from 2**53 on, doubles are whole; floor would give a long
    down = lambda x: F.when(F.abs(x) < LARGE * LARGE * 2, F.floor(x).cast("double")).otherwise(x)
    return F.when(vector.isNotNull() & ~bad, F.transform(scaled, down))


def _large(vectors: np.ndarray) -> np.ndarray:
    return np.abs(vectors).max(axis=1, initial=0) * vectors.shape[1] ** 0.5 >= LARGE


def _packed(rows: DataFrame, most: int) -> DataFrame:
    """Vectors ``d, part, class, key, v`` in vertical layout, in numbered packs of ``most`` at most.

    Turns number rows that are equal in id and vector, which tells a query's own row from its twins.
    """

    def run(batches):
        now, keys, values, packs = None, [], [], 0
        last = None  # group, id, vector and turn of the last row

        def out():
            nonlocal last
            ids, data = np.concatenate(keys), np.concatenate(values)
            same = np.zeros(len(ids), bool)
            same[1:] = (ids[1:] == ids[:-1]) & (data[1:] == data[:-1]).all(axis=1)
            turns = np.arange(len(ids)) - np.maximum.accumulate(np.where(same, 0, np.arange(len(ids))))
            if last and last[0] == now and last[1] == ids[0] and (last[2] == data[0]).all():
                turns[: int(np.searchsorted(~same[1:], True)) + 1] += last[3] + 1
            last = now, ids[-1], data[-1].copy(), int(turns[-1])
            turns = turns.astype(np.int32)
            large = bool(_large(data).any())
            if not large:  # whole numbers, in as few bytes as hold them
                data = data.astype(np.min_scalar_type(-int(np.abs(data).max(initial=0)) - 1))
            cells = [[now[0]], [now[1]], [now[2]], [packs], [ids.tobytes()], [turns.tobytes()], [np.ascontiguousarray(data.T).tobytes()], [large]]
            kinds = [pa.int32()] * 4 + [pa.binary()] * 3 + [pa.bool_()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cells, kinds, strict=True)], ["d", "part", "class", "pack", "ids", "turns", "data", "large"])

        for batch in batches:
            groups = np.stack([batch.column(c).to_numpy() for c in ("d", "part", "class")])
            own, column = batch.column("key").to_numpy(), batch.column("v")
            flat, at = column.flatten().to_numpy(), np.r_[0, np.cumsum(groups[0])]
            edges = np.r_[0, np.flatnonzero((groups[:, 1:] != groups[:, :-1]).any(axis=0)) + 1, len(own)]
            for s, e in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                while s < e:
                    group = tuple(groups[:, s].tolist())
                    held = sum(map(len, keys))
                    if now is not None and (group != now or held >= most):
                        yield out()
                        packs = packs + 1 if group == now else 0
                        keys, values, held = [], [], 0
                    now = group
                    to = min(e, s + most - held)
                    keys.append(own[s:to])
                    values.append(flat[at[s] : at[to]].reshape(to - s, -1))
                    s = to
        if keys:
            yield out()

    by = ["d", "part", "class"]
    return rows.select(*by, "key", "v").repartition(*by).sortWithinPartitions(*by, "key", "v").mapInArrow(run, PACKED)


def _unpacked(ids: bytes, data: bytes, dims: int, large: bool) -> tuple[np.ndarray, np.ndarray]:
    """Ids and the vertical values, as doubles."""
    ids = np.frombuffer(ids, np.int64)
    size = len(data) // max(1, len(ids) * dims) or 1
    return ids, np.frombuffer(data, np.float64 if large else f"i{size}").reshape(dims, len(ids)).astype(np.float64)


FOUND = "d int, qp int, qn int, place bigint, query_id bigint, vec_id bigint, score bigint, beyond binary"


def _found(at: tuple, place, query_id, vec_id, score, beyond=None) -> pa.RecordBatch:
    group = [pa.array(np.full(len(place), x, np.int32)) for x in at[:3]]
    more = pa.array(beyond if beyond is not None else [None] * len(place), pa.binary())
    columns = [pa.array(np.asarray(c, np.int64)) for c in (place, query_id, vec_id, score)]
    return pa.RecordBatch.from_arrays([*group, *columns, more], ["d", "qp", "qn", "place", "query_id", "vec_id", "score", "beyond"])


def _streamed(batches):
    """Of sorted rows, what tells their task's pack of queries, whether they are queries, and the pack."""
    for batch in batches:
        for row in batch.to_pylist():
            ids, data = _unpacked(row["ids"], row["data"], row["d"], row["large"])
            yield (row["d"], row["qp"], row["qn"], row["part"]), not row["kind"], ids, np.frombuffer(row["turns"], np.int32), data, row["large"]


def _own(queries: np.ndarray, q_ids: np.ndarray, q_turns: np.ndarray, c: np.ndarray, c_ids: np.ndarray, c_turns: np.ndarray):
    """Places of queries and of candidates that are the same row."""
    for j in np.flatnonzero(np.isin(c_ids, q_ids)).tolist():
        for i in np.flatnonzero((q_ids == c_ids[j]) & (q_turns == c_turns[j])).tolist():
            if (queries[i] == c[:, j]).all():
                yield i, j


def _whole_search(k: int):
    """The search in whole numbers of any size: all queries against large candidates, large ones against the others."""

    def run(batches):
        now = queries = values = q_ids = q_turns = best = large = None

        def result():
            rows = [(r, int(q_ids[r]), i, -s) for r, own in enumerate(best) for s, i in own]
            clipped = [max(-(1 << 63), min((1 << 63) - 1, s)) for *_, s in rows]
            # beyond a long, order by the whole value: bytes of one length compare as numbers do
            beyond = [(s + (1 << 2240)).to_bytes(288) if s != c or abs(s) == (1 << 63) - 1 else None for (*_, s), c in zip(rows, clipped, strict=True)]
            return _found(now, [r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows], clipped, beyond)

        for at, is_query, ids, turns, data, large_pack in _streamed(batches):
            if is_query:
                if now is not None:
                    yield result()
                now, values, q_ids, q_turns, best, large = at, data.T, ids, turns, [[] for _ in ids], _large(data.T)
                queries = [[int(x) for x in row] for row in data.T]
                continue
            candidates = [[int(x) for x in row] for row in data.T]
            own = set(_own(values, q_ids, q_turns, data, ids, turns))
            for r in range(len(q_ids)):
                if large_pack or large[r]:
                    these = range(len(ids)) if large[r] else np.flatnonzero(_large(data.T)).tolist()
                    scores = ((-sum(map(mul, queries[r], candidates[c])), int(ids[c])) for c in these if (r, c) not in own)
                    best[r] = nsmallest(k, [*best[r], *scores])
        if now is not None:
            yield result()

    return run


def _search(k: int):
    """The function of a task: rows sorted by pack of queries and part, queries (kind 0) first."""

    def pick(scores, ids, state):
        """Merges candidates (score, id) for each query into the k best so far."""
        best_s, best_i = state
        s = np.concatenate([best_s, scores], axis=1)
        i = np.concatenate([best_i, ids], axis=1)
        order = np.lexsort((i, -s), axis=1)[:, :k]
        return np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)

    def bound_and_add(queries, q_ids, q_turns, c, c_ids, c_turns, state):
        """One block of candidates, vertical (dims, n), against the queries (m, dims)."""
        n, dims = c.shape[1], len(c)
        if not n:
            return state
        starts = list(range(0, dims, STEP)) or [0]
        q_rest = np.sqrt(np.cumsum((queries**2)[:, ::-1], axis=1)[:, ::-1])
        c_rest = np.sqrt(np.cumsum((c**2)[::-1], axis=0)[::-1])
        kth = state[0][:, -1]
        alive, rows = np.arange(n), np.flatnonzero(~_large(queries))  # the others have a path of their own
        if dims:
            rows = rows[q_rest[rows, 0] * c_rest[0].max() * (1 + 1e-12) + 1e-6 >= kth[rows]]
        if not len(rows):
            return state
        partial = np.zeros((len(rows), n))
        for s in starts:
            e = min(s + STEP, dims)
            partial += queries[rows, s:e] @ c[s:e, alive]
            if e < dims and np.isfinite(kth).any():
                # rounding up: a bound must never fall below a true score
                room = partial + q_rest[rows, e][:, None] * c_rest[e, alive][None] * (1 + 1e-12) + 1e-6 >= kth[rows][:, None]
                live, want = room.any(axis=0), room.any(axis=1)
                if live.sum() < 0.8 * len(alive) or want.sum() < 0.8 * len(rows):
                    partial, alive, rows = partial[want][:, live], alive[live], rows[want]
                if not len(alive) or not len(rows):
                    return state
        ids = np.broadcast_to(c_ids[alive], partial.shape)
        for i, j in _own(queries[rows], q_ids[rows], q_turns[rows], c[:, alive], c_ids[alive], c_turns[alive]):
            partial[i, j] = -np.inf
        new_s, new_i = [], []
        top = min(k, partial.shape[1])
        if partial.shape[1] > 4 * k:
            # at least the k best by score; ties at the edge are all kept by asking for scores not below it
            edge = np.partition(partial, partial.shape[1] - top, axis=1)[:, -top]
            edge = np.maximum(edge, kth[rows])
            hit_r, hit_c = np.nonzero(partial >= edge[:, None])
            order = np.lexsort((c_ids[alive][hit_c], -partial[hit_r, hit_c], hit_r))
            hit_r, hit_c = hit_r[order], hit_c[order]
            first = np.searchsorted(hit_r, np.arange(len(rows)))
            nth = np.arange(len(hit_r)) - first[hit_r]
            keep = nth < k
            new_s = np.full((len(rows), k), -np.inf)
            new_i = np.full((len(rows), k), np.iinfo(np.int64).max)
            new_s[hit_r[keep], nth[keep]] = partial[hit_r[keep], hit_c[keep]]
            new_i[hit_r[keep], nth[keep]] = c_ids[alive][hit_c[keep]]
        else:
            new_s, new_i = partial, np.where(np.isfinite(partial), ids, np.iinfo(np.int64).max)
        s, i = pick(new_s, new_i, (state[0][rows], state[1][rows]))
        state[0][rows], state[1][rows] = s, i
        return state

    def run(batches):
        now = queries = q_ids = q_turns = state = None

        def result():
            r, c = np.nonzero(np.isfinite(state[0]))
            return _found(now, r, q_ids[r], state[1][r, c], state[0][r, c].astype(np.int64))

        for at, is_query, ids, turns, data, _ in _streamed(batches):
            if is_query:
                if now is not None:
                    yield result()
                now, queries, q_ids, q_turns = at, np.ascontiguousarray(data.T), ids, turns
                state = np.full((len(ids), k), -np.inf), np.full((len(ids), k), np.iinfo(np.int64).max)
            else:
                small = ~_large(data.T)
                state = bound_and_add(queries, q_ids, q_turns, data if small.all() else data[:, small], ids[small], turns[small], state)
        if now is not None:
            yield result()

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, scale: float = 64.0, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """For each query its k best other rows: ``query_id, rank, vec_id, score``."""
    rows = vectors.select(F.col(key).cast("bigint").alias("key"), whole(F.col(vector), scale).alias("v"), is_query.alias("q")).where("v is not null and key is not null")
    most = F.coalesce(F.array_max(F.transform("v", F.abs)), F.lit(0.0)) * F.sqrt(F.size("v").cast("double"))
    rows = rows.withColumn("d", F.size("v")).withColumn("large", most >= LARGE)
    n, m, large = rows.agg(F.count("*"), F.count(F.when(F.col("q"), 1)), F.count(F.when(F.col("large"), 1))).first()
    if not m:
        return vectors.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda total, x: total + x * x))
    cuts = rows.select(norm.alias("norm")).approxQuantile("norm", [i / CLASSES for i in range(1, CLASSES)], 0.02)
    of_norm = F.size(F.filter(F.array(*map(F.lit, sorted(set(cuts)))), lambda x: x > norm)) if cuts else F.lit(0)  # 0: the largest
    dealt = lambda parts: F.pmod(F.xxhash64("key"), F.lit(parts)).cast("int").alias("part")
    parts = -(-n // (CANDIDATE_PACK * STREAMED))
    queries = _packed(rows.where("q").select("d", dealt(-(-m // (QUERY_PACK * 3 // 4))), F.lit(0).alias("class"), "key", "v"), QUERY_PACK)
    queries = queries.select("d", F.col("part").alias("qp"), F.col("pack").alias("qn"), "ids", "turns", "data", "large")
    candidates = _packed(rows.select("d", dealt(parts), of_norm.alias("class"), "key", "v"), CANDIDATE_PACK)

    def met(these: DataFrame, candidates: DataFrame) -> DataFrame:
        """Each pack of queries with each part of the candidates of its length: its own row first, then theirs by norm."""
        to = these.select("d", "qp", "qn", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.lit(0).alias("kind"), F.lit(0).alias("class"), F.lit(0).alias("pack"), "ids", "turns", "data", "large")
        theirs = candidates.join(to.select("d", "qp", "qn", "part"), ["d", "part"]).select("d", "qp", "qn", "part", F.lit(1).alias("kind"), "class", "pack", "ids", "turns", "data", "large")
        return to.unionByName(theirs).repartition("d", "qp", "qn", "part").sortWithinPartitions("d", "qp", "qn", "part", "kind", "class", "pack")

    found = met(queries, candidates).mapInArrow(_search(k), FOUND)
    if large:
        whole_numbers = met(queries, candidates.where("large")).mapInArrow(_whole_search(k), FOUND)
        of_large = met(queries.where("large"), candidates.where("not large")).mapInArrow(_whole_search(k), FOUND)
        found = found.unionByName(whole_numbers).unionByName(of_large)
    # by query row: an id can be that of several
    order = Window.partitionBy("d", "qp", "qn", "place").orderBy(F.desc("score"), F.desc("beyond"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
