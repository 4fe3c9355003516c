"""Dedup of repeated byte strings by suffix arrays.

``suffix_array`` is the difference-cover algorithm in array operations: triples at places that 3
doesn't divide are sorted and named, the names are sorted by recursion where they aren't distinct,
the other suffixes follow from their first symbol and the next one's rank, and both orders are
merged by two searches, as the cover gives each pair of suffixes an offset at which ranks are known.

Every byte covered by a string of ``LENGTH`` bytes that also starts earlier is removed. Runs of
windows that have no copy, and all but the first copy of a run, are told apart before (see
``repeats``); the suffixes of what is left are sorted and neighbours in that order compared.

Defined results: a null text is an empty one; shorter texts lose nothing; of equal texts the one of
smallest id stays; rows of equal ids count as one document, their texts one after the other and equal
ones once; an empty table gives an empty table; other columns are left alone. Keys are integers. When texts are cut, no character is split: one that repeats only in
part stays.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cubelark.llm import repeats
from cubelark.llm.common import slices, utf8

LENGTH = 100
UNIT = repeats.Unit(words=False, length=LENGTH, gram=8, within=True)


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Starts of the suffixes of positive symbols, in lexicographic order."""
    n = len(text)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: text[i:].tolist()), np.int64)
    t = np.concatenate([text, [0, 0, 0]]).astype(np.int64)
    # an end of length 1 mod 3 gets one more place, so that names of both kinds are kept apart by it
    ones = np.arange(1, n + (n % 3 == 1), 3)
    twos = np.arange(2, n, 3)
    cover = np.concatenate([ones, twos])
    size = int(t.max()) + 1
    code = (t[cover] * size + t[cover + 1]) * size + t[cover + 2]
    kinds, names = np.unique(code, return_inverse=True)
    if len(kinds) < len(cover):
        order = suffix_array(names + 1)
    else:
        order = np.argsort(names)
    rank = np.zeros(n + 3, np.int64)
    rank[cover[order]] = np.arange(1, len(cover) + 1)
    sampled = cover[order]
    sampled = sampled[sampled < n]
    base = int(rank.max()) + 1
    zeros = np.arange(0, n, 3)
    zeros = zeros[np.argsort(t[zeros] * base + rank[zeros + 1])]
    # how many of the others come before each sampled suffix
    before = np.zeros(len(sampled), np.int64)
    one = sampled % 3 == 1
    i = sampled[one]
    before[one] = np.searchsorted(t[zeros] * base + rank[zeros + 1], t[i] * base + rank[i + 1])
    i = sampled[~one]
    before[~one] = np.searchsorted((t[zeros] * size + t[zeros + 1]) * base + rank[zeros + 2], (t[i] * size + t[i + 1]) * base + rank[i + 2])
    out = np.empty(n, np.int64)
    at = before + np.arange(len(sampled))
    out[at] = sampled
    rest = np.ones(n, bool)
    rest[at] = False
    out[rest] = zeros
    return out


def earlier(contexts: list[bytes], docs: np.ndarray, starts: np.ndarray, length: int = LENGTH) -> list[np.ndarray]:
    """For each context, sorted by document and start, which of its windows also start earlier in the list."""
    sizes = np.array([len(c) for c in contexts])
    data = np.frombuffer(b"\0".join(contexts), np.uint8)
    at = np.r_[0, np.cumsum(sizes + 1)]
    text = data.astype(np.int64) + 2
    text[at[1:-1] - 1] = 1  # between contexts
    order = suffix_array(text)
    owner = np.repeat(np.arange(len(sizes)), sizes + 1)[: len(data)]
    windows = np.arange(len(data)) + length <= (at[owner] + sizes[owner])
    order = order[windows[order]]
    # neighbours whose first bytes are equal have the same window
    seen = np.lib.stride_tricks.sliding_window_view(data, length) if len(data) >= length else np.zeros((0, length), np.uint8)
    same = np.zeros(len(order), bool)
    for i in range(1, len(order), 1 << 15):
        j = min(i + (1 << 15), len(order))
        same[i:j] = (seen[order[i:j]] == seen[order[i - 1 : j - 1]]).all(axis=1)
    group = np.flatnonzero(~same)
    first = np.minimum.reduceat(order, group) if len(order) else order
    least = np.repeat(first, np.diff(np.r_[group, len(order)]))
    found = np.zeros(len(data), bool)
    # equal places of a repeated document are no earlier starts
    key = lambda p: (docs[owner[p]], starts[owner[p]] + p - at[owner[p]])
    (d, s), (d0, s0) = key(order), key(least)
    found[order] = (d != d0) | (s != s0)
    return [found[a : a + max(0, n - length + 1)] for a, n in zip(at[:-1].tolist(), sizes.tolist(), strict=True)]


def repeated_spans(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc, variant, lo, hi``: bytes of each document covered by strings that also start earlier."""
    return repeats.repeats(*repeats.identified(docs, key, text), UNIT, earlier)


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Sizes, removed bytes and spans, and the digest of what is kept of each document."""

    def run(batches):
        for batch in slices(batches, 1 << 20):
            data, at = utf8(batch.column("text"))
            out = []
            for i, (lo, hi) in enumerate(repeats.spans_of(batch)):
                own = data[at[i] : at[i + 1]]
                lo, hi = np.minimum(lo, len(own)), np.minimum(hi, len(own))
                kept = hashlib.sha256()
                for a, b in zip(np.r_[0, hi], np.r_[lo, len(own)], strict=True):
                    kept.update(own[a:b])
                out.append((len(own), int((hi - lo).sum()), len(lo), kept.hexdigest()))
            n, removed, spans, sha = zip(*out, strict=True) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(sha, pa.string())], ["doc", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    keyed, repeated = repeats.identified(docs, key, text)
    spans = repeats.repeats(keyed, repeated, UNIT, earlier)
    found = repeats.with_spans(keyed, spans).select("doc", "text", "spans").mapInArrow(run, "doc bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")
    return found.select(F.when(F.col("doc") != -(1 << 63), F.col("doc")).alias(key), "n_bytes", "n_removed", "n_spans", "kept_sha256")


def whole_characters(data: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans of UTF-8 bytes cut back to whole characters."""
    inside = lambda i: i < len(data) and data[i] & 0xC0 == 0x80
    low, high = lo.tolist(), hi.tolist()
    for k in range(len(low)):
        while low[k] < high[k] and inside(low[k]):
            low[k] += 1
        while high[k] > low[k] and inside(high[k]):
            high[k] -= 1
    return np.array(low, np.int64), np.array(high, np.int64)


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """The documents without their repeated strings; those of which nothing is left go.

    A null text becomes an empty one and stays; ``n_chars``, null or not, becomes the new length.
    """

    def run(batches):
        for batch in slices(batches, 1 << 20):
            data, at = utf8(batch.column("text"))
            kept: list[str | None] = []
            for i, (lo, hi) in enumerate(repeats.spans_of(batch)):
                own = data[at[i] : at[i + 1]]
                lo, hi = whole_characters(own, np.minimum(lo, len(own)), np.minimum(hi, len(own)))
                new = b"".join(own[a:b].tobytes() for a, b in zip(np.r_[0, hi], np.r_[lo, len(own)], strict=True)).decode()
                kept.append(new if new or not len(own) else None)
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(kept, pa.string())], ["row", "text"])

    rest = [c for c in docs.columns if c != text]
    keyed, repeated = repeats.identified(docs, key, text, F.struct(*rest).alias("row"))
    spans = repeats.repeats(keyed, repeated, UNIT, earlier)
    found = repeats.with_spans(keyed, spans).select("text", "spans", "row")
    cut = found.mapInArrow(run, f"row {keyed.schema['row'].dataType.simpleString()}, text string").where("text is not null")
    length = F.length("text").cast("bigint")
    return cut.select(*(F.col("text").alias(c) if c == text else length.alias(c) if c == n_chars else F.col("row")[c].alias(c) for c in docs.columns))
