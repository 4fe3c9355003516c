"""Document fingerprints from modular prefix arrays of polynomial hashes.

``PrefixHash`` keeps, for a text, the prefix sums of ``code * base**i`` modulo a Mersenne prime:
the hash of any span is a difference of two of them, so that spans are compared in constant time
and longest common extensions are found by binary search.

A fingerprint is the length, the hash of the whole text under two bases, and sketches: for each length
of ``SPANS`` of which a text holds four, the smallest mixed hashes of all its spans of that length, ``KEPT``
of the longest and ``FEWER`` of the others. The likeness of two fingerprints is taken from the longest
spans that both have sketches of and estimates the share of spans that both texts have: 1 for equal texts,
about one half where half of a text was replaced, 0 where no span is shared. Every text but the empty one
has a sketch of single code points, so that any two texts can be compared.

Defined results: keys are integers; a null text is an empty one; an empty text is like another empty text (1) and
unlike all others (0); texts of over a slab are hashed slab by slab, with the same result; the next document of the last one is the first; rows of equal ids follow
each other by their text; a null id comes before all others; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cubelark.llm.common import parts

PRIME = np.uint64((1 << 31) - 1)
BASES = (911_382_323, 972_663_749)
#: Code points of a slab: longer texts are worked on slab by slab.
SLAB = 1 << 20
SPANS = (24, 6, 2, 1)
KEPT, FEWER = 64, 32


def _mod(x: np.ndarray) -> np.ndarray:
    x = (x & PRIME) + (x >> np.uint64(31))
    x = (x & PRIME) + (x >> np.uint64(31))
    return np.where(x == PRIME, np.uint64(0), x)


class Powers:
    """Powers of a base and of its inverse, grown by doubling as longer texts come."""

    def __init__(self, base: int):
        self.base, self.up, self.down = base, np.ones(1, np.uint64), np.ones(1, np.uint64)

    def _grown(self, have: np.ndarray, base: int, n: int) -> np.ndarray:
        while len(have) < n:
            have = np.concatenate([have, _mod(have * np.uint64(pow(base, len(have), int(PRIME))))])
        return have

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        self.up = self._grown(self.up, self.base, n)
        self.down = self._grown(self.down, pow(self.base, -1, int(PRIME)), n)
        return self.up[:n], self.down[:n]


POWERS = tuple(map(Powers, BASES))


class PrefixHash:
    """The prefix arrays of a text, or of any array of small integers."""

    def __init__(self, text: str | np.ndarray):
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4") if isinstance(text, str) else text
        self.codes = codes.astype(np.uint64) + np.uint64(1)
        self.n = len(codes)
        up, self.down = POWERS[0].to(self.n + 1)
        self.prefix = np.zeros(self.n + 1, np.uint64)
        np.cumsum(_mod(self.codes * up[: self.n]), out=self.prefix[1:])
        self.prefix = _mod(self.prefix)

    def first(self, n: int) -> tuple[int, int]:
        """The hashes of the first code points under both bases."""
        up, _ = POWERS[1].to(n + 1)
        return int(self.prefix[n]), int(_mod(self.codes[:n] * up[:n]).sum(dtype=np.uint64) % PRIME)

    def spans(self, length: int) -> np.ndarray:
        """The hashes of all spans of this length."""
        n = self.n - length + 1
        return _mod(_mod(self.prefix[length:] + PRIME - self.prefix[:n]) * self.down[:n])

    def span(self, start: int, end: int) -> int:
        return (int(self.prefix[end]) - int(self.prefix[start])) * int(self.down[start]) % int(PRIME)

    def same(self, start: int, other: PrefixHash, at: int, length: int) -> bool:
        """Whether two spans are equal, up to a chance of one in two thousand million."""
        return self.span(start, start + length) == other.span(at, at + length)

    def extension(self, start: int, other: PrefixHash, at: int) -> int:
        """Length of the longest common extension of two positions, by binary search."""
        low, high = 0, min(self.n - start, other.n - at)
        while low < high:
            middle = (low + high + 1) // 2
            if self.same(start, other, at, middle):
                low = middle
            else:
                high = middle - 1
        return low


def _least(x: np.ndarray, length: int, kept: int) -> np.ndarray:
    """The smallest different mixed hashes of spans of this length."""
    x = (x + np.uint64((0x9E3779B97F4A7C15 + length) % (1 << 64))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (((x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)) >> np.uint64(32)).astype(np.uint32)
    room = 4 * kept  # repeated spans have equal hashes: take more until enough differ
    while room < len(x):
        least = _sorted(np.partition(x, room)[:room])
        if len(least) >= kept:
            return least[:kept]
        room *= 8
    return _sorted(x)[:kept]


def _sorted(x: np.ndarray) -> np.ndarray:
    """Different values in order."""
    x = np.sort(x)
    new = np.ones(len(x), bool)
    np.not_equal(x[1:], x[:-1], out=new[1:])
    return x[new]


def _part(hashes: PrefixHash, length: int, starts: int) -> np.ndarray:
    """Different spans of this length that begin at one of the first places, as numbers."""
    if length > 2:
        return hashes.spans(length)[:starts]
    codes = hashes.codes
    return _sorted((codes[:-1] << np.uint64(21) | codes[1:])[:starts] if length == 2 else codes[:starts])


def slabs(text: str):
    """The text in slabs that overlap by less than a span: the place of each, its hashes, and how many spans begin in it."""
    for at in range(0, max(1, len(text)), SLAB):
        yield at, PrefixHash(text[at : at + SLAB + SPANS[0] - 1]), min(SLAB, len(text) - at)


def sketches(n: int, hashes: PrefixHash, starts: int) -> list[np.ndarray]:
    """The sketches that a slab gives to a text of n code points, those of the longest spans first."""
    out = []
    for length in SPANS:
        if n >= (4 * length if length > 1 else 1):
            out.append(_least(_part(hashes, length, starts), length, FEWER if out else KEPT))
    return out


def fingerprint(text: str, hashes: PrefixHash | None = None) -> str:
    """Length, whole hash and sketches in hexadecimal, joined by dashes and, between sketches, by dots."""
    n, whole, found = len(text), [0, 0], None
    parts = [(0, hashes, n)] if hashes else slabs(text)
    for at, own, starts in parts:
        for i, h in enumerate(own.first(starts)):
            whole[i] = (whole[i] + h * pow(BASES[i], at, int(PRIME))) % int(PRIME)
        new = sketches(n, own, starts)
        found = new if found is None else [_sorted(np.concatenate(x))[: KEPT if not i else FEWER] for i, x in enumerate(zip(found, new, strict=True))]
    return f"{n:x}-{whole[0] << 31 | whole[1]:016x}-{'.'.join(s.astype('>u4').tobytes().hex() for s in found)}"


def common_prefix(a: str, b: str) -> int:
    """Length of the longest common prefix, slab by slab."""
    for at in range(0, min(len(a), len(b)), SLAB):
        x, y = PrefixHash(a[at : at + SLAB]), PrefixHash(b[at : at + SLAB])
        found = x.extension(0, y, 0)
        if found < SLAB:
            return at + found
    return min(len(a), len(b))


def likeness(a: str, b: str) -> float:
    """How alike two fingerprints are, from 0 to 1."""
    if a == b:
        return 1.0
    x, y = (f.rpartition("-")[2].split(".") for f in (a, b))
    if not x[0] or not y[0]:
        return 0.0
    both = min(len(x), len(y))
    kept = KEPT if len(x) == len(y) else FEWER
    x, y = (np.frombuffer(bytes.fromhex(s[-both]), ">u4") for s in (x, y))
    union = np.union1d(x, y)[:kept]
    shared = (np.isin(union, x, assume_unique=True) & np.isin(union, y, assume_unique=True)).sum() / len(union)
    return float(2 * shared / (1 + shared))


def with_next(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Rows dealt by ranges of the key, sorted, each range closed by a copy of the row that follows it.

    Columns: ``_range``, ``_halo`` (1 for that copy), ``_key``, ``key``, ``text``. Only the first key of
    each range comes to the driver.
    """
    docs = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("_key", F.coalesce("key", F.lit(-(1 << 63))))
    ranges = 4 * parts(docs.sparkSession)
    cuts = sorted({int(x) for x in docs.approxQuantile("_key", [i / ranges for i in range(1, ranges)], 0.25 / ranges)})
    edges = np.array(cuts, np.int64)

    @F.pandas_udf("int")
    def place(keys: pd.Series) -> pd.Series:  # the key alone goes to Python: an expression of thousands of cuts would not compile
        return pd.Series(np.searchsorted(edges, keys.to_numpy(), "right"))

    docs = docs.withColumn("_range", place("_key"))
    firsts = sorted(tuple(r) for r in docs.groupBy("_range").agg(F.min("_key")).collect())
    before = [(k, firsts[i - 1][0]) for i, (_, k) in enumerate(firsts)]
    halo = docs.sparkSession.createDataFrame(before, "_key bigint, _before int")
    halos = docs.drop("_range").join(F.broadcast(halo), "_key").withColumnRenamed("_before", "_range").withColumn("_halo", F.lit(1))
    columns = ["_range", "_halo", "_key", "key", "text"]
    dealt = docs.withColumn("_halo", F.lit(0)).select(columns).unionByName(halos.select(columns))
    return dealt.repartition(parts(docs.sparkSession), "_range").sortWithinPartitions("_range", "_halo", "_key", "text")


def edited(text: str, following: str) -> str:
    """The text whose last half is replaced by as many first code points of the following one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited text, and how alike it is to that and to the next document."""

    def rows(batches):
        """(range, halo, key, text) row by row."""
        for batch in batches:
            yield from zip(*(batch.column(c).to_pylist() for c in ("_range", "_halo", "key", "text")), strict=True)

    def pairs(batches):
        """(key, text, next text) of each row that is no copy."""
        last = done = None
        for at, halo, key, text in rows(batches):
            if last and last[0] == at:
                if done != at:
                    yield last[2], last[3], text
            if halo:
                done = at
            last = (at, halo, key, text)

    def run(batches):
        out: list[tuple] = []
        size, hashes = 0, None
        for key, text, following in pairs(batches):
            changed = edited(text, following)
            if max(len(text), len(following)) > SLAB:
                hashes = None
                a, b, c = map(fingerprint, (text, changed, following))
                common = common_prefix(text, changed)
            else:
                own, a = hashes[1:] if hashes and hashes[0] is text else (own := PrefixHash(text), fingerprint(text, own))
                nxt, other = PrefixHash(following), PrefixHash(changed)
                b, c = fingerprint(changed, other), fingerprint(following, nxt)
                hashes = following, nxt, c
                common = own.extension(0, other, 0)
            out.append((key, len(text), hashlib.sha256(changed.encode()).hexdigest(), a, b, likeness(a, b), likeness(a, c), common))
            size += len(text)
            if size > 1 << 20:
                yield packed(out)
                out, size = [], 0
        if out:
            yield packed(out)

    kind = docs.schema[key].dataType.simpleString()
    names = ["key", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "common_prefix"]
    kinds = [pa.int64() if kind == "bigint" else pa.int32(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64()]

    def packed(out):
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], names)

    schema = f"key {kind}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, common_prefix bigint"
    return with_next(docs, key, text).mapInArrow(run, schema).withColumnRenamed("key", key)
