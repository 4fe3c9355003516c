"""Windows of fixed length that also start earlier: what both exact dedups of passages stand on.

A text is a row of symbols (bytes, or words). Of each window of ``length`` symbols, the gram of
least hash is its anchor; neighbouring windows share anchors, so that the windows of a text fall
into runs, one for each anchor, of some dozens of windows. As an anchor depends on nothing but its
window, equal windows have equal anchors at equal places: they can be found run by run.

1. ``runs``: every run becomes a record with a key (hash of the symbols that all its windows share on
   one side of the anchor, so that equal windows have equal keys) and a name (hash of all its symbols).
   Copies of a run inside a task are found there, before the shuffle.
2. ``named``: records are dealt by key and sorted by name and place, and streamed. Keys that occur once
   drop out, later copies of a run are repeats, and first copies of runs whose key has several names
   go on, in shares of ``SHARE`` runs where a key has more.
3. A solver (suffix array or suffix automaton) gets the symbols of these runs, a bounded number of
   shares at a time, and says which windows also start earlier in the share.
4. ``across``: windows of split keys that are first in their share are compared between shares by
   their hash, with partial aggregation.

No step gathers a key in one place: keys of many names are dealt by name before the shuffle, rows
stream, shares and chunks are bounded, the rest is partial aggregation. Texts of over two slabs are
worked on slab by slab. Rows of equal ids count as one document: texts one after the other, equal ones once.

Hashes are polynomials modulo 2**61 - 1 at a random base, which no pair of texts is known to defeat.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cubelark.llm.common import ints, parts, slices, utf8, written

#: Bytes of text hashed at once; records that are combined before the shuffle.
SLICE = 1 << 18
COMBINED = 400_000
#: Bytes of a slab of a long text.
SLAB = 1 << 20
#: Runs of a key that are solved together, and symbols that a solver gets at once.
SHARE = 512
CHUNK = 1 << 19
#: Names of a key in a chunk of records from which on the key is dealt by name.
HOT = 256
#: Bytes, of about eight a word, of a task that solves, and the most such tasks.
PARTITION = 1 << 22
MOST_PARTITIONS = 100_000

U = np.uint64
#: Hashes are polynomials modulo this prime, at a fixed random base.
PRIME = (1 << 61) - 1
BASE = 0x0B7E151628AED2A6
INVERSE = pow(BASE, -1, PRIME)
TABLE = np.random.default_rng(2024).integers(1, PRIME, 256, np.uint64)
LOW30, LOW31, LOW61 = U((1 << 30) - 1), U((1 << 31) - 1), U(PRIME)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(33))) * U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> U(29))) * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(32))


def reduced(x: np.ndarray) -> np.ndarray:
    """Any 64-bit numbers modulo the prime."""
    x = (x & LOW61) + (x >> U(61))
    return np.where(x >= LOW61, x - LOW61, x)


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products modulo the prime of numbers below it, from halves of 30 and 31 bits."""
    a1, a0, b1, b0 = a >> U(31), a & LOW31, b >> U(31), b & LOW31
    middle = a0 * b1 + a1 * b0
    return reduced(((a1 * b1) << U(1)) + (middle >> U(30)) + ((middle & LOW30) << U(31)) + a0 * b0)


class Powers:
    """Powers of the base and of its inverse modulo the prime, as far as they were needed."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, U)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            at = len(self.up)
            self.up = np.concatenate([self.up, times(self.up, U(pow(BASE, at, PRIME)))])
            self.down = np.concatenate([self.down, times(self.down, U(pow(INVERSE, at, PRIME)))])
        return self.up[:n], self.down[:n]


POWERS = Powers()


class Spans:
    """Hashes of spans of a row of symbols below the prime, from prefix sums."""

    def __init__(self, symbols: np.ndarray):
        up, self.down = POWERS.to(len(symbols) + 1)
        terms = times(symbols, up[:-1])
        high, low = np.cumsum(terms >> U(31)), np.cumsum(terms & LOW31)
        self.prefix = np.zeros(len(symbols) + 1, U)
        self.prefix[1:] = reduced((high >> U(30)) + ((high & LOW30) << U(31)) + low)

    def _between(self, low: np.ndarray, high: np.ndarray, down: np.ndarray) -> np.ndarray:
        return times(np.where(high >= low, high - low, high + LOW61 - low), down)

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix(self._between(self.prefix[start], self.prefix[end], self.down[start]) + (end - start).astype(U) * U(0x9E3779B97F4A7C15))

    def all(self, length: int) -> np.ndarray:
        n = len(self.prefix) - length
        return mix(self._between(self.prefix[:n], self.prefix[length:], self.down[:n]))


def chained(symbols: np.ndarray, length: int) -> np.ndarray:
    """Hashes of all spans of a small length, symbol by symbol, without sums that symbols could cancel in."""
    n = len(symbols) - length + 1
    if n <= 0:
        return np.zeros(0, U)
    out = np.full(n, length, U)
    for i in range(length):
        out = mix((out ^ symbols[i : i + n]) + U(0x9E3779B97F4A7C15))
    return out


def least_in_windows(x: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each window, by doubling."""
    n, step, out = len(x) - width + 1, 1, x
    while step * 2 <= width:
        out = np.minimum(out[:-step], out[step:])
        step *= 2
    return np.minimum(out[:n], out[width - step : width - step + n])


SPACES = np.zeros(256, bool)
SPACES[[32, *range(9, 14)]] = True


def words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word of texts that lie one after the other, and the words before each text."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = ~SPACES[data]
    ends = np.zeros(len(data) + 1, bool)
    ends[at] = True  # words end where texts do
    cut = inside[1:] & (~inside[:-1] | ends)
    starts = np.flatnonzero(cut[: len(data)])
    stop = np.flatnonzero(inside[1:-1] & (~inside[2:] | ends[1:])) + 1
    return starts, stop, np.searchsorted(starts, at)


def word_symbols(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A number for each word, from slabs of bounded size."""
    out, low = np.zeros(len(starts), U), 0
    while low < len(starts):
        high = int(np.searchsorted(ends, starts[low] + SLAB, "right"))
        first = starts[low]
        if high > low:
            out[low:high] = Spans(TABLE[data[first : ends[high - 1]]])(starts[low:high] - first, ends[low:high] - first)
        else:  # a word of more than a slab, part by part
            high = low + 1
            for a in range(int(first), int(ends[low]), SLAB):
                part = TABLE[data[a : min(a + SLAB, int(ends[low]))]]
                out[low:high] = mix(out[low:high] ^ Spans(part)(np.array([0]), np.array([len(part)])))
        low = high
    return reduced(out)


@dataclass(frozen=True)
class Unit:
    """What symbols are, and the lengths of windows and grams in them."""

    words: bool
    length: int
    gram: int
    #: Whether an earlier start in the same document counts too.
    within: bool

    @property
    def left(self) -> int:
        """Symbols before the anchor from which on a window is told by its left side."""
        return (self.length - self.gram + 1) // 2

    def symbols(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of texts that lie one after the other, and the symbols before each text."""
        if not self.words:
            return TABLE[data], at
        starts, ends, before = words(data, at)
        return word_symbols(data, starts, ends), before

    def slabs(self, data: np.ndarray, at: np.ndarray):
        """Symbols and offsets of texts; a single long text in slabs that overlap by less than a window, each with its place."""
        if len(at) > 2 or len(data) <= 2 * SLAB:
            yield 0, *self.symbols(data, at)
            return
        starts, ends, before = words(data, at) if self.words else (None, None, at)
        total = int(before[-1])
        step = SLAB // 4 if self.words else SLAB
        for low in range(0, max(1, total - self.length + 1), step):
            high = min(total, low + step + self.length - 1)
            if self.words:
                yield low, word_symbols(data, starts[low:high], ends[low:high]), np.array([0, high - low])
            else:
                yield low, TABLE[data[low:high]], np.array([0, high - low])


def runs_of(symbols: np.ndarray, at: np.ndarray, unit: Unit) -> tuple[np.ndarray, ...]:
    """Text number, start, number of windows, key and name of each run of windows."""
    length, gram = unit.length, unit.gram
    none = np.zeros(0, np.int64)
    if len(symbols) < length:
        return none, none, none, none.astype(U), none.astype(U)
    spans = Spans(symbols)
    order, step = symbols, 1  # any function of a gram alone will do for its order
    while step < gram:
        order = order[:-step] * U(0x9E3779B97F4A7C15) + order[step:]
        step *= 2
    order = mix(order)
    bits = U((1 << max(1, int(len(order)).bit_length())) - 1)
    # the leftmost of the least: place breaks ties, as it does in every equal window
    anchor = (least_in_windows((order & ~bits) | np.arange(len(order), dtype=U), length - gram + 1) & bits).astype(np.int64)
    windows = np.arange(len(anchor))
    text = np.searchsorted(at, windows, "right") - 1
    whole = windows + length <= at[text + 1]
    side = anchor - windows >= unit.left
    new = np.ones(len(anchor), bool)
    new[1:] = (np.diff(anchor) != 0) | (side[1:] != side[:-1]) | (text[1:] != text[:-1]) | (whole[1:] != whole[:-1])
    start = np.flatnonzero(new)
    count = np.diff(np.r_[start, len(anchor)])
    kept = whole[start]
    start, count = start[kept], count[kept]
    anchor, side = anchor[start], side[start]
    key = spans(np.where(side, anchor - unit.left, anchor), np.where(side, anchor + gram, anchor + length - unit.left + 1))
    name = spans(start, start + count - 1 + length)
    return text[start], start - at[text[start]], count, mix(key + side), name


RECORD = "key bigint, name bigint, doc bigint, variant bigint, place bigint"
#: A place is ``start * 512 + windows``, ``SPLIT`` more where the key's names are dealt, negative for a copy
#: that is known to be later; 0 says that other records of its key are dealt.
SHIFT = 9
SPLIT = 256
LEAST = -(1 << 63)


def runs(docs: DataFrame, unit: Unit) -> DataFrame:
    """Records of all runs of ``doc, variant, text``; later copies within a task are marked and dealt by document.

    A key that has over ``HOT`` names among the records of a chunk is dealt by name, too, and a record under
    the key itself says so.
    """
    salts = 4 * parts(docs.sparkSession)

    def combined(held: list[tuple]) -> pa.RecordBatch:
        key, name, doc, variant, place = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((place, variant, doc, name, key))
        key, name, doc, variant, place = key[order], name[order], doc[order], variant[order], place[order]
        new_key = np.ones(len(key), bool)
        new_key[1:] = key[1:] != key[:-1]
        same = ~new_key
        same[1:] &= name[1:] == name[:-1]
        first = np.maximum.accumulate(np.where(same, 0, np.arange(len(key))))
        later = same & ((doc != doc[first]) | (((variant != variant[first]) | (place != place[first])) & unit.within))
        start = np.flatnonzero(new_key)
        names = np.add.reduceat(~same, start)
        hot = np.repeat(names > HOT, np.diff(np.r_[start, len(key)])) & ~later
        told = key[start[names > HOT]]
        # a later copy needs nothing but its way to its document
        spread = mix(doc.astype(U) + U(77)).view(np.int64)
        dealt = mix(key.view(U) ^ mix(mix(name.view(U)) % U(salts) + U(1))).view(np.int64)
        place = np.where(later, -place - 1, np.where(hot, place + SPLIT, place))
        key = np.where(later, spread, np.where(hot, dealt, key))
        zeros = np.zeros(len(told), np.int64)
        columns = (np.r_[key, told], np.r_[np.where(later, 0, name), zeros + LEAST], np.r_[doc, zeros + LEAST], np.r_[variant, zeros], np.r_[place, zeros])
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["key", "name", "doc", "variant", "place"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in slices(batches, SLICE):
            data, at = utf8(batch.column("text"))
            docs, variants = ints(batch.column("doc")), ints(batch.column("variant"))
            for low, symbols, before in unit.slabs(data, at):
                text, start, count, key, name = runs_of(symbols, before, unit)
                held.append((key.view(np.int64), name.view(np.int64), docs[text], variants[text], ((low + start) << SHIFT) + count))
                n += len(key)
                if n >= COMBINED:
                    yield combined(held)
                    held, n = [], 0
        if n:
            yield combined(held)

    return docs.mapInArrow(run, RECORD)


NAMED = "doc bigint, variant bigint, place bigint, key bigint, share int, split boolean"


def named(records: DataFrame, unit: Unit) -> DataFrame:
    """Later copies (null key) and runs that a solver must look at, from records dealt by key.

    A later copy's place says which windows repeat.
    """

    def solved(key, name, doc, variant, place, state) -> tuple:
        """Rows of keys that are all here (``state`` None) or of one key that goes on."""
        told = place == 0
        dealt = np.isin(key, key[told]) | ((place > 0) & (place & SPLIT > 0))
        if state is not None:
            state["dealt"] |= bool(told.any())
            dealt |= state["dealt"]
        key, name, doc, variant, place, dealt = (x[~told] for x in (key, name, doc, variant, place, dealt))
        place = np.where(place > 0, place & ~SPLIT, place)
        n = len(key)
        if not n:
            return doc, variant, place, key, key, dealt, dealt
        first_key = np.ones(n, bool)
        first_key[1:] = key[1:] != key[:-1]
        new = first_key.copy()
        new[1:] |= name[1:] != name[:-1]
        at = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        doc0, variant0, place0 = doc[at], variant[at], place[at]
        names = np.cumsum(new)
        group = np.maximum.accumulate(np.where(first_key, np.arange(n), 0))
        number = names - names[group]  # of the name within its key
        if state is not None and state["name"] is not None:
            more = name == state["name"]  # sorted: a prefix of the rows
            doc0[more], variant0[more], place0[more] = state["doc"], state["variant"], state["place"]
            number = number + state["number"] + (0 if more.any() else 1)
        known = place < 0  # marked by a task before
        later = known | (doc != doc0) | (((variant != variant0) | (place != place0)) & unit.within)
        if state is None:
            ends = np.r_[np.flatnonzero(first_key)[1:], n] - 1
            per_key = np.repeat(number[ends] + 1, np.diff(np.r_[np.flatnonzero(first_key), n]))
        else:
            per_key = np.full(n, 2 * SHARE)
            state |= {"name": name[-1], "doc": doc0[-1], "variant": variant0[-1], "place": place0[-1], "number": int(number[-1])}
        place = np.where(known, -place - 1, place)
        # equal rows (a repeated document) are wanted once
        again = np.zeros(n, bool)
        again[1:] = ~new[1:] & (doc[1:] == doc[:-1]) & (variant[1:] == variant[:-1]) & (place[1:] == place[:-1])
        keep = (later | (per_key > 1) | dealt) & ~again
        return doc[keep], variant[keep], place[keep], key[keep], number[keep] // SHARE, ((per_key > SHARE) | dealt)[keep], later[keep]

    def batch_of(doc, variant, place, key, share, split, later) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(variant), pa.array(place), pa.array(key, mask=later), pa.array(share.astype(np.int32)), pa.array(split)], ["doc", "variant", "place", "key", "share", "split"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        empty = [np.zeros(0, np.int64)] * 5
        held, state = empty, None
        for batch in batches:
            rows = [np.concatenate([h, ints(batch.column(c))]) for h, c in zip(held, ("key", "name", "doc", "variant", "place"), strict=True)]
            if state is not None:  # a key of more rows than are held at once goes on
                on = int(np.searchsorted(rows[0] != state["key"], True))
                if on:
                    yield batch_of(*solved(*(r[:on] for r in rows), state))
                rows = [r[on:] for r in rows]
                if len(rows[0]):
                    state = None
            if not len(rows[0]):
                held = empty
                continue
            last = int(np.searchsorted(rows[0] == rows[0][-1], True))
            if last:
                yield batch_of(*solved(*(r[:last] for r in rows), None))
                rows = [r[last:] for r in rows]
            if len(rows[0]) > 16 * SHARE:
                state = {"key": rows[0][0], "name": None, "number": 0, "dealt": False}
                yield batch_of(*solved(*rows, state))
                rows = empty
            held = rows
        if len(held[0]):
            yield batch_of(*solved(*held, None))

    dealt = records.repartition("key").sortWithinPartitions("key", "name", "doc", "variant", "place")
    return dealt.mapInArrow(run, NAMED)


#: From a chunk: number of each context, and which of its windows also start earlier. Gets the symbols
#: of contexts (bytes of text), their documents and starts, sorted by these.
Solver = Callable[[list[bytes], np.ndarray, np.ndarray], list[np.ndarray]]
SOLVED = "doc bigint, variant bigint, lo bigint, hi bigint, h1 bigint, h2 bigint"


def contexts(docs: DataFrame, wanted: DataFrame, unit: Unit) -> DataFrame:
    """The text of each wanted run, cut from its document: ``key, share, split, doc, variant, start, context``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, SLICE):
            data, at = utf8(batch.column("text"))
            lists = batch.column("wanted")
            rows = lists.flatten()
            sizes = np.diff(lists.offsets.to_numpy())
            if unit.words:
                starts, ends, before = words(data, at)
            else:
                starts = ends = None
                before = at
            text = np.repeat(np.arange(batch.num_rows), sizes)
            place = ints(rows.field("place"))
            start, count = place >> SHIFT, place & ((1 << SHIFT) - 1)
            low = before[text] + start
            high = low + count - 1 + unit.length
            a, b = (starts[low], ends[high - 1]) if unit.words else (low, high)
            whole = data.tobytes()
            yield pa.RecordBatch.from_arrays(
                [rows.field("key"), rows.field("share"), rows.field("split"), *(batch.column(c).take(pa.array(text)) for c in ("doc", "variant")), pa.array(start), pa.array([whole[x:y] for x, y in zip(a.tolist(), b.tolist(), strict=True)], pa.binary())],
                ["key", "share", "split", "doc", "variant", "start", "context"],
            )

    gathered = wanted.groupBy("doc", "variant").agg(F.collect_list(F.struct("key", "place", "share", "split")).alias("wanted"))  # of one text
    found = docs.join(gathered, ["doc", "variant"]).select("doc", "variant", "text", "wanted")
    return found.mapInArrow(run, "key bigint, share int, split boolean, doc bigint, variant bigint, start bigint, context binary")


def shares(found: DataFrame, unit: Unit, solve: Solver, partitions: int) -> DataFrame:
    """Repeats found within shares as ``doc, variant, lo, hi``; with hashes, windows of split keys that are first in theirs."""

    def solved(held: list[tuple]) -> pa.RecordBatch:
        order = sorted(range(len(held)), key=lambda i: held[i][1:4])
        rows = [held[i] for i in order]
        texts = [r[1:3] for r in rows]
        # where an earlier start in a document counts, rows of one id are texts one after the other
        docs = np.cumsum([i > 0 and t != texts[i - 1] for i, t in enumerate(texts)]) if unit.within else np.array([d for d, _ in texts], np.int64)
        starts = np.array([r[3] for r in rows], np.int64)
        earlier = solve([r[4] for r in rows], docs, starts)
        out: list[list[np.ndarray]] = [[], [], [], [], [], []]
        for (split, doc, variant, start, context), e in zip(rows, earlier, strict=True):
            if e.any():
                edge = np.flatnonzero(np.diff(np.r_[0, e, 0]))
                lo, hi = start + edge[::2], start + edge[1::2] - 1 + unit.length
                for o, v in zip(out, (np.full(len(lo), doc), np.full(len(lo), variant), lo, hi, np.zeros(len(lo), np.int64), np.zeros(len(lo), np.int64)), strict=True):
                    o.append(v)
            if split and not e.all():
                data = np.frombuffer(context, np.uint8)
                symbols = unit.symbols(data, np.array([0, len(data)]))[0]
                first = np.flatnonzero(~e)
                h1 = Spans(symbols).all(unit.length)[first].view(np.int64)
                h2 = Spans(reduced(mix(symbols + U(1)))).all(unit.length)[first].view(np.int64)
                for o, v in zip(out, (np.full(len(first), doc), np.full(len(first), variant), start + first, np.full(len(first), -1), h1, h2), strict=True):
                    o.append(v)
        cells = [np.concatenate(o) if o else np.zeros(0, np.int64) for o in out]
        return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in cells], ["doc", "variant", "lo", "hi", "h1", "h2"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, now = [], 0, None
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("key", "share", "split", "doc", "variant", "start", "context")]
            for key, share, split, doc, variant, start, context in zip(*columns, strict=True):
                if size >= CHUNK and (key, share) != now:
                    yield solved(held)
                    held, size = [], 0
                now = key, share
                held.append((split, doc, variant, start, context))
                size += len(context)
        if held:
            yield solved(held)

    return found.repartition(partitions, "key", "share").sortWithinPartitions("key", "share").mapInArrow(run, SOLVED)


def identified(docs: DataFrame, key: str, text: str, *more: Column) -> tuple[DataFrame, bool]:
    """``doc, variant, text`` and more, and whether ids occur more than once.

    Variants tell rows of one id with different texts apart, in order; where every id occurs once they are all 0.
    """
    doc = F.coalesce(F.col(key).cast("bigint"), F.lit(LEAST))
    repeated = docs.select(doc.alias("doc")).groupBy("doc").agg(F.count("*").alias("n")).where("n > 1").limit(1).count()
    text = F.coalesce(F.col(text), F.lit(""))
    variant = F.xxhash64(text) if repeated else F.lit(0).cast("bigint")
    return docs.select(doc.alias("doc"), variant.alias("variant"), text.alias("text"), *more), bool(repeated)


def repeats(docs: DataFrame, repeated: bool, unit: Unit, solve: Solver) -> DataFrame:
    """``doc, variant, lo, hi``: spans of symbols of ``doc, variant, text`` covered by windows that also start earlier.

    Takes what ``identified`` gives.
    """
    docs = docs.select("doc", "variant", "text")
    if repeated:  # equal rows once
        docs = docs.groupBy("doc", "variant").agg(F.first("text").alias("text"))
    known = written(named(runs(docs, unit), unit), "named")
    windows = F.col("place").bitwiseAND((1 << SHIFT) - 1)
    start = F.shiftright("place", SHIFT)
    copies = known.where("key is null").select("doc", "variant", start.alias("lo"), (start + windows - 1 + unit.length).alias("hi"))
    wanted = known.where("key is not null")
    symbols = wanted.agg(F.sum(windows + unit.length)).first()[0] or 0
    partitions = int(max(1, min(symbols * (8 if unit.words else 1) // PARTITION + 1, MOST_PARTITIONS)))
    solved = written(shares(contexts(docs, wanted, unit), unit, solve, partitions), "solved")
    split = solved.where("hi < 0")
    order = F.struct("doc", "variant", "lo") if unit.within else F.col("doc")
    least = split.groupBy("h1", "h2").agg(F.min(order).alias("least"), F.count("*").alias("n")).where("n > 1").drop("n")
    across = split.join(least, ["h1", "h2"]).where(order > F.col("least")).select("doc", "variant", "lo", (F.col("lo") + unit.length).alias("hi"))
    return copies.unionByName(solved.where("hi >= 0").select("doc", "variant", "lo", "hi")).unionByName(across)


def merged(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Disjoint, maximal spans that cover the same symbols."""
    if not len(lo):
        return lo, hi
    order = np.argsort(lo, kind="stable")
    lo, hi = lo[order], np.maximum.accumulate(hi[order])
    new = np.ones(len(lo), bool)
    new[1:] = lo[1:] > hi[:-1]
    last = np.r_[np.flatnonzero(new)[1:], len(lo)] - 1
    return lo[new], hi[last]


def with_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """Documents with the list ``spans`` of what repeats in each; null without any."""
    packed = spans.groupBy("doc", "variant").agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))  # of one text
    return docs.join(packed, ["doc", "variant"], "left")


def spans_of(batch: pa.RecordBatch) -> list[tuple[np.ndarray, np.ndarray]]:
    """Merged spans of each row of a batch of ``with_spans``."""
    lists = batch.column("spans")
    at, rows = lists.offsets.to_numpy(), lists.values
    lo, hi = ints(rows.field("lo")), ints(rows.field("hi"))
    valid = lists.is_valid().to_pylist()
    return [merged(lo[at[i] : at[i + 1]], hi[at[i] : at[i + 1]]) if ok else merged(lo[:0], hi[:0]) for i, ok in enumerate(valid)]
