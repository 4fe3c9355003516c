"""Packing of tokenised documents into sequences by vector best-fit.

A document's ids are cut only if they exceed a sequence: into whole-sequence pieces, of which the
first may be shorter. Pieces then go, longest first, to the sequence that they fit best: every
sequence has residual capacities of tokens, documents and attention cost (the sum of squared piece
lengths), all of which must hold; among those where a piece fits, ``rule`` "norm" takes the least
weighted norm of what is left, "dot" the greatest weighted dot product of the piece and what is left.
A histogram is small enough to be packed by several rules and weights, of which the plan with the fewest
sequences is taken. With a capacity of tokens alone, as many documents and the square of it as attention
cost, the other two capacities follow from the first and decide by their weights only.

As pieces of one length are interchangeable, sequences are filled on the histogram of lengths: it
has one row for each length, however many documents there are, and sequences with the same content
are one group. Numbers within a length come from counts by (length, salt), so that a length that
holds a third of all pieces is split; groups map numbers to places.

Defined results: a null text is an empty one, which has the end id alone; repeated rows are packed
each for itself; ties between sequences go to the older group; an empty table gives an empty table.
"""

from __future__ import annotations

import base64
import re
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cubelark.llm.common import parts, slices, written

LENGTH = 1024
END = 2
#: Code points of a text that the tokenizer library is given at once, up to the next seam.
SPAN = 1 << 16
#: Where a byte-level pre-tokenizer cuts whatever surrounds the place: before whitespace that follows something else, and
#: between a letter and a mark of scripts without spaces. Characters whose class differs between libraries make no seam.
SEAM = re.compile(r"(?<=[^\s\u180e\u200b])(?=[ \t\r\n])|(?<=[\u3041-\u3093\u30a1-\u30f4\u4e00-\u9fa5])(?=[\u3001\u3002\uff01\uff0c\uff1a\uff1b\uff1f])")
#: Vocabulary file, ranks file and pattern of a tokenizer; files are at these paths on every executor.
Files = tuple[str, str, str]


class Tokenizer:
    """Ids of a byte-level BPE vocabulary, given as a tokenizer file and as ranks.

    The ranks' encoder is four times as fast and cuts texts by the same pattern; texts that hold a special
    token or characters whose classes differ between versions of Unicode go to the tokenizer file's own. That one
    takes some 180 bytes a byte of text, so that long texts are cut at seams, which doesn't change their ids; one
    without seams is encoded whole, and so are all texts where the vocabulary's rules may join what a seam cuts.
    """

    def __init__(self, vocabulary: str, ranks: str, pattern: str):
        import tiktoken
        import tokenizers

        self.exact = tokenizers.Tokenizer.from_file(vocabulary)
        added = self.exact.get_added_tokens_decoder().values()
        cutter = self.exact.pre_tokenizer
        plain = isinstance(cutter, tokenizers.pre_tokenizers.ByteLevel) and cutter.use_regex and not cutter.add_prefix_space and self.exact.normalizer is None
        self.seams = plain and not any(t.lstrip or t.rstrip or t.single_word or SEAM.search(t.content) for t in added)
        special = [re.escape(t.content) for t in added]
        self.odd = re.compile("|".join(["[\u0600-\u1fff\u2c00-\U0010ffff]", *special]))
        with open(ranks, "rb") as lines:
            merges = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=merges, special_tokens={})

    def ids(self, text: str) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers."""
        if self.seams and len(text) > SPAN and self.odd.search(text):
            return b"".join(map(self._ids, spans(text)))
        return self._ids(text)

    def _ids(self, text: str) -> bytes:
        if self.odd.search(text):
            return np.array(self.exact.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return self.fast.encode_to_numpy(text, disallowed_special=()).astype("<u4").tobytes()


def spans(text: str) -> Iterator[str]:
    """A text in parts of ``SPAN`` code points, each up to the next seam."""
    start = 0
    while seam := SEAM.search(text, start + SPAN):
        yield text[start : seam.start()]
        start = seam.start()
    yield text[start:]


@lru_cache(maxsize=2)
def tokenizer(*files: str) -> Tokenizer:
    return Tokenizer(*files)


def cut_points(n: int, length: int = LENGTH) -> list[int]:
    """Starts of the pieces of a document of n ids, and n."""
    first = n if n <= length else n % length or length
    return [0, *range(first, n, length), n] if n > first else [0, n]


def pieces(docs: DataFrame, files: Files, length: int = LENGTH, end: int = END, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, piece, start, length, ids_crc32`` of each piece."""
    last = array("I", [end]).tobytes()

    def run(batches):
        tool = tokenizer(*files)
        for batch in slices(batches, 1 << 20):
            out: list[tuple] = []
            for i, whole in enumerate(batch.column("text").to_pylist()):
                ids = tool.ids(whole or "") + last
                at = cut_points(len(ids) // 4, length)
                out += [(i, p, s, e - s, zlib.crc32(ids[4 * s : 4 * e])) for p, (s, e) in enumerate(zip(at, at[1:], strict=False))]
            cells = np.array(out, np.int64).reshape(-1, 5)
            yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(cells[:, 0])), pa.array(cells[:, 1].astype(np.int32)), *(pa.array(cells[:, c]) for c in (2, 3, 4))], ["key", "piece", "start", "length", "ids_crc32"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, piece int, start bigint, length bigint, ids_crc32 bigint")


@dataclass
class Capacities:
    """Of a sequence; ``weights`` are those of tokens, documents and attention cost in the rule."""

    tokens: int = LENGTH
    documents: int = LENGTH
    attention: int = LENGTH * LENGTH
    weights: tuple[float, float, float] = (1.0, 0.25, 0.25)
    rule: str = "norm"


#: Rules and weights of which ``fewest`` takes the best; the last is best-fit on tokens alone.
RULES = (("norm", (1.0, 0.25, 0.25)), ("dot", (1.0, 0.25, 0.25)), ("norm", (1.0, 0.0, 0.0)))


@dataclass
class Plan:
    """Runs of places: pieces of ``length`` numbered from ``number`` on go to sequences from ``sequence`` on, at ``offset``."""

    rows: list[tuple[int, int, int, int, int]] = field(default_factory=list)  # length, number, count, sequence, offset
    sequences: int = 0


def best_fit(histogram: dict[int, int], room: Capacities) -> Plan:
    """Vector best-fit decreasing over a histogram of lengths."""
    plan = Plan()
    full = np.array([room.tokens, room.documents, room.attention], np.float64)
    weights = np.array(room.weights) / full
    left = np.zeros((64, 3))  # residual capacities of each group of like sequences
    count, first = np.zeros(64, np.int64), np.zeros(64, np.int64)
    groups = 0

    def add(residual: np.ndarray, n: int, sequence: int) -> None:
        nonlocal groups, left, count, first
        if residual[0] < 1 or residual[1] < 1:
            return  # nothing fits any more
        if groups == len(left):
            alive = np.flatnonzero(count[:groups])
            if len(alive) > groups // 2:
                left, count, first = (np.concatenate([x, np.zeros_like(x)]) for x in (left, count, first))
            else:  # forget the empty ones
                for x in (left, count, first):
                    x[: len(alive)] = x[alive]
                count[len(alive) :] = 0
                groups = len(alive)
        left[groups], count[groups], first[groups] = residual, n, sequence
        groups += 1

    for length in sorted(histogram, reverse=True):
        remaining, number = histogram[length], 0
        item = np.array([length, 1, length * length], np.float64)

        def place(residual: np.ndarray, n: int, sequence: int) -> int:
            """Puts as many pieces as fit into each of up to n sequences; returns how many sequences got some."""
            nonlocal remaining, number
            fit = int((residual / item).min())
            used = min(n, remaining // fit) or 1
            copies = fit if remaining >= fit else remaining
            for c in range(copies):
                plan.rows.append((length, number, used, sequence, int(full[0] - residual[0]) + c * length))
                number += used
            remaining -= copies * used
            add(residual - copies * item, used, sequence)
            return used

        if (item > full).any():
            raise ValueError(f"a piece of {length} tokens exceeds the capacities of a sequence")
        while remaining:
            open_ = (count[:groups] > 0) & (left[:groups] >= item).all(axis=1)
            if open_.any():
                at = np.flatnonzero(open_)
                if room.rule == "dot":
                    score = -(left[at] * item * weights**2).sum(axis=1)
                else:
                    score = (((left[at] - item) * weights) ** 2).sum(axis=1)
                best = at[score.argmin()]
                residual, n, sequence = left[best].copy(), int(count[best]), int(first[best])
                count[best] = 0
                used = place(residual, n, sequence)
                if used < n:
                    add(residual, n - used, sequence + used)
            else:
                fit = int((full / item).min())
                plan.sequences += place(full, remaining // fit or 1, plan.sequences)
    return plan


def fewest(histogram: dict[int, int], room: Capacities) -> Plan:
    """The plan of fewest sequences of ``room``'s own rule and weights and of ``RULES``, under all its capacities; the first of equals."""
    rules = dict.fromkeys([(room.rule, room.weights), *RULES])
    return min((best_fit(histogram, replace(room, rule=r, weights=w)) for r, w in rules), key=lambda p: p.sequences)


def packed(docs: DataFrame, files: Files, room: Capacities | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every piece with its sequence and the place of its first id there."""
    room = room or Capacities()
    spark = docs.sparkSession
    cut = written(pieces(docs, files, room.tokens, key=key, text=text), "pieces")
    salted = cut.withColumn("salt", F.pmod(F.xxhash64("key", "piece", "ids_crc32"), F.lit(parts(spark))).cast("int"))
    counts = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # a row for each length up to a sequence's
    plan = fewest(histogram, room)
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).drop("n")
    within = Window.partitionBy("length", "salt").orderBy("key", "piece", "start", "ids_crc32")
    numbered = salted.withColumn("number", F.row_number().over(within) - 1).join(before, ["length", "salt"]).withColumn("number", F.col("number") + F.col("before"))
    rows = np.array(sorted(plan.rows), np.int64).reshape(-1, 5)
    shared = spark.sparkContext.broadcast(rows)  # groups of like sequences: bounded by lengths, not by documents

    def run(batches):
        plan = shared.value
        code = (plan[:, 0] << 44) + plan[:, 1]
        for batch in batches:
            length, number = batch.column("length").to_numpy(), batch.column("number").to_numpy()
            at = np.searchsorted(code, (length << 44) + number, "right") - 1
            own = [batch.column(c) for c in ("key", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*own, pa.array(plan[at, 3] + number - plan[at, 1]), pa.array(plan[at, 4])], ["key", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    kind = docs.schema[key].dataType.simpleString()
    placed = numbered.select("key", "piece", "start", "length", "ids_crc32", "number")
    return placed.mapInArrow(run, f"key {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint").withColumnRenamed("key", key)
