"""Exact Jaccard join of shingle sets: a size-aware join of heavy and light sets.

Light sets are few shingles long: all their subsets of the fixed sizes that a partner over the
threshold must share are enumerated, so that partners meet at a common subset. For heavy sets that
would be far too many; they are entered into inverted lists, and the lists scanned. The boundary is
the size up to which subsets cost less (see ``boundary``); sizes that partner across it do both.

A heavy set enters the lists of its prefix alone: its rarest shingles, one more than it can lack of a
partner's (two sets over the threshold share a shingle of both prefixes, whatever the common order).
Rarity is exact, over all sets: shingles go in sorted, packed runs to ranges of hashes, where they are
counted, and those that occur again go back to their chunk of documents. A shingle that occurs once
has no list; most documents have enough of these to fill their prefix, and take no further part.
Shingles that are common in a chunk are counted there first, so that no range receives a shingle more
often than there are chunks.

Lists are combined within a task before they are shuffled: one of a task's sets enters a list there, the
others are joined to it by edges, so that a list receives a set from each task, not all sets of a large group.
Lists are then scanned in sorted streams. A list of m sets gives m - 1 edges, not all pairs; the components
of these edges are blocks, inside of which all links lie. Blocks are cut by classes of sizes, of which only
equal or neighbouring ones can link, and classes into tiles of ``TILE`` sets or ``TILE_SHINGLES`` shingles;
each pair of tiles is verified exactly by a product of incidence matrices, in its own group. Links leave a
group as stars of its components, too, and as the number of rows that each set links with there; ``links`` has
the pairs themselves, between classes of equal sets.

Sets are known by a 64-bit number. A second, independent one is kept with it: where sets differ in that but
not in the first, which chance does once in about 2**64 pairs, all sets are numbered anew by other hashes.
Shingles are told apart by 64-bit hashes.

Defined results: a text without words (null, empty) has an empty set, which is linked with nothing;
with fewer words than a shingle the whole sequence is the one shingle; equal sets are one node
throughout; rows of equal ids (nulls are one id, the smallest) are linked like others, each by its own text,
and their components can have one ``component_id``; an empty table gives an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations
from math import comb, log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cubelark.llm import repeats
from cubelark.llm.common import ints, parts, slices, utf8, written
from cubelark.llm.components import components

U = np.uint64
SLICE = 1 << 18
#: Shingles, and sets, of a chunk of documents.
CHUNK, CHUNK_SETS = 1 << 21, 1 << 16
#: Rows that a light set's subsets may cost for each list of a prefix: a list has to be verified.
WORTH = 4
#: From this count on, a shingle is counted within its chunk before it goes to its range.
COMMON = 64
BITS = 48  # of a shingle's hash, where it is counted
MARK = 1 << 31
#: Sets, and shingles, of a tile on average.
TILE, TILE_SHINGLES = 128, 1 << 18
FILTER = 1 << 23  # bits of the filter of documents that take part in verification
#: Bytes of text for each range of hashes, and the most ranges as a power of two; shingles unpacked at once.
RANGE, MOST_RANGES, AT_ONCE = 1 << 21, 16, 1 << 24
#: What a pair of tiles is known by.
GROUP = ("block", "size", "next", "i", "j")
#: Kinds of rows, in ``n``; a document's is its size.
SIGNATURE, EDGE, COUNTED, INFO = -1, -2, -3, -4


@dataclass(frozen=True)
class Rule:
    """Sets link when ``den * intersection >= num * union``."""

    words: int
    num: int
    den: int

    def overlap(self, a: int, b: int) -> int:
        """The least intersection of two linked sets of these sizes."""
        return -(-self.num * (a + b) // (self.num + self.den))

    def partners(self, a: int) -> range:
        """Sizes that a linked set can have."""
        return range(-(-self.num * a // self.den), self.den * a // self.num + 1)

    def subset_sizes(self, a: int) -> list[int]:
        return sorted({c for b in self.partners(a) if (c := self.overlap(a, b)) <= min(a, b)})

    def prefix(self, a: int) -> int:
        """How many of its rarest shingles a set must enter."""
        return a - -(-self.num * a // self.den) + 1


@lru_cache(maxsize=8)
def boundary(rule: Rule) -> int:
    """The largest size up to which enumerating subsets costs less than the lists of a prefix."""
    size = 0
    while sum(comb(size + 1, c) for c in rule.subset_sizes(size + 1)) <= WORTH * rule.prefix(size + 1):
        size += 1
    return size


def shingle_sets(data: np.ndarray, at: np.ndarray, n_words: int) -> list[np.ndarray]:
    """The sorted hashes of the distinct shingles of each text; A-Z count as lower case."""
    data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    starts, ends, before = repeats.words(data, at)
    symbols = repeats.word_symbols(data, starts, ends)
    last = np.maximum(before[1:] - n_words, before[:-1] - 1)  # starts of shingles end here
    step = 1 << 20
    every = [repeats.chained(symbols[i : i + step + n_words - 1], n_words) for i in range(0, max(1, len(symbols)), step)]
    every = np.concatenate(every) if len(every) > 1 else every[0]
    out = []
    for a, b, e in zip(before[:-1].tolist(), before[1:].tolist(), last.tolist(), strict=True):
        if b - a >= n_words:
            out.append(np.unique(every[a : e + 1]))
        else:
            out.append(repeats.chained(symbols[a:b], b - a) if b > a else np.zeros(0, U))
    return out


def subsets(shingles: np.ndarray, rule: Rule) -> np.ndarray:
    """Keys of all the subsets that a light set is entered under."""
    mixed, keys = repeats.mix(shingles), []
    n, total = len(mixed), mixed.sum(dtype=U)
    for c in rule.subset_sizes(n):
        # a subset by what it leaves out, of which there is less
        out = np.array([mixed[list(left)].sum(dtype=U) for left in combinations(range(n), n - c)], U) if n > c else np.zeros(1, U)
        keys.append(repeats.mix(total - out + U(c * 0x9E3779B97F4A7C15 % (1 << 64))))
    return np.concatenate(keys)


def pack(hashes: np.ndarray, *columns: np.ndarray) -> bytes:
    """Sorted hashes as differences, with 32-bit columns, byte plane by byte plane, compressed."""
    planes = [np.diff(hashes, prepend=U(0)).view(np.uint8).reshape(-1, 8).T] + [c.astype("<u4").view(np.uint8).reshape(-1, 4).T for c in columns]
    return len(hashes).to_bytes(8, "little") + pa.compress(b"".join(p.tobytes() for p in planes), codec="zstd", asbytes=True)


def unpack(blob: bytes, columns: int) -> list[np.ndarray]:
    n = int.from_bytes(blob[:8], "little")
    data = np.frombuffer(pa.decompress(blob[8:], n * (8 + 4 * columns), codec="zstd", asbytes=True), np.uint8)
    hashes = np.cumsum(np.ascontiguousarray(data[: 8 * n].reshape(8, n).T).view("<u8").reshape(-1), dtype=U)
    return [hashes] + [np.ascontiguousarray(data[(8 + 4 * i) * n : (12 + 4 * i) * n].reshape(4, n).T).view("<u4").reshape(-1).astype(np.int64) for i in range(columns)]


ROWS = "key bigint, node bigint, other bigint, n bigint, packed binary"


def batch_of(names: str, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, pa.binary() if isinstance(c, list) else pa.int64()) for c in columns], names.split())


def nodes_of(sets: list[np.ndarray], salt: int) -> np.ndarray:
    """One number for equal sets; those of two salts are independent."""
    mask = U((0x5851F42D4C957F2D + salt * 0x9E3779B97F4A7C15) % (1 << 64))
    return repeats.mix(np.array([int(repeats.mix(s ^ mask).sum(dtype=U)) for s in sets], U) + mask).view(np.int64) if sets else np.zeros(0, np.int64)


def leaders(key: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Each key of lists with one node, and edges that join the other nodes of its list to that."""
    order = np.lexsort((node, key))
    key, node = key[order], node[order]
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    first = node[np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))] if len(key) else node
    x, y = node[node != first], first[node != first]
    names, places = np.unique(np.r_[x, y], return_inverse=True)
    return key[new], node[new], *stars(names, places[: len(x)], places[len(x) :])


def list_rows(key: np.ndarray, node: np.ndarray) -> pa.RecordBatch:
    """Rows of lists, a list's nodes being combined: one enters it, the others have an edge."""
    key, node, src, dst = leaders(key, node)
    n = np.repeat([SIGNATURE, EDGE], [len(key), len(src)])
    other = np.r_[np.zeros(len(key), np.int64), dst]
    return batch_of("key node other n packed", np.r_[key.view(np.int64), repeats.mix(src.view(U)).view(np.int64)], np.r_[node, src], other, n, [None] * len(n))


def entries(docs: DataFrame, rule: Rule, ranges: int, salt: int) -> DataFrame:
    """Of ``doc, text``: rows of documents, subsets of light sets, and shingles of heavy ones by range of hashes.

    A document's row has a second number of its set, by which sets are told apart whose nodes are equal by chance.
    """
    light = boundary(rule)
    both = rule.den * light // rule.num
    shift = U(BITS - ranges.bit_length() + 1)
    names = "key node other n packed"

    def rows(key, node, other, n, packed=None):
        key = np.asarray(key)
        return batch_of(names, key.view(np.int64), *(np.broadcast_to(np.asarray(c, np.int64), len(key)) for c in (node, other, n)), packed or [None] * len(key))

    def counted(nodes: list[int], sets: list[np.ndarray], chunk: int):
        """A chunk's shingles to their ranges, and what its documents are to the chunk's own number."""
        hashes = np.concatenate(sets) >> U(64 - BITS)
        owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        order = np.argsort(hashes, kind="stable")
        hashes, owner = hashes[order], owner[order]
        first = np.flatnonzero(np.r_[True, hashes[1:] != hashes[:-1]])
        count = np.diff(np.r_[first, len(hashes)])
        common = np.repeat(count >= COMMON, count)
        kept = pack(hashes[common], owner[common])
        once = first[count >= COMMON]
        token = np.concatenate([hashes[~common], hashes[once]])
        who = np.concatenate([owner[~common], MARK + count[count >= COMMON]])
        order = np.argsort(token, kind="stable")
        token, who = token[order], who[order]
        part = (token >> shift).astype(np.int64)
        edge = np.r_[np.flatnonzero(np.r_[True, part[1:] != part[:-1]]), len(part)]
        packed = [pack(token[a:b], who[a:b]) for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]
        yield rows(part[edge[:-1]], chunk, 0, COUNTED, packed)
        sizes = np.array([len(s) for s in sets], np.int64)
        info = np.array(nodes, np.int64).tobytes() + sizes.tobytes()
        yield rows([chunk, chunk], chunk, [0, 1], INFO, [info, kept])

    def run(batches):
        from pyspark import TaskContext

        chunk, size = TaskContext.get().partitionId() << 24, 0
        sets, nodes, known = [], [], set()
        keys, owners, seen, held = [], [], set(), 0
        for batch in slices(batches, SLICE):
            found = shingle_sets(*utf8(batch.column("text")), rule.words)
            docs, own = ints(batch.column("doc")), nodes_of(found, salt)
            yield rows(repeats.mix(docs.astype(U)), own, docs, [len(s) for s in found], [x.tobytes() for x in nodes_of(found, -1 - salt)])
            for s, node in zip(found, own.tolist(), strict=True):
                if 0 < len(s) <= both and node not in seen:
                    seen.add(node)
                    keys.append(subsets(s, rule))
                    owners.append(np.full(len(keys[-1]), node))
                    held += len(keys[-1])
            if held >= CHUNK:
                yield list_rows(np.concatenate(keys), np.concatenate(owners))
                keys, owners, seen, held = [], [], set(), 0
            for s, node in zip(found, own.tolist(), strict=True):
                if len(s) > light and node not in known:
                    known.add(node)
                    sets.append(s)
                    nodes.append(node)
                    size += len(s)
            if size >= CHUNK or len(sets) >= CHUNK_SETS:
                yield from counted(nodes, sets, chunk)
                sets, nodes, known, size, chunk = [], [], set(), 0, chunk + 1
        if keys:
            yield list_rows(np.concatenate(keys), np.concatenate(owners))
        if sets:
            yield from counted(nodes, sets, chunk)

    return docs.mapInArrow(run, ROWS)


KNOWN = "node bigint, other bigint, n bigint, packed binary"


def again(blobs: list[tuple[int, bytes]], ranges: int):
    """Of one range: to each chunk, those of its shingles that occur more than once, with their counts.

    A range of over ``AT_ONCE`` shingles is worked on by parts of it, so that no more are unpacked at once.
    """
    steps = sum(int.from_bytes(b[:8], "little") for _, b in blobs) // AT_ONCE
    within = BITS - ranges.bit_length() + 1  # bits of a token within its range
    bits = min(steps.bit_length(), within)
    for part in range(1 << bits):
        parts = [unpack(b, 1) for _, b in blobs] if not bits else [sliced(unpack(b, 1), part, within - bits, within) for _, b in blobs]
        if any(len(p[0]) for p in parts):
            yield counts(np.array([c for c, _ in blobs], np.int64), parts)


def sliced(columns: list[np.ndarray], part: int, shift: int, within: int) -> list[np.ndarray]:
    place = (columns[0] & U((1 << within) - 1)) >> U(shift)
    a, b = np.searchsorted(place, [part, part + 1])
    return [c[a:b] for c in columns]


def counts(chunks: np.ndarray, parts: list[list[np.ndarray]]) -> pa.RecordBatch:
    token, who = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
    source = np.repeat(np.arange(len(parts)), [len(p[0]) for p in parts])
    order = np.argsort(token, kind="stable")
    token, who, source = token[order], who[order], source[order]
    first = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
    total = np.add.reduceat(np.where(who >= MARK, who - MARK, 1), first)
    count = np.repeat(total, np.diff(np.r_[first, len(token)]))
    order = np.flatnonzero(count > 1)
    order = order[np.argsort(source[order], kind="stable")]
    token, who, source, count = token[order], who[order], source[order], np.minimum(count[order], MARK)
    edge = np.r_[np.flatnonzero(np.r_[True, source[1:] != source[:-1]]), len(source)] if len(source) else np.zeros(1, np.int64)
    packed = [pack(token[a:b], who[a:b], count[a:b]) for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]
    to = chunks[source[edge[:-1]]]
    return batch_of("node other n packed", to, np.full(len(to), 2), np.full(len(to), COUNTED), packed)


def scanned(rows: DataFrame, ranges: int) -> DataFrame:
    """Edges from the sets of each list to its first; ranges counted; other rows as they are."""

    def run(batches):
        key0 = leader0 = node0 = at = None
        blobs: list[tuple[int, bytes]] = []
        for batch in batches:
            key, node, other, n = (ints(batch.column(c)) for c in ("key", "node", "other", "n"))
            packed = batch.column("packed")
            for i in np.flatnonzero(n == COUNTED).tolist():
                if blobs and key[i] != at:
                    yield from again(blobs, ranges)
                    blobs = []
                at = key[i]
                blobs.append((int(node[i]), packed[i].as_py()))
            lists = n == SIGNATURE
            k, v = key[lists], node[lists]
            new = np.ones(len(k), bool)
            new[1:] = k[1:] != k[:-1]
            leader = v[np.maximum.accumulate(np.where(new, np.arange(len(k)), 0))] if len(k) else v
            twice = np.zeros(len(k), bool)
            twice[1:] = ~new[1:] & (v[1:] == v[:-1])
            if len(k):
                if k[0] == key0:
                    leader = np.where(k == key0, leader0, leader)
                    twice[0] = v[0] == node0
                key0, leader0, node0 = k[-1], leader[-1], v[-1]
            edge = (v != leader) & ~twice
            yield batch_of("node other n packed", v[edge], leader[edge], np.full(int(edge.sum()), EDGE), [None] * int(edge.sum()))
            rest = (n >= 0) | (n == INFO) | (n == EDGE)
            yield batch_of("node other n packed", node[rest], other[rest], n[rest], packed.filter(pa.array(rest)))
        if blobs:
            yield from again(blobs, ranges)

    return rows.repartition("key").sortWithinPartitions("key", "node").mapInArrow(run, KNOWN)


def prefixes(known: DataFrame, rule: Rule) -> DataFrame:
    """The lists that heavy sets enter, as rows of signatures: by chunk, from what occurs again there."""

    def entered(parts: dict[int, list[bytes]]):
        info = np.frombuffer(parts[0][0], np.int64)
        nodes, sizes = info[: len(info) // 2], info[len(info) // 2 :]
        found = [unpack(b, 2) for b in parts.get(2, [])]
        if not found:
            return nodes[:0].view(U), nodes[:0]
        token, who, count = (np.concatenate([f[i] for f in found]) for i in (0, 1, 2))
        marked = who >= MARK
        if marked.any():  # common shingles: their documents are in the chunk's own list
            order = np.argsort(token[marked])
            hot, hot_count = token[marked][order], count[marked][order]
            kept, owner = unpack(parts[1][0], 1)
            token, who, count = np.concatenate([token[~marked], kept]), np.concatenate([who[~marked], owner]), np.concatenate([count[~marked], hot_count[np.searchsorted(hot, kept)]])
        need = np.array([rule.prefix(int(s)) for s in sizes]) - (sizes - np.bincount(who, minlength=len(sizes)))
        open_ = need[who] > 0
        token, who, count = token[open_], who[open_], count[open_]
        order = np.lexsort((token, count, who))
        token, who = token[order], who[order]
        first = np.searchsorted(who, np.arange(len(sizes)))
        take = np.arange(len(who)) - first[who] < need[who]
        return repeats.mix(token[take] + U(0x5DEECE66D)), nodes[who[take]]

    def run(batches):
        now, parts = None, {}
        for batch in batches:
            for node, other, packed in zip(*(batch.column(c).to_pylist() for c in ("node", "other", "packed")), strict=True):
                if node != now:
                    if parts:
                        yield list_rows(*entered(parts))
                    now, parts = node, {}
                parts.setdefault(other, []).append(packed)
        if parts:
            yield list_rows(*entered(parts))

    dealt = known.where(F.col("n").isin(COUNTED, INFO)).select("node", "other", "packed").repartition("node").sortWithinPartitions("node")
    return dealt.mapInArrow(run, ROWS)


def linked(sets: list[np.ndarray], others: list[np.ndarray], rule: Rule) -> tuple[np.ndarray, np.ndarray]:
    """Places of all linked pairs of two lists of sets."""
    a, b = np.array([len(s) for s in sets]), np.array([len(s) for s in others])
    left, right = np.concatenate(sets), np.concatenate(others)
    shared = np.intersect1d(left, right)
    rows, columns = np.repeat(np.arange(len(a)), a), np.repeat(np.arange(len(b)), b)
    both = np.zeros((len(a), len(b)), np.float32)
    for start in range(0, len(shared), 4096):
        some = shared[start : start + 4096]
        x, y = np.zeros((len(a), len(some)), np.float32), np.zeros((len(b), len(some)), np.float32)
        for matrix, tokens, owner in ((x, left, rows), (y, right, columns)):
            place = np.minimum(np.searchsorted(some, tokens), len(some) - 1)
            hit = some[place] == tokens
            matrix[owner[hit], place[hit]] = 1
        both += x @ y.T
    common = both.astype(np.int64)
    union = a[:, None] + b[None, :] - common
    return np.nonzero((rule.den * common >= rule.num * union) & (common > 0))


def stars(nodes: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from each node to the smallest of its component, for pairs ``x, y`` of places."""
    root = np.arange(len(nodes))
    while True:  # the smaller root of both ends, until nothing moves
        low = np.minimum(root[x], root[y])
        after = root.copy()
        np.minimum.at(after, root[x], low)
        np.minimum.at(after, root[y], low)
        after = after[after]
        if (after == root).all():
            break
        root = after
    moved = root != np.arange(len(nodes))
    return nodes[moved], nodes[root[moved]]


def verified(members: DataFrame, docs: DataFrame, rule: Rule, salt: int, pairs: bool = False) -> DataFrame:
    """``src, dst, n``: stars of linked sets (n is 0), and how many rows of other sets a node links with (``src = dst``).

    With ``pairs`` each linked pair, once. ``members`` has ``node, doc, copies, block, size, tiles``: a document for each node, the class of its
    size and, by class, the tiles of its block. Linked sets are of one class or of neighbouring ones.
    """

    bits = members.select((F.pmod(F.xxhash64("doc"), F.lit(FILTER)) + 1).alias("bit"))  # these functions count from 1
    rows = bits.groupBy(F.expr("bitmap_bucket_number(bit)").alias("bucket")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(bit))").alias("bits")).collect()  # FILTER bits at most
    width = 32768
    bitmap = np.zeros(FILTER // 8, np.uint8)
    for r in rows:
        bitmap[(r["bucket"] - 1) * width // 8 : r["bucket"] * width // 8] = np.frombuffer(r["bits"], np.uint8)
    shared = docs.sparkSession.sparkContext.broadcast(np.unpackbits(bitmap, bitorder="little").astype(bool))

    def sets(batches):
        known = set()  # of a row that is repeated, one will do
        for batch in slices(batches, SLICE):
            batch = batch.filter(pa.array(shared.value[ints(batch.column("bit"))]))
            found = shingle_sets(*utf8(batch.column("text")), rule.words)
            docs, own = ints(batch.column("doc")), nodes_of(found, salt)
            new = [i for i, row in enumerate(zip(docs.tolist(), own.tolist(), strict=True)) if row not in known and not known.add(row)]
            yield pa.RecordBatch.from_arrays([pa.array(docs[new]), pa.array(own[new]), pa.array([found[i].tobytes() for i in new], pa.binary())], ["doc", "node", "shingles"])

    def compare(batches):
        """Streams groups (block, size, next, i, j): tile i and, of the same or the next class of sizes, tile j."""
        held: list[tuple] = []

        def done():
            rows = sorted({(own, node): (np.frombuffer(s, U), copies) for own, node, s, copies in held}.items(), key=lambda r: r[0])
            first = [r for r in rows if not r[0][0]]
            second = [r for r in rows if r[0][0]]
            one = not now[2] and now[3] == now[4]
            nodes = np.array([r[0][1] for r in first + second], np.int64)
            copies = np.array([r[1][1] for r in first + second], np.int64)
            xs, ys = [], []
            other = first if one else second
            # a tile may hold more than its share by chance: bounded steps
            for s in range(0, len(first), TILE):
                for o in range(s if one else 0, len(other), TILE):
                    x, y = linked([r[1][0] for r in first[s : s + TILE]], [r[1][0] for r in other[o : o + TILE]], rule)
                    xs.append(x + s)
                    ys.append(y + o + (0 if one else len(first)))
            if not xs:
                return nodes[:0], nodes[:0], nodes[:0]
            x, y = np.concatenate(xs), np.concatenate(ys)
            x, y = x[x < y], y[x < y]  # within a tile, both ways and loops
            if pairs:
                return nodes[x], nodes[y], np.zeros(len(x), np.int64)
            src, dst = stars(nodes, x, y)
            n = np.zeros(len(nodes), np.int64)
            np.add.at(n, x, copies[y])
            np.add.at(n, y, copies[x])
            own = nodes[n > 0]
            return np.r_[src, own], np.r_[dst, own], np.r_[np.zeros(len(src), np.int64), n[n > 0]]

        now = None
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in (*GROUP, "second", "node", "shingles", "copies")]
            out = []
            for *group, second, node, shingles, copies in zip(*columns, strict=True):
                if now != group:
                    if len(held) > 1:
                        out.append(done())
                    held, now = [], group
                held.append((second, node, shingles, copies))
            if out:
                yield edges(out)
        if len(held) > 1:
            yield edges([done()])

    def edges(out):
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[i] for o in out])) for i in (0, 1, 2)], ["src", "dst", "n"])

    hashed = docs.select("doc", "text", F.pmod(F.xxhash64("doc"), F.lit(FILTER)).alias("bit"))
    # rows of one id can have different texts: each node gets its own set
    found = hashed.mapInArrow(sets, "doc bigint, node bigint, shingles binary").join(members, ["doc", "node"]).select("node", "copies", "block", "size", "tiles", "shingles")
    count = lambda step: F.coalesce(F.try_element_at("tiles", F.col("size") + step), F.lit(0))
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    place = lambda size, following, i, j, second: F.struct(size.alias("size"), F.lit(following).alias("next"), i.alias("i"), j.alias("j"), second.alias("second"))
    size, tile = F.col("size"), F.col("tile")
    to = F.concat(
        F.transform(upto(count(0)), lambda u: place(size, 0, F.least(tile, u), F.greatest(tile, u), tile > u)),
        F.transform(upto(count(1)), lambda u: place(size, 1, tile, u, F.lit(False))),
        F.transform(upto(count(-1)), lambda u: place(size - 1, 1, u, tile, F.lit(True))),
    )
    dealt = found.withColumn("tile", F.pmod(F.xxhash64("node"), count(0)).cast("int")).select("block", F.explode(to).alias("to"), "node", "shingles", "copies")
    dealt = dealt.select("block", *(F.col(f"to.{c}").alias(c) for c in (*GROUP[1:], "second")), "node", "shingles", "copies")
    return dealt.repartition(*GROUP).sortWithinPartitions(*GROUP).mapInArrow(compare, "src bigint, dst bigint, n bigint")


def keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(key).cast("bigint"), F.lit(-(1 << 63))).alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("text"))


def size_class(rule: Rule) -> Column:
    """The class of the size ``n``: sizes of linked sets differ by one class at most."""
    return F.floor(F.log(F.col("n").cast("double")) / F.lit(max(log(rule.den / rule.num) * (1 + 1e-9), 1e-6))).cast("int")


def candidates(rows: DataFrame, rule: Rule) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """Of ``doc, text``: node and size of each row, the nodes with words, the members of blocks, and the salt of nodes."""
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = 1 << max((8 * parts(rows.sparkSession) - 1).bit_length(), min((size // RANGE).bit_length(), MOST_RANGES))
    salt = 0
    while True:
        known = written(scanned(entries(rows, rule, ranges, salt), ranges), "sets")
        number = F.xxhash64("packed")
        numbers = F.min(number).alias("low"), F.max(number).alias("high")
        nodes = written(known.where("n > 0").groupBy("node").agg(F.min("other").alias("doc"), F.first("n").alias("n"), F.count("*").alias("copies"), *numbers), "nodes")
        if not nodes.where("low <> high").head(1):
            break
        salt += 1  # different sets with equal nodes: by other hashes
    nodes = nodes.drop("low", "high")
    of_docs = known.where("n >= 0").select("node", F.col("other").alias("doc"), "n")
    edges = known.select("node", "other", "n").unionByName(scanned(prefixes(known, rule), ranges).select("node", "other", "n")).where(F.col("n") == EDGE)
    blocks = components(edges.select(F.col("node").alias("src"), F.col("other").alias("dst")))
    blocks = written(blocks.withColumnRenamed("label", "block"), "blocks")
    placed = blocks.join(nodes, "node").withColumn("size", size_class(rule))
    tiles = F.greatest(F.ceil(F.count("*") / TILE), F.ceil(F.sum("n") / TILE_SHINGLES)).cast("int")
    by_class = placed.groupBy("block", "size").agg(tiles.alias("tiles"))
    of_block = by_class.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("size", "tiles"))).alias("tiles"))  # a few classes of sizes
    members = placed.join(of_block, "block").select("node", "doc", "copies", "block", "size", "tiles")
    return of_docs, nodes, members, salt


def classed(rows: DataFrame, rule: Rule) -> tuple[DataFrame, DataFrame, int]:
    """Of ``doc, text``: node and size of each row; of each node with words its smallest doc, component and number of links; the salt."""
    of_docs, nodes, members, salt = candidates(rows, rule)
    found = written(verified(members, rows, rule, salt), "links")
    links = components(found.where("n = 0").select("src", "dst"))
    others = found.where("n > 0").groupBy(F.col("src").alias("node")).agg(F.sum("n").alias("others"))
    own = F.col("copies") - 1 + F.coalesce("others", F.lit(0))
    classes = nodes.join(links, "node", "left").join(others, "node", "left").select("node", "doc", F.coalesce("label", "node").alias("label"), own.alias("n_links"))
    return of_docs, written(classes, "classes"), salt


def joined(docs: DataFrame, rule: Rule, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc, n_shingles, component_id, class_id, n_links`` of each row.

    ``component_id`` is the smallest id that its links reach, ``class_id`` the number of its set (null without
    words), under which ``links`` has its links, and ``n_links`` the number of other rows that it links with.
    """
    of_docs, classes, _ = classed(keyed(docs, key, text), rule)
    least = classes.groupBy("label").agg(F.min("doc").alias("component_id"))
    of_nodes = classes.join(least, "label").select("node", "component_id", "n_links")
    found = of_docs.join(of_nodes, "node", "left")
    words = F.col("n") > 0
    own = F.when(words, F.col("component_id")).otherwise(F.col("doc"))
    return found.select("doc", F.col("n").alias("n_shingles"), own.alias("component_id"), F.when(words, F.col("node")).alias("class_id"), F.when(words, F.col("n_links")).otherwise(0).alias("n_links"))


def links(docs: DataFrame, rule: Rule, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``class_id, other_id``: each pair of different sets that link, once, by the classes of ``joined``; rows of one class link, too."""
    rows = keyed(docs, key, text)
    members, salt = candidates(rows, rule)[2:]
    found = verified(members, rows, rule, salt, pairs=True)
    return found.select(F.least("src", "dst").alias("class_id"), F.greatest("src", "dst").alias("other_id"))


def counted(docs: DataFrame, rule: Rule, key: str = "doc_id", text: str = "text") -> DataFrame:
    """As ``joined``, under the key's own name."""
    return joined(docs, rule, key, text).withColumn("doc", F.when(F.col("doc") != -(1 << 63), F.col("doc"))).withColumnRenamed("doc", key)


def clustered(docs: DataFrame, rule: Rule, key: str = "doc_id", text: str = "text") -> DataFrame:
    """As ``joined``, under the key's own name and without classes and numbers of links."""
    return joined(docs, rule, key, text).select(*(F.when(F.col(c) != -(1 << 63), F.col(c)).alias(n) for c, n in (("doc", key),)), "n_shingles", "component_id")


def distinct(docs: DataFrame, rule: Rule, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each component, with all its columns: of its smallest id, there of the least class, the least row.

    Rows without words are linked with nothing, and all stay. Columns must be of types that have an order.
    """
    of_docs, classes, salt = classed(keyed(docs, key, text), rule)
    first = classes.groupBy("label").agg(F.min(F.struct("doc", "node")).alias("first")).select("first.doc", "first.node")
    first = written(first, "first")
    repeated = written(of_docs.groupBy("doc").agg(F.count("*").alias("c")).where("c > 1").select(F.col("doc").alias("_copy")), "repeated")
    copies = of_docs.where("n > 0").join(first, ["doc", "node"], "left_anti").select(F.col("doc").alias("_copy")).unionByName(repeated).distinct()
    own = F.coalesce(docs[key].cast("bigint"), F.lit(-(1 << 63)))
    kept = docs.join(copies, own == copies["_copy"], "left_anti")
    if not repeated.head(1):
        return kept

    # rows whose id has others: an id doesn't tell which of them stays

    def nodes(batches):
        for batch in slices(batches, SLICE):
            found = shingle_sets(*utf8(batch.column("text")), rule.words)
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc"), pa.array(nodes_of(found, salt)), pa.array([len(s) for s in found], pa.int64())], ["row", "doc", "node", "n"])

    several = docs.join(repeated, own == repeated["_copy"], "left_semi")
    several = several.select(F.struct(*several.columns).alias("row"), own.alias("doc"), F.coalesce(several[text], F.lit("")).alias("text"))
    several = written(several.mapInArrow(nodes, f"row {several.schema['row'].dataType.simpleString()}, doc bigint, node bigint, n bigint"), "several")
    least = several.where("n > 0").join(first, ["doc", "node"], "left_semi").groupBy("doc", "node").agg(F.min("row").alias("row"))
    for rows in (several.where("n = 0"), least):
        kept = kept.unionByName(rows.select("row.*"))
    return kept
