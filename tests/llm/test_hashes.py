"""Texts that are built so that weak hashes take them for equal."""

import random

import brute
import numpy as np
import pytest

from cubelark.llm import automata, jaccard, repeats, suffixes


def twins(n):
    """Two words of ``n`` letters that polynomial hashes modulo powers of two don't tell apart: Thue and Morse's, and its complement."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_arithmetic_modulo_the_prime():
    rnd = random.Random(3)
    edge = [0, 1, repeats.PRIME - 1]
    a = np.array([rnd.randrange(repeats.PRIME) for _ in range(500)] + edge, np.uint64)
    b = np.array([rnd.randrange(repeats.PRIME) for _ in range(500)] + edge[::-1], np.uint64)
    assert repeats.times(a, b).tolist() == [int(x) * int(y) % repeats.PRIME for x, y in zip(a, b, strict=True)]
    spans, total = repeats.Spans(a), 0
    for i, x in enumerate(a.tolist()):
        total = (total + x * pow(repeats.BASE, i, repeats.PRIME)) % repeats.PRIME
        assert int(spans.prefix[i + 1]) == total
    assert spans(np.array([7]), np.array([90])) == repeats.Spans(a[7:90])(np.array([0]), np.array([83]))


@pytest.mark.parametrize("n", [2**i for i in range(6, 13)])
def test_twin_words_are_told_apart(n):
    x, y = twins(n)
    for a, b in ((x, y), (x + " q", y + " q")):
        sets = [jaccard.shingle_sets(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)]), 3)[0] for t in (a, b)]
        assert not np.intersect1d(*sets).size
    symbols = [repeats.TABLE[np.frombuffer(t.encode(), np.uint8)] for t in (x, y)]
    assert len({int(repeats.Spans(s)(np.array([0]), np.array([n]))[0]) for s in symbols}) == 2


def test_operators_on_twin_words(table):
    rows = []
    for i, n in enumerate(2**i for i in range(6, 13)):
        words = [f"w{i}x{k}" for k in range(20)]
        for j, twin in enumerate(twins(n)):
            rows.append((10 * i + j, " ".join([*words[:10], twin, *words[10:]])))
            rows.append((1000 + 10 * i + j, twin))
    found = {r[0]: tuple(r[1:]) for r in automata.digests(table(rows)).collect()}
    assert found == brute.word_dedup(rows) and not any(f[1] for d, f in found.items() if d < 1000)
    assert {r[0]: tuple(r[1:]) for r in suffixes.digests(table(rows)).collect()} == brute.suffix_dedup(rows)
    found = {r[0]: tuple(r[1:]) for r in jaccard.clustered(table(rows), jaccard.Rule(3, 90, 100)).collect()}
    assert found == brute.jaccard(rows, 3, 90, 100)
    kept = {r["doc_id"] for r in jaccard.distinct(table(rows), jaccard.Rule(3, 90, 100)).collect()}
    assert kept == {d for d, _ in rows}


def test_sets_with_equal_nodes_are_told_apart(table, monkeypatch):
    """Nodes of the first salt are made equal for all sets: the join hashes again."""
    whole = jaccard.nodes_of
    monkeypatch.setattr(jaccard, "nodes_of", lambda sets, salt: np.ones(len(sets), np.int64) if salt == 0 else whole(sets, salt))
    sets = [np.array([1, 2], np.uint64), np.array([3], np.uint64)]
    assert len(set(jaccard.nodes_of(sets, 0))) == 1 and len(set(jaccard.nodes_of(sets, -1))) == 2
    rows = [(1, "a b c d"), (2, "a b c d"), (3, "e f g h i"), (4, None)]
    found = {r[0]: tuple(r[1:]) for r in jaccard.clustered(table(rows), jaccard.Rule(3, 90, 100)).collect()}
    assert found == brute.jaccard(rows, 3, 90, 100)


@pytest.mark.parametrize("unit", [suffixes.UNIT, automata.UNIT])
def test_slabs_cover_every_window_once(monkeypatch, unit):
    rnd = random.Random(9)
    data = np.frombuffer(" ".join("".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(1, 9))) for _ in range(9000)).encode() + b" " + b"z" * 9000, np.uint8)
    whole, before = unit.symbols(data, np.array([0, len(data)]))
    monkeypatch.setattr(repeats, "SLAB", 4000)
    places = []
    for low, symbols, at in unit.slabs(data, np.array([0, len(data)])):
        assert len(symbols) < len(whole) and (unit.words and low or (symbols == whole[low : low + len(symbols)]).all())
        _, start, count, _, _ = repeats.runs_of(symbols, at, unit)
        places += [low + s + i for s, n in zip(start, count, strict=True) for i in range(n)]
    assert sorted(places) == list(range(int(before[-1]) - unit.length + 1))
    assert (repeats.word_symbols(data, *repeats.words(data, np.array([0, len(data)]))[:2])[:8990] == repeats.Spans(repeats.TABLE[data])(*repeats.words(data, np.array([0, len(data)]))[:2])[:8990] % repeats.PRIME).all()


@pytest.mark.parametrize(("digests", "plain"), [(suffixes.digests, brute.suffix_dedup), (automata.digests, brute.word_dedup)])
def test_long_texts(table, digests, plain):
    rnd = random.Random(9)
    long = " ".join("".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(1, 9))) for _ in range(420_000))
    assert len(long) > 2 * repeats.SLAB
    rows = [(1, long), (2, f"x {long[15000:20000]} {'z' * 9000} y {long[-1_200_000:-900_000]}"), (3, "z" * 9000), (4, long[:900])]
    found = {r[0]: tuple(r[1:]) for r in digests(table(rows)).collect()}
    assert found == plain(rows)


@pytest.mark.parametrize(("digests", "plain"), [(suffixes.digests, brute.suffix_dedup), (automata.digests, brute.word_dedup)])
def test_ids_with_different_texts(table, digests, plain):
    """Rows of one id, null too, are texts one after the other; none loses what only another of them repeats."""
    rnd = random.Random(10)
    words = lambda n: " ".join("".join(rnd.choice("abcdefgh") for _ in range(4)) for _ in range(n))
    passage = words(40)
    rows = [(None, f"{passage} {words(80)}"), (None, f"{words(60)} {passage}"), (5, passage), (5, f"{words(9)} {passage}"), (5, f"{words(9)} {passage}"), (6, words(30)), (6, words(31))]
    found = digests(table(rows)).collect()
    removed = {}
    for r in found:
        removed.setdefault(r[0], []).append(r[2])
    n = len(passage.encode()) if digests is suffixes.digests else 40
    within = digests is suffixes.digests  # an earlier start in the same document counts
    assert len(found) == len(rows) and removed[6] == [0, 0]
    near = lambda found, want: len(found) == len(want) and all(0 <= a - b <= 4 for a, b in zip(sorted(found), sorted(want), strict=True))
    assert near(removed[None], [0, n] if within else [0, 0])
    assert near(removed[5], [n, n, n])


@pytest.mark.parametrize(("digests", "plain"), [(suffixes.digests, brute.suffix_dedup), (automata.digests, brute.word_dedup)])
def test_keys_of_many_names_are_dealt_by_name(spark, table, digests, plain):
    """More names of a key in one chunk than ``HOT``, and others of it in other chunks."""
    rnd = random.Random(14)
    noise = lambda: " ".join("".join(rnd.choice("abcdefgh") for _ in range(3)) for _ in range(15))
    line = " ".join(f"word{i}" for i in range(22))
    rows = [(i, f"{noise()} {line} {noise()}") for i in range(3 * repeats.HOT)] + [(i + 5000, f"{noise()} {line} {noise()}") for i in range(20)]
    docs = table(rows).where("doc_id < 5000").coalesce(1).unionByName(table(rows).where("doc_id >= 5000"))
    found = {r[0]: tuple(r[1:]) for r in digests(docs).collect()}
    assert found == plain(rows)
