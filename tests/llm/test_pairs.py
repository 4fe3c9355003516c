"""Operators over pairs of texts, against brute force."""

import random

import brute
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cubelark.llm import automata, jaccard, repeats, suffixes
from cubelark.llm.components import components


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 3), max_size=60))
def test_suffix_arrays(symbols):
    found = suffixes.suffix_array(np.array(symbols, np.int64))
    assert found.tolist() == sorted(range(len(symbols)), key=lambda i: symbols[i:])


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text("ab", max_size=12), min_size=1, max_size=6), st.text("abc", max_size=20))
def test_matching_statistics(references, text):
    shard = suffixes_of = automata.SuffixAutomaton()
    for i, r in enumerate(references):
        shard.add(list(r), i)
    for end, (state, length) in enumerate(shard.matches(list(text), 5), 1):
        best = max(n for n in range(min(5, end) + 1) if any(text[end - n : end] in r for r in references))
        assert length == best
        if best:
            assert suffixes_of.document[state] == min(i for i, r in enumerate(references) if text[end - best : end] in r)


@pytest.mark.parametrize("unit", [suffixes.UNIT, automata.UNIT])
def test_equal_windows_have_equal_keys(unit):
    rnd = random.Random(2)
    words = [rnd.choice(["ab", "c", "dd", "eeé"]) for _ in range(400)]
    texts = [" ".join(words), "x " + " ".join(words[50:350]) + " y", " ".join(words[3:])]
    data = "".join(texts).encode()
    at = np.r_[0, np.cumsum([len(t.encode()) for t in texts])]
    symbols, before = unit.symbols(np.frombuffer(data, np.uint8), at)
    text, start, count, key, _ = repeats.runs_of(symbols, before, unit)
    keys = {}
    for t, s, n, k in zip(text, start, count, key, strict=True):
        for i in range(s, s + n):
            window = symbols[before[t] + i : before[t] + i + unit.length].tobytes()
            assert keys.setdefault(window, k) == k
    assert count.sum() == sum(max(0, int(b - a) - unit.length + 1) for a, b in zip(before, before[1:], strict=False))


def check_dedup(table, rows, digests, plain):
    found = {}
    for r in digests(table(rows)).collect():
        assert found.setdefault(r[0], tuple(r[1:])) == tuple(r[1:])
    assert found == plain(rows)


@pytest.mark.parametrize(("digests", "plain"), [(suffixes.digests, brute.suffix_dedup), (automata.digests, brute.word_dedup)])
def test_dedup(table, odd_rows, sample_rows, digests, plain):
    check_dedup(table, odd_rows + [(None, odd_rows[7][1])], digests, plain)
    check_dedup(table, sample_rows, digests, plain)
    assert digests(table([])).count() == 0


@pytest.mark.parametrize(("digests", "plain"), [(suffixes.digests, brute.suffix_dedup), (automata.digests, brute.word_dedup)])
def test_a_passage_that_all_share(table, digests, plain):
    """More runs of one key than a share holds, with other neighbours each."""
    rnd = random.Random(4)
    noise = lambda: " ".join("".join(rnd.choice("abcdefgh") for _ in range(3)) for _ in range(15))
    line = " ".join(f"word{i}" for i in range(22))
    rows = [(i, f"{noise()} {line} {noise()}") for i in range(2 * repeats.SHARE + 100)]
    check_dedup(table, rows, digests, plain)


def test_cut_texts_keep_whole_characters(table, odd_rows):
    found = {r["doc_id"]: r for r in suffixes.deduplicated(table(odd_rows)).collect()}
    assert set(table([]).columns) == set(suffixes.deduplicated(table([])).columns)
    assert found[1]["text"] == "" and found[2]["text"] == ""  # nothing was there to go
    assert 9 not in found  # nothing is left of a copy
    assert found[65]["text"].startswith("ü") and len(found[65]["text"]) == found[65]["n_chars"] < 201
    assert found[8]["text"] == dict(odd_rows)[8] and found[8]["key"] == "k"


RULES = [(3, 90, 100), (5, 80, 100), (2, 1, 2)]


@pytest.mark.parametrize("rule", RULES)
def test_joins(table, odd_rows, sample_rows, rule):
    for rows in (odd_rows, sample_rows):
        found = {r[0]: tuple(r[1:]) for r in jaccard.clustered(table(rows), jaccard.Rule(*rule)).collect()}
        assert found == brute.jaccard(rows, *rule)


def near(rnd, n, copies, edits):
    base = [f"{rnd.choice('abcdefgh')}{rnd.randint(0, 50)}" for _ in range(n)]
    for _ in range(copies):
        words = list(base)
        for _ in range(rnd.randint(0, edits)):
            words[rnd.randrange(n)] = f"e{rnd.randint(0, 10**6)}"
        yield " ".join(words[: n - rnd.randint(0, edits)])


@pytest.mark.parametrize("rule", RULES[:2])
def test_sizes_around_the_boundary_and_a_hot_group(table, rule):
    rnd = random.Random(8)
    texts = [t for n in (4, 5, 7, 8, 9, 10, 11, 12, 13, 15, 20, 40, 90) for t in near(rnd, n, 25, max(1, n // 30))]
    texts += near(rnd, 120, 700, 3)  # over more than one tile
    rnd.shuffle(texts)
    rows = list(enumerate(texts))
    found = {r[0]: tuple(r[1:]) for r in jaccard.clustered(table(rows), jaccard.Rule(*rule)).collect()}
    assert found == brute.jaccard(rows, *rule)


def plain_links(rows, n, num, den):
    """Numbers of links of each row, and linked pairs of different sets."""
    sets = [brute.shingles(t, n) for _, t in rows]
    link = lambda a, b: bool(a & b) and den * len(a & b) >= num * len(a | b)
    numbers = [sum(link(a, b) for j, b in enumerate(sets) if j != i) for i, a in enumerate(sets)]
    return numbers, {frozenset((a, b)) for a in sets for b in sets if a != b and link(a, b)}


@pytest.mark.parametrize("rule", RULES[:2])
def test_links_and_their_numbers(table, odd_rows, rule):
    rnd = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    chain = [" ".join(words[i : i + 50]) for i in (0, 2, 4, 4)]  # hang together through others; one is a copy
    rows = list(enumerate([*chain, *near(rnd, 60, 300, 4), *near(rnd, 8, 10, 1), "one", "", *(t for _, t in odd_rows)]))
    numbers, pairs = plain_links(rows, *rule)
    assert numbers[0] and numbers[0] != numbers[1] + numbers[2]
    found = {r["doc_id"]: r for r in jaccard.counted(table(rows), jaccard.Rule(*rule)).collect()}
    assert [found[d]["n_links"] for d, _ in rows] == numbers
    sets = {found[d]["class_id"]: brute.shingles(t, rule[0]) for d, t in rows if found[d]["class_id"] is not None}
    got = [frozenset(sets[c] for c in r) for r in jaccard.links(table(rows), jaccard.Rule(*rule)).collect()]
    assert len(got) == len(set(got)) and set(got) == pairs


def test_ids_with_different_texts(table):
    """Each row is linked by its own text, whatever other texts its id has."""
    rnd = random.Random(12)
    rule = (3, 90, 100)
    pairs = [list(near(rnd, 40, 2, 1)) for _ in range(30)]
    rows = [(None, a) for a, _ in pairs] + [(7, a) for a, _ in pairs[:9]] + [(100 + i, b) for i, (_, b) in enumerate(pairs)]
    numbers, want = plain_links(rows, *rule)
    assert len(want) > 5
    for some in (rows, rows[::-1]):
        found = jaccard.counted(table(some), jaccard.Rule(*rule)).collect()
        assert sorted((r["doc_id"] or 0, r["n_shingles"], r["n_links"]) for r in found) == sorted((d or 0, len(brute.shingles(t, 3)), n) for (d, t), n in zip(rows, numbers, strict=True))
        assert jaccard.links(table(some), jaccard.Rule(*rule)).count() == len(want)


def test_join_of_nothing_and_packing_of_hashes(table):
    rule = jaccard.Rule(3, 90, 100)
    assert jaccard.clustered(table([]), rule).count() == 0
    assert jaccard.clustered(table([(None, "a b c"), (3, "a b c")]), rule).select("component_id").distinct().count() == 1
    hashes = np.sort(np.random.default_rng(1).integers(0, 1 << 48, 1000).astype(np.uint64))
    a, b, c = jaccard.unpack(jaccard.pack(hashes, np.arange(1000), np.full(1000, jaccard.MARK + 5)), 2)
    assert (a == hashes).all() and (b == np.arange(1000)).all() and (c == jaccard.MARK + 5).all()


def test_distinct_keeps_one_of_each_group(table, odd_rows):
    rule = jaccard.Rule(5, 80, 100)
    kept = {r["doc_id"] for r in jaccard.distinct(table(odd_rows), rule).collect()}
    want = brute.jaccard(odd_rows, 5, 80, 100)
    assert kept == {d for d, (_, c) in want.items() if c == d}


def test_distinct_keeps_one_row_where_ids_are_null_or_repeated(table):
    rnd = random.Random(13)
    a, b = list(near(rnd, 60, 4, 1)), "other words that are alone here"
    rows = [(None, t) for t in a] + [(None, a[0]), (3, a[0]), (None, b), (4, b), (5, "x y z x"), (5, "x y z x"), (5, "p q r s"), (6, "p q r s"), (8, None), (8, None), (None, " ")]
    for some in (rows, rows[::-1], rows * 3):
        found = jaccard.distinct(table(some), jaccard.Rule(5, 80, 100))
        assert found.columns == table(some).columns
        times = len(some) // len(rows)
        groups = sorted("a" if r["text"] in a else r["text"] or "" for r in found.collect())
        assert groups == sorted(["a", b, "x y z x", "p q r s"] + ["", "", " "] * times)  # no words, no links
        ids = {r["text"]: r["doc_id"] for r in found.collect()}
        assert ids[b] is None and ids["p q r s"] == 5 and not any(ids.get(t) for t in a)


def test_components(spark):
    rnd = random.Random(6)
    edges = [(rnd.randint(0, 400), rnd.randint(0, 400)) for _ in range(260)] + [(i, i + 1) for i in range(500, 600)] + [(7, 7)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    found = {r[0]: r[1] for r in components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert found == {n: find(n) for n in root}
    assert components(spark.createDataFrame([], "src long, dst long")).count() == 0
