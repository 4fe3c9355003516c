"""Operators on single texts: fingerprints, languages, tokens and packing."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from cubelark.llm import fingerprints, language, packing, pieces, queries

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def test_prefix_hashes_answer_spans_and_extensions():
    a, b = fingerprints.PrefixHash("the cat sat on the mat"), fingerprints.PrefixHash("a cat sat on the hat")
    assert a.same(4, b, 2, 10) and not a.same(4, b, 3, 10)
    assert a.extension(3, b, 1) == len(" cat sat on the ")
    assert a.extension(0, b, 0) == 0 and a.extension(22, b, 0) == 0


def test_likeness():
    text = " ".join(f"w{i}" for i in range(400))
    own = fingerprints.fingerprint(text)
    assert own == fingerprints.fingerprint(str(text)) and fingerprints.likeness(own, own) == 1
    half = fingerprints.fingerprint(text[: len(text) // 2] + "".join(f" v{i}" for i in range(400)))
    other = fingerprints.fingerprint("".join(f" u{i}" for i in range(400)))
    assert 0.25 < fingerprints.likeness(own, half) < 0.8 and fingerprints.likeness(own, other) < 0.1
    empty = fingerprints.fingerprint("")
    assert fingerprints.likeness(empty, empty) == 1 and fingerprints.likeness(empty, own) == 0


def spans_of(text, n):
    return {text[i : i + n] for i in range(len(text) - n + 1)}


def plain_likeness(a, b):
    """The share of spans that two texts have both, of the longest spans that four of fit into the shorter text."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    length = next(n for n in (24, 6, 2, 1) if min(len(a), len(b)) >= (4 * n if n > 1 else 1))
    x, y = spans_of(a, length), spans_of(b, length)
    shared = len(x & y) / len(x | y)
    return 2 * shared / (1 + shared)


def test_likeness_is_the_share_of_spans(odd_rows):
    texts = [t or "" for _, t in odd_rows]
    texts += ["abcdefgh", "abcdefg", "xbcdefgh", "a", "b", "ab"]
    prints = [fingerprints.fingerprint(t) for t in texts]
    for a, x in zip(texts, prints, strict=True):
        for b, y in zip(texts, prints, strict=True):
            got, want = fingerprints.likeness(x, y), plain_likeness(a, b)
            # exact where all spans are kept, else an estimate from 32 or 64 of them
            assert abs(got - want) < (1e-9 if max(len(a), len(b)) <= 32 else 0.3), (a[:50], b[:50])


def test_likeness_across_lengths_of_spans():
    text = " ".join(f"w{i * 37 % 101}" for i in range(60))
    for n in (2, 8, 24, 32, 64, 96):
        for cut in (1, n // 8):
            a, b = text[:n], text[: n - cut]
            got = fingerprints.likeness(*map(fingerprints.fingerprint, (a, b)))
            assert got > 0.6 and abs(got - plain_likeness(a, b)) < 0.2


def test_long_texts_are_hashed_in_slabs(monkeypatch):
    texts = ["".join(chr(97 + (i * i + i // 7) % 26) for i in range(n)) for n in (1000, 1001, 999, 500, 250, 257)]
    texts.append(texts[0][:700] + "é" + texts[0][701:])
    whole = [fingerprints.fingerprint(t) for t in texts]
    monkeypatch.setattr(fingerprints, "SLAB", 250)
    assert [fingerprints.fingerprint(t) for t in texts] == whole
    for b in texts:
        n = next((i for i, (x, y) in enumerate(zip(texts[0], b, strict=False)) if x != y), min(len(texts[0]), len(b)))
        assert fingerprints.common_prefix(texts[0], b) == n


def test_sketches_are_the_least_hashes():
    """Of every length of spans the least mixed hashes, from spans hashed one by one."""
    text = "".join(chr(97 + i * i % 23) + "é" * (i % 3) for i in range(200))
    hashes = fingerprints.PrefixHash(text)
    for length, found in zip(fingerprints.SPANS, fingerprints.sketches(len(text), hashes, len(text)), strict=True):
        if length > 2:
            plain = {sum((ord(c) + 1) * pow(fingerprints.BASES[0], i, 2**31 - 1) for i, c in enumerate(s)) % (2**31 - 1) for s in spans_of(text, length)}
        else:
            plain = {sum((ord(c) + 1) << 21 * (len(s) - 1 - i) for i, c in enumerate(s)) for s in spans_of(text, length)}
        mixed = set()
        for x in plain:
            x = (x + 0x9E3779B97F4A7C15 + length) * 0xBF58476D1CE4E5B9 % 2**64
            mixed.add((x ^ x >> 31) * 0x94D049BB133111EB % 2**64 >> 32)
        assert found.tolist() == sorted(mixed)[: 64 if length == 24 else 32]


def test_fingerprints_of_every_row(table, odd_rows):
    found = sorted(fingerprints.fingerprints(table(odd_rows)).collect(), key=lambda r: (r["doc_id"], r["n_chars"]))
    rows = sorted(odd_rows, key=lambda r: (r[0], r[1] or ""))
    assert [r["doc_id"] for r in found] == [d for d, _ in rows]
    for (_, text), (_, following), r in zip(rows, [*rows[1:], rows[0]], found, strict=True):
        text, following = text or "", following or ""
        half = len(text) // 2
        assert r["n_chars"] == len(text)
        assert r["edited_sha256"] == hashlib.sha256((text[: len(text) - half] + following[:half]).encode()).hexdigest()
        changed = text[: len(text) - half] + following[:half]
        assert r["fingerprint"] == fingerprints.fingerprint(text) and r["edited_fingerprint"] == fingerprints.fingerprint(changed)
        for got, other in ((r["near_edited"], changed), (r["near_next"], following)):
            assert 0 <= got <= 1 and abs(got - plain_likeness(text, other)) < 0.3
    assert fingerprints.fingerprints(table([])).count() == 0
    assert fingerprints.fingerprints(table([(None, "alone")])).first()["near_next"] == 1.0


def test_language_of_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = language.identify(docs).join(docs, "doc_id").where("held_out")
    right = found.where("lang = lang_pred").count() / found.count()
    assert right >= 0.95
    assert found.where("score < 0 or score > 1").count() == 0


def test_odd_texts_have_no_language(table, odd_rows):
    found = {r["doc_id"]: r for r in language.identify(table(odd_rows)).collect()}
    assert all(found[d]["lang_pred"] == "und" and found[d]["score"] == 0 for d in (1, 2, 3, 60))
    assert found[7]["lang_pred"] == "en"
    assert language.identify(table([])).count() == 0
    assert language.identify(table([(None, "text"), (1, None)])).where("lang_pred = 'und'").count() == 2


def test_language_and_source_are_no_inputs(table, odd_rows):
    from pyspark.sql import functions as F

    docs = table(odd_rows)
    net = language.learn(docs, ~language.held_out())
    a = language.predict(docs, net).collect()
    b = language.predict(docs.withColumn("lang", F.lit("xx")).withColumn("source", F.lit("s")), net).collect()
    assert a == b


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab \n\t▁é\0中.😀'")), max_size=40))
def test_pieces_are_the_librarys(text):
    tool = pieces.encoder(MODEL)
    assert tool.ids(text).tolist() == tool.model.encode(text)
    ids, starts, ends = tool.spans(text)
    data = text.encode()
    assert all(0 <= s <= e <= len(data) for s, e in zip(starts, ends, strict=True))
    if len(ids):
        assert ends[-1] == len(data) and (starts[1:] == ends[:-1]).all() and starts[0] == 0


def compiled_map():
    """A trie for b"a" -> "bc" and b"ab" -> "x": units by hand, label and offset as the format packs them."""
    units = np.zeros(1024, np.uint32)
    put = lambda at, label, offset, leaf: units.__setitem__(at, label | leaf << 8 | offset << 10)
    put(0, 0, 256, 0)
    a = 256 ^ ord("a")
    put(a, ord("a"), a ^ 512, 1)
    units[512] = 1 << 31 | 0
    b = 512 ^ ord("b")
    put(b, ord("b"), b ^ 768, 1)
    units[768] = 1 << 31 | 3
    return (units.nbytes).to_bytes(4, "little") + units.tobytes() + b"bc\0x\0"


def test_compiled_character_map():
    normal = pieces.Normalizer(pieces.CharMap(compiled_map()), prefix=False, squeeze=False)
    assert normal.first[ord("a")] and not normal.first[1:97].any() and not normal.first[98:].any()
    assert normal(b"a.ab").text == b"bc.x"
    assert normal(b"a.ab").source.tolist() == [0, 0, 1, 2, 4]
    squeezed = pieces.Normalizer(pieces.CharMap(b""), prefix=True, squeeze=True)("  x  y ".encode())
    assert squeezed.text.decode() == "▁x▁y"


@pytest.fixture(scope="module", params=["plain", "mapped", "mapped, squeezed"])
def piece_model(request, tmp_path_factory):
    """The public model, and small ones with a compiled map, unknown characters and squeezed spaces; none is trained."""
    from sentencepiece import sentencepiece_model_pb2

    if request.param == "plain":
        return MODEL
    proto = sentencepiece_model_pb2.ModelProto()
    for i, piece in enumerate(["<unk>", "▁", "b", "c", "x", "▁x", "bc", "y", ".", "▁b"]):
        proto.pieces.add(piece=piece, score=-float(i), type=1 if i else 2)
    proto.normalizer_spec.precompiled_charsmap = compiled_map()
    proto.normalizer_spec.remove_extra_whitespaces = "squeezed" in request.param
    path = tmp_path_factory.mktemp("models") / "small.model"
    path.write_bytes(proto.SerializeToString())
    return str(path)


@settings(max_examples=150, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(text=st.text(alphabet=st.sampled_from(list("ab xc\n\t▁é.中😀'")), max_size=30))
def test_spans_are_the_librarys(piece_model, text):
    tool = pieces.encoder(piece_model)
    ids, starts, ends = tool.spans(text)
    theirs = tool.model.encode(text, return_type="proto").pieces
    assert ids.tolist() == [p.id for p in theirs]
    assert tool.normalizer(text.encode()).text.decode() == tool.model.normalize(text)
    # the library gives the bytes of a character, or of what a map made of one, to the last of its pieces
    open_ = 0
    for i, p in enumerate(theirs):
        if p.begin < p.end:
            assert (starts[open_], ends[i]) == (p.begin, p.end)
            open_ = i + 1
        elif starts[i] == ends[i]:
            open_ = i + 1


def test_digests_of_ids_from_parts():
    ids = list(range(95, 130))
    assert {pieces.listed(ids, n) for n in (1, 7, 35, 100)} == {hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()}
    assert pieces.listed([]) == hashlib.sha256(b"").hexdigest()


def test_piece_digests(table, odd_rows):
    tool = pieces.encoder(MODEL).model
    found = sorted(pieces.encode_digests(table(odd_rows), MODEL).collect())
    want = []
    for d, t in odd_rows:
        ids = tool.encode(t or "")
        starts = [p.begin for p in tool.encode(t or "", return_type="proto").pieces]
        spans = np.array([*starts, len((t or "").encode())] if ids else [], "<i8").tobytes()
        want.append((d, len(ids), *(hashlib.sha256(x).hexdigest() for x in (",".join(map(str, ids)).encode(), tool.decode(ids).encode(), spans))))
    assert [tuple(r) for r in found] == sorted(want)
    assert pieces.encode_spans(table(odd_rows), MODEL).count() == len(odd_rows)
    assert pieces.encode_digests(table([]), MODEL).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab \n\t'sé\x1c\x85中1.😀\u200b\u3000")), max_size=40))
def test_tokens_are_the_librarys(text):
    tool = packing.tokenizer(*queries.BYTE_BPE)
    for t in (text, f"{text}<|endoftext|> {text}"):
        assert np.frombuffer(tool.ids(t), "<u4").tolist() == tool.exact.encode(t, add_special_tokens=False).ids


@settings(max_examples=150, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(text=st.text(alphabet=st.sampled_from(list("ab \n\t\r's\x1c\x85\xa0中。，ん、ัก\u180e1.😀\u200b\u3000é")), max_size=60), span=st.integers(1, 8))
def test_tokens_of_texts_cut_at_seams(monkeypatch, text, span):
    monkeypatch.setattr(packing, "SPAN", span)
    tool = packing.tokenizer(*queries.BYTE_BPE)
    for t in (text, f"{text}中<|endoftext|> {text}"):
        assert "".join(packing.spans(t)) == t
        assert np.frombuffer(tool.ids(t), "<u4").tolist() == tool.exact.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("unit", ["word 中 ", "漢字かな、漢字。", "กัน 12\n"])
def test_the_library_is_given_long_texts_in_parts(unit):
    """Its memory is some 180 bytes a byte: a text of 10 MB with one character such as these took 2 GB."""
    tool = packing.Tokenizer(*queries.BYTE_BPE)
    text = unit * (4 * packing.SPAN // len(unit))
    want, given, whole = tool.exact.encode(text, add_special_tokens=False).ids, [], tool.exact

    class Recorder:
        def encode(self, part, **how):
            given.append(len(part))
            return whole.encode(part, **how)

    tool.exact = Recorder()
    assert np.frombuffer(tool.ids(text), "<u4").tolist() == want
    assert len(given) > 1 and max(given) <= packing.SPAN + len(unit)


def test_packing(table, odd_rows, sample_rows):
    tool = packing.tokenizer(*queries.BYTE_BPE).exact
    rows = odd_rows + [(d + 1000, t) for d, t in sample_rows]
    found = packing.packed(table(rows), queries.BYTE_BPE).toPandas()
    by_doc = {}
    for d, t in rows:
        by_doc[d] = tool.encode(t or "", add_special_tokens=False).ids + [2]
    for doc, own in found.groupby("doc_id"):
        ids = by_doc[doc]
        for r in own.itertuples():
            part = ids[r.start : r.start + r.length]
            assert len(part) == r.length and r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
            assert r.piece == 0 or r.length == 1024
        copies = sum(d == doc for d, _ in rows)
        assert own.length.sum() == len(ids) * copies
        assert len(own) == copies * -(-len(ids) // 1024)
    used = found.sort_values(["sequence_id", "offset"])
    assert (used.groupby("sequence_id").length.cumsum() - used.length == used.offset).all()
    assert used.groupby("sequence_id").length.sum().max() <= 1024
    assert used.sequence_id.nunique() <= 1.02 * -(-found.length.sum() // 1024) + 1
    assert packing.packed(table([]), queries.BYTE_BPE).count() == 0


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_every_capacity_holds(rule):
    room = packing.Capacities(tokens=100, documents=4, attention=5000, rule=rule)
    rng = np.random.default_rng(1)
    histogram = dict(zip(*(x.tolist() for x in np.unique(rng.integers(1, 70, 3000), return_counts=True)), strict=True))
    bins = {}
    placed = {}
    for length, number, count, sequence, offset in packing.best_fit(histogram, room).rows:
        for i in range(count):
            bins.setdefault(sequence + i, []).append((offset, length))
            placed.setdefault(length, set()).add(number + i)
    assert {k: len(v) for k, v in placed.items()} == histogram
    for items in bins.values():
        items.sort()
        assert sum(n for _, n in items) <= 100 and len(items) <= 4 and sum(n * n for _, n in items) <= 5000
        assert all(a + n == b for (a, n), (b, _) in zip(items, items[1:], strict=False))
    with pytest.raises(ValueError):
        packing.best_fit({99: 1}, room)


def plain_best_fit(lengths, room):
    """Best-fit decreasing, piece by piece, on tokens alone, with every capacity."""
    bins = []
    for n in sorted(lengths, reverse=True):
        fits = [b for b in bins if sum(b) + n <= room.tokens and len(b) < room.documents and sum(x * x for x in b) + n * n <= room.attention]
        if fits:
            max(fits, key=sum).append(n)
        else:
            bins.append([n])
    return bins


@pytest.mark.parametrize(("documents", "attention"), [(1024, 1 << 20), (3, 1 << 20), (1024, 1 << 18)])
def test_no_more_sequences_than_plain_best_fit(documents, attention):
    room = packing.Capacities(documents=documents, attention=attention)
    for seed in range(8):
        rng = np.random.default_rng(seed)
        lengths = np.minimum(rng.lognormal(5 - seed % 3, 1, 400).astype(int) + 1, int(attention**0.5)).tolist()
        histogram = dict(zip(*(x.tolist() for x in np.unique(lengths, return_counts=True)), strict=True))
        plan = packing.fewest(histogram, room)
        assert plan.sequences <= len(plain_best_fit(lengths, room)) and plan.sequences >= -(-sum(lengths) // 1024)
        assert sum(count * length for length, _, count, _, _ in plan.rows) == sum(lengths)


def test_other_capacities_decide():
    """Two sequences with as much room for tokens: the norm takes the one that has less room for documents and attention."""
    room = packing.Capacities(tokens=100, documents=10, attention=10_000)
    rows = packing.best_fit({60: 1, 30: 2, 40: 0, 10: 1}, room).rows
    assert [r[3] for r in sorted(rows, reverse=True)] and {r[0]: r[3] for r in rows}[10] == 0
    histogram = {50: 2, 26: 1, 24: 1, 25: 0, 12: 1}
    few, many = (packing.best_fit(histogram, packing.Capacities(tokens=100, documents=d, attention=10_000)) for d in (2, 10))
    assert few.sequences > many.sequences


def plain_network(net, window):
    """Logits of one window, filter by filter and place by place."""
    out = net.out_bias.astype(float).copy()
    per = language.FILTERS
    for f in range(net.filters.shape[1]):
        width = language.WIDTHS[f // per]
        best = -np.inf
        for i in range(language.WINDOW - language.WIDEST + 1):
            best = max(best, sum(float(net.embed[window[i + j]] @ net.filters[j * language.EMBEDDED : (j + 1) * language.EMBEDDED, f]) for j in range(width)))
        out += max(best + float(net.bias[f]), 0.0) * net.out[f]
    return out


def test_network_against_a_plain_convolution():
    rng = np.random.default_rng(2)
    windows = rng.integers(0, 256, (5, language.WINDOW)).astype(np.uint8)
    windows[3, 40:] = 0
    net = language.train(windows, np.array([0, 1, 2, 0, 1]), ["a", "b", "c"])
    found = net.log_softmax(windows)
    for w, row in zip(windows, found, strict=True):
        z = plain_network(net, w)
        assert row == pytest.approx(z - z.max() - np.log(np.exp(z - z.max()).sum()), abs=1e-3)


def test_gradients_against_differences(monkeypatch):
    """One step of training moves every weight against the sign of the loss's slope, which differences give."""
    rng = np.random.default_rng(4)
    windows, labels = rng.integers(97, 101, (6, language.WINDOW)).astype(np.uint8), np.array([0, 1, 2, 2, 1, 0])
    monkeypatch.setattr(language, "EPOCHS", 0)
    before = language.train(windows, labels, ["a", "b", "c"])
    monkeypatch.setattr(language, "EPOCHS", 1)
    after = language.train(windows, labels, ["a", "b", "c"])
    loss = lambda: -float(before.log_softmax(windows).astype(float)[np.arange(6), labels].mean())
    checked = right = 0
    for name in ("embed", "filters", "bias", "out", "out_bias"):
        weights, moved = getattr(before, name), getattr(after, name) - getattr(before, name)
        places = np.argwhere(np.abs(moved) > 1e-3)  # Adam's first step is as long for every weight with a slope
        for place in map(tuple, places[rng.permutation(len(places))[:12]]):
            kept = weights[place]
            weights[place] = kept + 2e-3
            up = loss()
            weights[place] = kept - 2e-3
            slope = (up - loss()) / 4e-3
            weights[place] = kept
            if abs(slope) > 1e-3:
                checked += 1
                right += np.sign(slope) == -np.sign(moved[place])
    assert checked >= 20 and right >= 0.95 * checked


def test_training_sample_of_repeated_ids(spark):
    """Rows of one id are learned each under its own language, whatever the order of the rows."""
    from pyspark.sql import functions as F

    rows = [(1, "alpha beta", "en"), (1, "gamma delta", "de"), (1, "gamma delta", "de"), (1, "epsilon", None), (None, "zeta", "fr"), (2, "", "en")]
    want = {("en", "alpha beta"), ("de", "gamma delta")}  # rows without id are never learned
    for some in (rows, rows[::-1]):
        docs = spark.createDataFrame(some, "doc_id long, text string, lang string")
        found = [(r["lang"], r["piece"]) for r in language.sample(docs, F.lit(True)).collect()]
        assert len(found) == len(want) and set(found) == want
