"""Dedup of repeated passages of words by suffix automata.

A shard of reference texts is held as one suffix automaton whose states know the smallest document
that their strings occur in. Documents are streamed through it word by word; the matching statistics,
cut at ``LENGTH`` words, give for each window of that length the first document that has it, and the
maximal spans of windows that an earlier document has are removed.

The reference of a document is all that comes before it, which no broadcast bounds. Therefore shards
aren't broadcast whole: runs of windows are dealt to shards by their content, together with the
documents' runs that could match them (see ``repeats``), so that each shard's automaton and the
texts streamed through it meet in one task of bounded size.

Defined results: a null text has no words; shorter texts lose nothing; a passage that repeats within
its document alone stays; rows of equal ids count as one document; an empty table gives an empty
table; other columns are left alone.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cubelark.llm import repeats
from cubelark.llm.common import slices, utf8

LENGTH = 13
UNIT = repeats.Unit(words=True, length=LENGTH, gram=2, within=False)


class SuffixAutomaton:
    """A suffix automaton of several rows of symbols, added in ascending order of their documents."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link, self.length, self.document = [-1], [0], [-1]

    def _state(self, after: dict, link: int, length: int, document: int) -> int:
        self.next.append(after)
        self.link.append(link)
        self.length.append(length)
        self.document.append(document)
        return len(self.link) - 1

    def _split(self, state: int, symbol, target: int) -> int:
        """The state for the longest string that ``state`` reads to ``target``'s class by ``symbol``."""
        if self.length[target] == self.length[state] + 1:
            return target
        clone = self._state(dict(self.next[target]), self.link[target], self.length[state] + 1, self.document[target])
        self.link[target] = clone
        while state >= 0 and self.next[state].get(symbol) == target:
            self.next[state][symbol] = clone
            state = self.link[state]
        return clone

    def add(self, symbols: list, document: int) -> None:
        last, after, link, length = 0, self.next, self.link, self.length
        for symbol in symbols:
            known = after[last].get(symbol)
            if known is not None:
                last = self._split(last, symbol, known)
                continue
            new = self._state({}, 0, length[last] + 1, document)
            state = last
            while state >= 0 and symbol not in after[state]:
                after[state][symbol] = new
                state = link[state]
            if state >= 0:
                link[new] = self._split(state, symbol, after[state][symbol])
            last = new

    def matches(self, symbols: list, most: int):
        """Matching statistics: for each symbol, the state and length (up to ``most``) of the longest match that ends there."""
        after, link, length = self.next, self.link, self.length
        state = matched = 0
        for symbol in symbols:
            while state and symbol not in after[state]:
                state = link[state]
                matched = length[state]
            if symbol in after[state]:
                state = after[state][symbol]
                matched += 1
                if matched >= most:
                    while length[link[state]] >= most:
                        state = link[state]
                    matched = most
            yield state, matched


def earlier(contexts: list[bytes], docs: np.ndarray, starts: np.ndarray, length: int = LENGTH) -> list[np.ndarray]:
    """For each context, sorted by document, which of its windows a smaller document of the list has too."""
    shard = SuffixAutomaton()
    rows = [c.split() for c in contexts]  # at the six ASCII white space bytes
    added = set()
    for row, context, doc in zip(rows, contexts, docs.tolist(), strict=True):
        if context not in added:
            added.add(context)
            shard.add(row, doc)
    first = shard.document
    return [np.array([n == length and first[state] < doc for state, n in list(shard.matches(row, length))[length - 1 :]], bool) for row, doc in zip(rows, docs.tolist(), strict=True)]


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Words, removed words, and the digest of the kept words joined by spaces, of each document."""

    def run(batches):
        for batch in slices(batches, 1 << 20):
            data, at = utf8(batch.column("text"))
            starts, ends, before = repeats.words(data, at)
            whole, out = data.tobytes(), []
            for i, (lo, hi) in enumerate(repeats.spans_of(batch)):
                first, n = int(before[i]), int(before[i + 1] - before[i])
                lo, hi = np.minimum(lo, n), np.minimum(hi, n)
                kept = []
                for a, b in zip(np.r_[0, hi].tolist(), np.r_[lo, n].tolist(), strict=True):
                    if a < b:
                        kept += whole[starts[first + a] : ends[first + b - 1]].split()
                out.append((n, int((hi - lo).sum()), hashlib.sha256(b" ".join(kept)).hexdigest()))
            n, removed, sha = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(sha, pa.string())], ["doc", "n_words", "n_removed", "kept_sha256"])

    keyed, repeated = repeats.identified(docs, key, text)
    spans = repeats.repeats(keyed, repeated, UNIT, earlier)
    found = repeats.with_spans(keyed, spans).select("doc", "text", "spans").mapInArrow(run, "doc bigint, n_words bigint, n_removed bigint, kept_sha256 string")
    return found.select(F.when(F.col("doc") != -(1 << 63), F.col("doc")).alias(key), "n_words", "n_removed", "kept_sha256")
