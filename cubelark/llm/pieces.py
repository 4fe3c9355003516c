"""SentencePiece encoding and decoding that keeps, for every piece, its bytes in the original text.

A text is normalised by the longest prefix that the model's compiled character map knows, which
records for each normalised byte the source byte it came from; white space is then escaped and
the pieces are projected back through that alignment. What a map does not touch is aligned in array
operations; ids are the library's own.

Pieces never join two words (no piece has a word's end before the escaped space, which is checked
when the model is loaded), so that words are encoded once and kept in a bounded table per worker.

Defined results: a null text is an empty one and has no pieces; repeated rows are encoded alike;
an empty table gives an empty table; all other columns are left alone.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cubelark.llm.common import slices

SPACE = "▁"
CUT = re.compile(f"(?<=[^ {SPACE}]) (?=[^ {SPACE}])")
#: Words whose encoding a worker keeps at once.
KEPT_WORDS = 400_000


class CharMap:
    """A compiled character map: a double-array trie from byte prefixes to replacement strings.

    Layout (fixed by the model format): 4 bytes little-endian length of the trie, the trie's
    32-bit units, then the replacements, each ended by a zero byte.
    """

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little") if blob else 0
        self.units = np.frombuffer(blob[4 : 4 + size], "<u4").tolist()
        self.strings = blob[4 + size :]

    def longest(self, text: bytes, at: int) -> tuple[int, int] | None:
        """Length of the longest known prefix of ``text[at:]`` and where its replacement starts."""
        units, found = self.units, None
        if not units:
            return None
        step = lambda unit: (unit >> 10) << ((unit & 512) >> 6)
        node = step(units[0])
        for i in range(at, len(text)):
            node ^= text[i]
            if node >= len(units) or units[node] & 0x800000FF != text[i]:
                break
            leaf, node = units[node] >> 8 & 1, node ^ step(units[node])
            if leaf:
                found = i + 1 - at, units[node] & 0x7FFFFFFF
        return found

    def starts(self, byte: int) -> bool:
        """Whether a known prefix begins with this byte."""
        if not self.units:
            return False
        unit = self.units[0]
        node = (unit >> 10 << ((unit & 512) >> 6)) ^ byte
        return node < len(self.units) and self.units[node] & 0x800000FF == byte

    def replacement(self, start: int) -> bytes:
        return self.strings[start : self.strings.index(b"\0", start)]


def code_point_length(first: int) -> int:
    return 1 if first < 0x80 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4


@dataclass(frozen=True)
class Normal:
    """A normalised text and, for each of its bytes and its end, the source byte it came from."""

    text: bytes
    source: np.ndarray


class Normalizer:
    """What the model does to a text before it is cut into pieces."""

    def __init__(self, charmap: CharMap, prefix: bool, squeeze: bool):
        self.charmap, self.prefix, self.squeeze = charmap, prefix, squeeze
        #: Bytes that a known prefix can begin with.
        self.first = np.array([charmap.starts(b) for b in range(256)], bool)

    def plain(self) -> bool:
        """Whether a text stays as it is, but for its spaces and a space before it."""
        return not self.first.any() and not self.squeeze

    def __call__(self, text: bytes) -> Normal:
        data = np.frombuffer(text, np.uint8)
        if self.plain():
            return self.spaced(data)
        space = SPACE.encode()
        out, source = bytearray(), []

        def known(at: int) -> tuple[int, bytes, bool]:
            """Bytes of the source from a place on, what they become, and whether by the map."""
            found = self.charmap.longest(text, at) if self.first[text[at]] else None
            if found:
                return found[0], self.charmap.replacement(found[1]), True
            n = code_point_length(text[at])
            return n, text[at : at + n], False

        def put(byte: int, at: int) -> None:
            piece = space if byte == 32 else bytes([byte])
            out.extend(piece)
            source.extend([at] * len(piece))

        at = 0
        if self.squeeze:  # spaces before anything else
            while at < len(text) and (first := known(at))[1] == b" ":
                at += first[0]
        if self.prefix and at < len(text):
            put(32, at)
        blank = self.squeeze
        while at < len(text):
            n, new, mapped = known(at)
            left = len(new) - len(new.lstrip(b" ")) if blank else 0
            for i in range(left, len(new)):
                put(new[i], at if mapped else at + i)
            if left < len(new):
                blank = self.squeeze and new.endswith(b" ")
            at += n
        if self.squeeze:
            while out.endswith(space):
                at = source[-len(space)]
                del out[-len(space) :], source[-len(space) :]
        return Normal(bytes(out), np.array([*source, at], np.int64))

    def spaced(self, data: np.ndarray) -> Normal:
        """A text in which no prefix is known: its spaces escaped, in array operations."""
        space = np.frombuffer(SPACE.encode(), np.uint8)
        before = len(space) if self.prefix and len(data) else 0
        wide = np.where(data == 32, len(space), 1).astype(np.uint8)
        n = before + int(wide.sum(dtype=np.int64))
        source = np.empty(n + 1, np.int32 if len(data) < 1 << 31 else np.int64)
        source[:before], source[n] = 0, len(data)
        source[before:n] = np.repeat(np.arange(len(data), dtype=source.dtype), wide)
        out = np.empty(n, np.uint8)
        out[:before] = space[:before]
        out[before:] = data[source[before:n]]
        escaped = np.flatnonzero(out[before:] == 32).reshape(-1, len(space)) + before
        out[escaped] = space
        return Normal(out.tobytes(), source)


class Encoder:
    """Encodes with a SentencePiece model; ids, and the source bytes of every piece."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(self.model.serialized_model_proto())
        spec = proto.normalizer_spec
        self.normalizer = Normalizer(CharMap(spec.precompiled_charsmap), spec.add_dummy_prefix, spec.remove_extra_whitespaces)
        pieces = [p.piece for p in proto.pieces]
        self.splits = (
            self.normalizer.plain()
            and spec.escape_whitespaces
            and not proto.trainer_spec.treat_whitespace_as_suffix
            and not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in pieces)
            and not any(p.type == 4 for p in proto.pieces)  # user-defined pieces match across anything
        )
        # bytes of normalised text that a piece covers: a byte piece has one, the unknown piece is asked for
        self.covers = np.array([1 if p.type == 6 else len(p.piece.encode()) for p in proto.pieces], np.int64)
        self.unknown = self.model.unk_id()
        self.known: dict[str, bytes] = {}

    def _learn(self, words: set[str]) -> None:
        """Puts the ids, as little-endian 32-bit integers, of words that follow a space into the table."""
        missing = list(words - self.known.keys())
        if len(self.known) + len(missing) > KEPT_WORDS:
            self.known = {}
            missing = list(words)
        for word, ids in zip(missing, self.model.encode(missing, num_threads=1), strict=True):
            self.known[word] = array("i", ids).tobytes()

    def ids_of(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of whole texts, as the library gives them."""
        if not self.splits or not self.normalizer.prefix:
            return [np.array(x, "<i4") for x in self.model.encode(texts, num_threads=1)]
        cut: list[list[str] | None] = []
        for text in texts:
            plain = "  " not in text and SPACE not in text and text[:1] != " " and text[-1:] != " "
            cut.append([] if not text else None if "\0" in text else text.split(" ") if plain else CUT.split(text))
        self._learn(set().union(*filter(None, cut)))
        known = self.known
        return [np.array(self.model.encode(t, num_threads=1), "<i4") if c is None else np.frombuffer(b"".join([known[w] for w in c]), "<i4") for t, c in zip(texts, cut, strict=True)]

    def ids(self, text: str) -> np.ndarray:
        return self.ids_of([text])[0]

    def decode(self, ids: list[int]) -> str:
        return self.model.decode(ids)

    def ends_of(self, text: str, ids: np.ndarray) -> np.ndarray:
        """Where each piece ends in the normalised text, in bytes."""
        if (ids == self.unknown).any():  # its length isn't fixed: the library says where it ends
            pieces = self.model.encode(text, return_type="proto").pieces
            return np.cumsum([len(p.piece.encode()) if p.id == self.unknown else int(self.covers[p.id]) for p in pieces])
        return np.cumsum(self.covers[ids])

    def spans_of(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Of each text, ids with the start and end, in bytes of its UTF-8, of what each stands for."""
        out = []
        for text, ids in zip(texts, self.ids_of(texts), strict=True):
            normal = self.normalizer(text.encode())
            if not len(ids):
                out.append((ids, np.zeros(0, np.int64), np.zeros(0, np.int64)))
                continue
            ends = self.ends_of(text, ids)
            if ends[-1] != len(normal.text):
                raise ValueError("pieces don't cover the normalised text: the model has a rule that isn't known here")
            places = normal.source[np.r_[0, ends]]
            out.append((ids, places[:-1], places[1:]))
        return out

    def spans(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self.spans_of([text])[0]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder for each worker process."""
    return Encoder(path)


def encode_spans(docs: DataFrame, model: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """For each row its key, ``ids`` and the byte spans ``starts`` and ``ends`` of its pieces.

    ``model`` is the path of a model file on every executor.
    """

    def run(batches):
        for batch in slices(batches, 1 << 20):
            rows = encoder(model).spans_of([t or "" for t in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), *(pa.array([r[i].tolist() for r in rows], pa.list_(pa.int32() if not i else pa.int64())) for i in range(3))],
                ["key", "ids", "starts", "ends"],
            )

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, ids array<int>, starts array<bigint>, ends array<bigint>").withColumnRenamed("key", key)


def listed(ids: list[int], most: int = 1 << 20) -> str:
    """The digest of decimal ids joined by commas, from parts of bounded size."""
    found = hashlib.sha256()
    for at in range(0, len(ids), most):
        found.update((b"," if at else b"") + str(ids[at : at + most])[1:-1].replace(" ", "").encode())
    return found.hexdigest()


def encode_digests(docs: DataFrame, model: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """For each row its key, number of ids, digests of the ids and of the text decoded from them, and of the pieces' spans.

    The spans' digest is that of the starts and the last end, as little-endian 64-bit integers.
    """

    def run(batches):
        tool = encoder(model)
        for batch in slices(batches, 1 << 20):
            rows = tool.spans_of([t or "" for t in batch.column("text").to_pylist()])
            lists = [ids.tolist() for ids, _, _ in rows]
            decoded = tool.model.decode(lists, num_threads=1) if lists else []
            numbers = [listed(ids) for ids in lists]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("key"),
                    pa.array([len(ids) for ids in lists], pa.int64()),
                    pa.array(numbers),
                    pa.array([hashlib.sha256(d.encode()).hexdigest() for d in decoded]),
                    pa.array([hashlib.sha256(np.r_[starts, ends[-1:]].astype("<i8").tobytes()).hexdigest() for _, starts, ends in rows]),
                ],
                ["key", "n_tokens", "ids_sha256", "decoded_sha256", "spans_sha256"],
            )

    kind = docs.schema[key].dataType.simpleString()
    found = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string, spans_sha256 string")
    return found.withColumnRenamed("key", key)
