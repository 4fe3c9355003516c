"""Language identification with a byte convolutional network.

The network embeds bytes, applies filters of several widths in one product, takes each filter's
maximum over a window of fixed length and ends in a softmax. It is trained in numpy, by Adam, on
windows of a bounded sample of labelled rows: ``TRAIN_DOCS`` rows of each language, fewer where over
``TRAIN_ROWS`` rows would be taken in all, ``TRAIN_WINDOWS`` windows each; a text is predicted from the mean log-probabilities of all its windows, the last one padded.

Defined results: ``und`` with score 0 for a text that is null or has no letters, or if nothing was
learned; repeated rows are predicted alike and learned once, rows of one id that differ in text or language each, rows without id never; ties go to the language that sorts first; an empty
table gives an empty table. Language, source and id are never inputs of a prediction.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cubelark.llm.common import slices, utf8

#: Bytes of a window.
WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 10  # of each width
EMBEDDED = 8
#: The bound of the training sample: this many rows of each language, and in all, and windows of each row.
TRAIN_DOCS = 600
TRAIN_ROWS = 120_000
TRAIN_WINDOWS = 4
EPOCHS = 8
BATCH = 64
RATE = 0.01
SEED = 7
UNKNOWN = "und"
LETTER = regex.compile(r"\p{L}")
WIDEST = max(WIDTHS)


@dataclass
class Network:
    """Weights: ``embed`` (256, E), ``filters`` (E * widest, F) masked by width, ``bias``, ``out`` (F, L), ``out_bias``."""

    languages: list[str]
    embed: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    def columns(self, windows: np.ndarray) -> np.ndarray:
        """(n, WINDOW) bytes to the (n, positions, E * widest) inputs of the filters."""
        seen = sliding_window_view(self.embed[windows], WIDEST, axis=1)  # n, positions, E, widest
        return np.ascontiguousarray(seen.transpose(0, 1, 3, 2)).reshape(len(windows), WINDOW - WIDEST + 1, -1)

    def pooled(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x = self.columns(windows)
        y = x.reshape(-1, x.shape[2]) @ self.filters
        y = y.reshape(len(windows), -1, y.shape[1])
        return x, y, np.maximum(y.max(axis=1) + self.bias, 0)

    def log_softmax(self, windows: np.ndarray) -> np.ndarray:
        z = self.pooled(windows)[2] @ self.out + self.out_bias
        z -= z.max(axis=1, keepdims=True)
        return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


def windows_of(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All windows of each text, the last padded with zero bytes, and the text that each belongs to."""
    sizes = np.diff(at)
    counts = -(-sizes // WINDOW)
    owner = np.repeat(np.arange(len(sizes)), counts)
    first = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    starts = at[owner] + first * WINDOW
    place = starts[:, None] + np.arange(WINDOW)
    inside = place < at[owner + 1][:, None]
    return np.where(inside, data[np.minimum(place, max(len(data) - 1, 0))], 0).astype(np.uint8), owner


def train(windows: np.ndarray, labels: np.ndarray, languages: list[str]) -> Network:
    """Trains by Adam on windows whose labels are places in ``languages``."""
    rng = np.random.default_rng(SEED)
    wide, n = EMBEDDED * WIDEST, FILTERS * len(WIDTHS)
    mask = np.concatenate([np.repeat((np.arange(WIDEST) < w).astype(np.float32), EMBEDDED)[:, None].repeat(FILTERS, 1) for w in WIDTHS], axis=1)
    net = Network(
        languages,
        rng.normal(0, 0.5, (256, EMBEDDED)).astype(np.float32),
        (rng.normal(0, wide**-0.5, (wide, n)) * mask).astype(np.float32),
        np.zeros(n, np.float32),
        rng.normal(0, n**-0.5, (n, len(languages))).astype(np.float32),
        np.zeros(len(languages), np.float32),
    )
    weights = [net.embed, net.filters, net.bias, net.out, net.out_bias]
    first, second, step = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(windows))
        for start in range(0, len(order), BATCH):
            pick = order[start : start + BATCH]
            part, gold = windows[pick], labels[pick]
            x, y, h = net.pooled(part)
            z = h @ net.out + net.out_bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(gold)), gold] -= 1
            p /= len(gold)
            dh = (p @ net.out.T) * (h > 0)
            best = y.argmax(axis=1)  # the gradient goes through each filter's maximum alone
            seen = x[np.arange(len(part))[:, None], best]  # n, filters, wide
            d_filters = np.einsum("bf,bfw->wf", dh, seen) * mask
            back = (dh[:, :, None] * net.filters.T[None]).reshape(-1, EMBEDDED)
            bytes_ = part[np.arange(len(part))[:, None, None], best[:, :, None] + np.arange(WIDEST)]
            d_embed = np.zeros_like(net.embed)
            np.add.at(d_embed, bytes_.reshape(-1), back)
            step += 1
            rate = RATE * (1 - epoch / EPOCHS) * (1 - 0.999**step) ** 0.5 / (1 - 0.9**step)
            for w, g, a, b in zip(weights, [d_embed, d_filters, dh.sum(0), h.T @ p, p.sum(0)], first, second, strict=True):
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                w -= rate * a / (np.sqrt(b) + 1e-8)
    return net


def sample(docs: DataFrame, labelled: Column, text: str = "text", lang: str = "lang", key: str = "doc_id") -> DataFrame:
    """The bounded training sample: for each language the rows of least hash, and pieces spread over their texts."""
    wanted = labelled & F.col(key).isNotNull() & F.col(lang).isNotNull() & (F.length(text) > 0)
    rows = docs.where(wanted).select(F.col(lang).alias("lang"), F.col(key).alias("key"), F.xxhash64(F.col(key).cast("string")).alias("h"), F.xxhash64(text).alias("th"), F.length(text).alias("n"))
    # least hashes by language: a threshold first, so that no task sorts all rows of a language
    counts = rows.groupBy("lang").agg(F.count("*").alias("c"))
    languages = counts.count()
    most = max(1, min(TRAIN_DOCS, TRAIN_ROWS // max(1, languages)))
    bound = F.least(F.lit(1.0), F.lit(2.0 * most) / F.col("c")) * 2.0**64 - 2.0**63
    # a row for each language; without the hint, all rows would be shuffled by language before its size is known
    counts = F.broadcast(counts) if languages <= TRAIN_ROWS else counts
    picked = rows.join(counts, "lang").where(F.col("h").cast("double") <= bound).drop("c").distinct()
    ranked = picked.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h", "key", "th"))).where(F.col("r") <= most).drop("r")
    texts = docs.where(wanted).select(F.col(lang).alias("lang"), F.col(key).alias("key"), F.xxhash64(text).alias("th"), F.col(text).alias("text"))
    # TRAIN_ROWS short rows at most are broadcast
    found = texts.join(F.broadcast(ranked), ["lang", "key", "th"]).dropDuplicates(["lang", "key", "th"])
    pieces = F.transform(
        F.sequence(F.lit(0), F.lit(TRAIN_WINDOWS - 1)),
        lambda i: F.expr("text").substr((F.floor(F.greatest(F.col("n") - WINDOW, F.lit(0)) * i / (TRAIN_WINDOWS - 1)) + 1).cast("int"), F.lit(WINDOW)),
    )
    return found.select("lang", "h", "key", "th", F.explode(F.array_distinct(pieces)).alias("piece"))


def learn(docs: DataFrame, labelled: Column, **names: str) -> Network | None:
    """A network trained on the rows for which ``labelled`` holds; None without any."""
    rows = sorted((r["h"], r["key"], r["lang"], r["piece"]) for r in sample(docs, labelled, **names).collect())
    if not rows:
        return None
    languages = sorted({r[2] for r in rows})
    cut = [r[3].encode()[:WINDOW] for r in rows]
    windows = np.zeros((len(cut), WINDOW), np.uint8)
    for i, x in enumerate(cut):
        windows[i, : len(x)] = np.frombuffer(x, np.uint8)
    return train(windows, np.array([languages.index(r[2]) for r in rows]), languages)


def scores(net: Network | None, texts: pa.Array) -> tuple[list[str], np.ndarray]:
    """Language and score of each text."""
    n = len(texts)
    data, at = utf8(texts)
    names, found = [UNKNOWN] * n, np.zeros(n)
    letters = np.array([bool(t and LETTER.search(t)) for t in texts.to_pylist()], bool)
    if net is not None and len(data):
        windows, owner = windows_of(data, at)
        total = np.zeros((n, len(net.languages)))
        for i in range(0, len(windows), 128):
            np.add.at(total, owner[i : i + 128], net.log_softmax(windows[i : i + 128]))
        mean = total / np.maximum(np.bincount(owner, minlength=n), 1)[:, None]
        p = np.exp(mean - mean.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        best = p.argmax(axis=1)
        found = np.where(letters, p[np.arange(n), best], 0.0)
        names = [net.languages[b] if ok else UNKNOWN for b, ok in zip(best, letters, strict=True)]
    return names, found


def predict(docs: DataFrame, net: Network | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key, ``lang_pred`` and ``score`` of every whole text."""

    def run(batches):
        for batch in slices(batches, 1 << 20):
            names, found = scores(net, batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(names, pa.string()), pa.array(found)], ["key", "lang_pred", "score"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, lang_pred string, score double").withColumnRenamed("key", key)


def recognised(docs: DataFrame, net: Network | None, least: float = 0.3, text: str = "text") -> DataFrame:
    """The rows, with all their columns, whose language is known with a score of at least ``least``."""
    at = docs.columns.index(text)

    def run(batches):
        for batch in slices(batches, 1 << 20, text):
            names, found = scores(net, batch.column(at))
            yield batch.filter(pa.array([name != UNKNOWN and score >= least for name, score in zip(names, found, strict=True)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def held_out(key: str = "doc_id") -> Column:
    """Whether a row is kept out of the training: crc32 of the id as text leaves 1 when divided by 3."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1


def identify(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Trains on the rows that aren't held out and predicts all."""
    net = learn(docs, F.coalesce(~held_out(key), F.lit(False)), key=key)
    return predict(docs, net, key=key).select(key, F.coalesce(held_out(key), F.lit(False)).alias("held_out"), "lang_pred", "score")
