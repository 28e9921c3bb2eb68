"""Language identification by a byte convolutional network, trained in numpy.

Bytes (ASCII letters in lower case) are embedded, filters of several widths run over
windows of WINDOW bytes, each filter's greatest value over the window goes through a
rectifier, and a linear layer with softmax gives the languages. A text is cut into
windows that overlap by the widest filter less one, so every byte of every text is read;
the window probabilities, weighted by the windows' bytes, are averaged.

The network is fitted on labelled text of documents whose crc32(doc_id) mod 5 is not 0:
a bounded sample, the FIT_DOCS documents with the least hashes of id, label and text (the
same for any partitioning; rows that are equal in these count once), and FIT_WINDOWS windows of each. Rows without a label, text or id are not learned from. If no row can be
learned from, every text is `und`.

Null text, empty text and text without a letter are `und` with score 0. A null doc_id
counts as held out. Repeated rows get equal results; other columns are ignored, and
``accepted`` passes them on. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cleanloom.llm._common import row_of, slices

WINDOW = 256
WIDTHS = (3, 4, 5)
FILTERS = 16
EMBED = 8
#: Bounds of the fitting sample: documents, and windows of each.
FIT_DOCS = 6000
FIT_WINDOWS = 2
EPOCHS = 8
BATCH = 64
RATE = 0.01
UNKNOWN = "und"
#: The pipeline keeps documents with at least this score.
LEAST_SCORE = 0.4

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_WIDE = max(WIDTHS)
_STEP = WINDOW - _WIDE + 1


@dataclass
class Network:
    """Weights: byte embedding, filters (bytes x embedding, filter), biases, linear layer."""

    langs: list[str]
    embed: np.ndarray
    conv: np.ndarray
    conv_b: np.ndarray
    out: np.ndarray
    out_b: np.ndarray

    def columns(self, windows: np.ndarray) -> np.ndarray:
        """(windows x positions, width x embedding): what each filter sees at each position."""
        n = len(windows)
        x = np.zeros((n, WINDOW + _WIDE - 1, EMBED), np.float32)
        x[:, :WINDOW] = self.embed[windows]
        step = x.strides
        seen = np.lib.stride_tricks.as_strided(x, (n, WINDOW, _WIDE * EMBED), (step[0], step[1], step[2]))
        return np.ascontiguousarray(seen).reshape(n * WINDOW, -1)

    def pooled(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        seen = self.columns(windows)
        return seen, (seen @ self.conv).reshape(len(windows), WINDOW, -1)

    def head(self, peak: np.ndarray) -> np.ndarray:
        z = np.maximum(peak + self.conv_b, 0) @ self.out + self.out_b
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    def predict(self, windows: np.ndarray) -> np.ndarray:
        parts = [self.head(self.pooled(windows[at : at + BATCH])[1].max(1)) for at in range(0, len(windows), BATCH)]
        return np.concatenate(parts)


def _mask() -> np.ndarray:
    """A filter of width w sees the first w bytes only."""
    m = np.zeros((_WIDE, EMBED, len(WIDTHS) * FILTERS), np.float32)
    for k, w in enumerate(WIDTHS):
        m[:w, :, k * FILTERS : (k + 1) * FILTERS] = 1
    return m.reshape(_WIDE * EMBED, -1)


def fit(windows: np.ndarray, labels: np.ndarray, langs: list[str], seed: int = 7) -> Network:
    """Train by Adam on (windows, WINDOW) bytes and label indices; classes weigh by the root of their size."""
    rng, mask, c = np.random.default_rng(seed), _mask(), len(langs)
    net = Network(
        langs,
        rng.normal(0, 0.5, (256, EMBED)).astype(np.float32),
        (rng.normal(0, 0.3, mask.shape) * mask).astype(np.float32),
        np.zeros(mask.shape[1], np.float32),
        rng.normal(0, 0.2, (mask.shape[1], c)).astype(np.float32),
        np.zeros(c, np.float32),
    )
    net.embed[0] = 0
    share = np.bincount(labels, minlength=c) / max(1, len(labels))
    weight = (1 / np.sqrt(np.maximum(share, 1e-6)))[labels].astype(np.float32)
    weight /= weight.mean()
    params = [net.embed, net.conv, net.conv_b, net.out, net.out_b]
    m, v, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(windows))
        for at in range(0, len(order), BATCH):
            take = order[at : at + BATCH]
            x = windows[take]
            seen, value = net.pooled(x)
            where = value.argmax(1)
            n, f = where.shape
            peak = np.take_along_axis(value, where[:, None], 1)[:, 0] + net.conv_b
            prob = net.head(peak - net.conv_b)
            dz = prob.copy()
            dz[np.arange(n), labels[take]] -= 1
            dz *= weight[take, None] / n
            hidden = np.maximum(peak, 0)
            dh = (dz @ net.out.T) * (peak > 0)
            rows = seen.reshape(n, WINDOW, -1)[np.arange(n)[:, None], where]  # what each filter's peak saw
            d_conv = np.einsum("nf,nfk->kf", dh, rows) * mask
            d_seen = (dh[:, :, None] * net.conv.T[None]).reshape(n, f, _WIDE, EMBED)
            spot = where[:, :, None] + np.arange(_WIDE)
            byte = np.where(spot < WINDOW, np.take_along_axis(x[:, None, :].repeat(f, 1), np.minimum(spot, WINDOW - 1), 2), 0)
            d_embed = np.zeros_like(net.embed)
            np.add.at(d_embed, byte.reshape(-1), d_seen.reshape(-1, EMBED))
            d_embed[0] = 0
            t += 1
            rate = RATE * (1 - epoch / EPOCHS)
            for k, g in enumerate((d_embed, d_conv, dh.sum(0), hidden.T @ dz, dz.sum(0))):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                params[k] -= rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-7)
    return net


def cut_windows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of all texts as rows of WINDOW bytes (0 past the end), the text of each, its bytes."""
    sizes = np.array([len(t) for t in texts], np.int64)
    n = np.maximum(1, -(-(sizes - _WIDE + 1) // _STEP))
    of = np.repeat(np.arange(len(texts)), n)
    inside = (np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)) * _STEP
    flat = np.frombuffer(b"".join(texts) + bytes(WINDOW), np.uint8)
    starts = np.repeat(np.cumsum(sizes) - sizes, n) + inside
    left = np.clip(sizes[of] - inside, 0, WINDOW)
    spot = np.arange(WINDOW)
    at = np.minimum(starts[:, None] + spot, len(flat) - 1)
    return np.where(spot < left[:, None], _FOLD[flat[at]], 0).astype(np.uint8), of, left


def has_letter(text: bytes) -> bool:
    return any(65 <= x <= 90 or 97 <= x <= 122 for x in text[:64]) or any(c.isalpha() for c in text.decode(errors="replace"))


def classify(net: Network | None, texts: list[bytes | None]) -> tuple[list[str], list[float]]:
    """Language and score of each text; texts are grouped so that windows in memory stay few."""
    langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
    todo = [k for k, t in enumerate(texts) if net and t and has_letter(t)]
    group: list[int] = []
    size = 0
    for k in [*todo, -1]:
        if group and (k < 0 or size + len(texts[k]) > 1 << 20):
            windows, of, left = cut_windows([texts[g] for g in group])
            total = np.zeros((len(group), len(net.langs)))
            for at in range(0, len(windows), 4096):
                part = slice(at, at + 4096)
                np.add.at(total, of[part], net.predict(windows[part]) * left[part, None])
            total /= total.sum(1, keepdims=True)
            for g, p in zip(group, total, strict=True):
                langs[g], scores[g] = net.langs[int(p.argmax())], float(min(1.0, p.max()))
            group, size = [], 0
        if k >= 0:
            group.append(k)
            size += len(texts[k])
    return langs, scores


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[tuple[str, bytes]] = []
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary()).to_pylist(), strict=True):
            if has_letter(text):
                windows = cut_windows([text])[0]
                few = np.unique(np.linspace(0, len(windows) - 1, FIT_WINDOWS).astype(int))
                out += [(lang, windows[k].tobytes()) for k in few]
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.binary())], ["lang", "w"])


def held_out(doc_id: str = "doc_id") -> F.Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(True))


def train(docs: DataFrame, most: int = FIT_DOCS) -> Network | None:
    """Fit on the labelled documents among the ``most`` with the least hashes of id, label and text, held-out ones left out; equal rows count once."""
    labelled = docs.where(~held_out() & F.col("lang").isNotNull()).select("doc_id", "lang", "text")
    n = labelled.count()
    if not n:
        return None
    grain = 1 << 40
    placed = labelled.select(F.pmod(F.xxhash64("doc_id", "lang", "text", F.lit("fit")), F.lit(grain)).alias("place"), "lang", "text")
    # a bound that leaves some more than ``most``; where rows repeat, fewer, so it is raised until there are enough
    bound = min(grain, grain * (most + 6 * math.isqrt(most) + 10) // n)
    while len(places := [r.place for r in placed.where(F.col("place") < bound).select("place").distinct().collect()]) < most and bound < grain:
        bound = min(grain, 8 * bound)
    cut = sorted(places)[:most][-1]
    once = placed.where(F.col("place") <= cut).groupBy("place").agg(F.first("lang").alias("lang"), F.first("text").alias("text"))
    rows = once.where("text IS NOT NULL AND text <> ''").select("lang", "text").mapInArrow(_sampled, "lang string, w binary").toArrow()
    labels = rows.column(0).to_pylist()
    if not labels:
        return None
    windows = np.frombuffer(b"".join(rows.column(1).to_pylist()), np.uint8).reshape(-1, WINDOW)
    order = sorted(range(len(labels)), key=lambda k: (labels[k], windows[k].tobytes()))  # the same for any partitioning
    langs = sorted(set(labels))
    index = {x: k for k, x in enumerate(langs)}
    return fit(windows[order], np.array([index[labels[k]] for k in order]), langs)


def _scored(batches: Iterator[pa.RecordBatch], net: Network | None, at: int) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        langs, scores = classify(net, batch.column(0).field(at).cast(pa.large_binary()).to_pylist())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["row", "lang_pred", "score"])


def with_language(docs: DataFrame, net: Network | None) -> DataFrame:
    """(row, lang_pred, score): every row of ``docs`` with its language."""
    at = docs.columns.index("text")
    schema = T.StructType([T.StructField("row", docs.schema), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    score: Callable = lambda it: _scored(it, net, at)
    return docs.select(row_of(docs).alias("row")).mapInArrow(score, schema)


def accepted(docs: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """The documents with a known language and a score of at least ``least``, with the columns of ``docs``."""
    return with_language(docs, train(docs)).where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least)).select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scored = with_language(docs.select("doc_id", "text"), train(docs))
    return scored.select("row.doc_id", held_out("row.doc_id").alias("held_out"), "lang_pred", "score")
