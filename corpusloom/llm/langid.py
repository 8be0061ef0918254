"""Language identification by a byte convolutional network.

Windows of fixed length cover every text whole. Bytes are embedded, filters of several widths run
over them, each filter's greatest response in the window is kept, and a softmax layer names the
language. A text's windows are averaged, weighed by their bytes. The network is trained in numpy
on a bounded sample of labelled texts (``Fit.rows``).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.session import id_fold, small
from corpusloom.llm.wordkernel import utf8
from corpusloom.sources.tables import table

UNKNOWN = "und"


@dataclass(frozen=True)
class Fit:
    """rows: most texts to learn from, all their windows.
    epochs, steps: training passes, more of them where a small sample would give fewer steps."""

    rows: int = 1200
    width: int = 192
    kernels: tuple[int, ...] = (2, 3, 4)
    filters: int = 16
    embed: int = 8
    epochs: int = 6
    steps: int = 600
    batch: int = 64
    rate: float = 0.01
    seed: int = 11


def windows(data: np.ndarray, offsets: np.ndarray, fit: Fit) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, row) of windows that cover each row; neighbours share the widest filter's reach."""
    step = fit.width - max(fit.kernels) + 1
    size = np.diff(offsets)
    n = np.maximum(1, -(-(size - (fit.width - step)) // step))
    row = np.repeat(np.arange(len(size)), n)
    k = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    starts = offsets[row] + k * step
    return starts, np.minimum(starts + fit.width, offsets[row + 1]), row


def window_bytes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fit: Fit) -> np.ndarray:
    """Bytes of each window, padded with 0 so that every filter fits at every place."""
    at = starts[:, None] + np.arange(fit.width + max(fit.kernels) - 1)
    inside = at < ends[:, None]
    padded = data if len(data) else np.zeros(1, np.uint8)
    return np.where(inside, padded[np.minimum(at, len(padded) - 1)], 0)


@dataclass
class Network:
    fit: Fit
    langs: list[str]
    embed: np.ndarray
    conv: np.ndarray
    bias: np.ndarray
    dense: np.ndarray
    out_bias: np.ndarray

    def columns(self, window: np.ndarray) -> np.ndarray:
        reach, width = max(self.fit.kernels), self.fit.width
        e = self.embed[window]
        return np.concatenate([e[:, j : j + width] for j in range(reach)], 2).reshape(len(window) * width, -1)

    def pooled(self, window: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each filter's greatest response and its place."""
        r = (self.columns(window) @ self.conv).reshape(len(window), self.fit.width, -1)
        at = r.argmax(1)
        return np.maximum(np.take_along_axis(r, at[:, None], 1)[:, 0] + self.bias, 0), at

    def logits(self, window: np.ndarray) -> np.ndarray:
        r = (self.columns(window) @ self.conv).reshape(len(window), self.fit.width, -1).max(1)
        return np.maximum(r + self.bias, 0) @ self.dense + self.out_bias


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def train(window: np.ndarray, y: np.ndarray, langs: list[str], fit: Fit) -> Network:
    """Adam on the cross entropy; the gradient of a pooled filter reaches only its best place."""
    rng = np.random.Generator(np.random.PCG64(fit.seed))
    reach, total = max(fit.kernels), fit.filters * len(fit.kernels)
    mask = np.zeros((reach, fit.embed, total), np.float32)
    for k, width in enumerate(fit.kernels):
        mask[:width, :, k * fit.filters : (k + 1) * fit.filters] = 1
    mask = mask.reshape(reach * fit.embed, total)
    p = [
        rng.normal(0, 0.5, (256, fit.embed)), rng.normal(0, 0.3, mask.shape) * mask, np.zeros(total),
        rng.normal(0, 0.2, (total, len(langs))), np.zeros(len(langs)),
    ]
    p = [x.astype(np.float32) for x in p]
    net = Network(fit, langs, *p)
    m, s, step = [np.zeros_like(x) for x in p], [np.zeros_like(x) for x in p], 0
    for _ in range(max(fit.epochs, -(-fit.steps * fit.batch // len(window)))):
        order = rng.permutation(len(window))
        for k in range(0, len(order), fit.batch):
            part = order[k : k + fit.batch]
            w = window[part]
            h, at = net.pooled(w)
            d = softmax(h @ net.dense + net.out_bias)
            d[np.arange(len(part)), y[part]] -= 1
            d /= len(part)
            dh = (d @ net.dense.T) * (h > 0)
            best = w[np.arange(len(part))[:, None, None], at[:, :, None] + np.arange(reach)]
            seen = net.embed[best].reshape(len(part), total, -1)
            g_conv = np.einsum("nf,nfc->cf", dh, seen) * mask
            back = (dh[:, :, None] * net.conv.T[None]).reshape(-1, fit.embed)
            g_embed = np.stack([np.bincount(best.ravel(), back[:, c], 256) for c in range(fit.embed)], 1)
            step += 1
            for i, g in enumerate([g_embed, g_conv, dh.sum(0), h.T @ d, d.sum(0)]):
                m[i] = 0.9 * m[i] + 0.1 * g
                s[i] = 0.999 * s[i] + 0.001 * g**2
                p[i] -= (fit.rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(s[i] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return net


def learn(docs: DataFrame, fit: Fit = Fit(), folds: int = 4, held: int = 2) -> Network | None:
    """Train from text and lang of rows outside fold ``held``; None if there are no such rows.

    At most ``fit.rows`` ids are chosen by hash; of rows that share a chosen id one is taken, that whose text has the least
    hash. Null texts and rows in another language than the least of their id are left out.
    """
    chosen = (
        docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull()).where(id_fold("doc_id", folds) != held)
        .groupBy("doc_id").agg(F.min("lang").alias("_lang"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit.rows)
    )
    sample = docs.where(F.col("lang").isNotNull()).join(F.broadcast(chosen), "doc_id").where("text is not null and lang = _lang")
    sample = sample.groupBy("doc_id", "lang").agg(F.min_by("text", F.xxhash64("text")).alias("text"))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(parts):
            data, offsets = utf8(batch.column("_low"))
            starts, ends, row = windows(data, offsets, fit)
            pick = np.arange(len(row))
            got = window_bytes(data, starts[pick], ends[pick], fit).astype(np.uint8)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(row[pick])), batch.column("lang").take(pa.array(row[pick])), pa.array([x.tobytes() for x in got], pa.binary())],
                ["doc_id", "lang", "window"],
            )

    rows = sample.select("doc_id", "lang", F.lower("text").alias("_low")).mapInArrow(run, "doc_id long, lang string, window binary")
    got = sorted(zip(*(c.to_pylist() for c in rows.toArrow().columns)))  # all windows of at most fit.rows texts, one an id
    if not got:
        return None
    langs = sorted({x[1] for x in got})
    window = np.stack([np.frombuffer(x[2], np.uint8) for x in got])
    return train(window, np.array([langs.index(x[1]) for x in got]), langs, fit)


def predict(docs: DataFrame, net: Network | None) -> DataFrame:
    """doc_id, lang_pred and score (0 to 1) of each row of ``docs`` (doc_id, text).

    Null texts and texts without a letter get ``und`` and score 0, as does everything without a
    network. Whole texts of any length count; an empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.lower("text").alias("_low"), F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("_letter"))
    if net is None:
        return rows.select("doc_id", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    held = spark.sparkContext.broadcast(net)  # tens of KB

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for batch in small(parts):
            data, offsets = utf8(batch.column("_low"))
            starts, ends, row = windows(data, offsets, model.fit)
            total, size = np.zeros((len(batch), len(model.langs))), np.maximum(ends - starts, 1)
            for k in range(0, len(row), 128):
                part = slice(k, k + 128)
                x = model.logits(window_bytes(data, starts[part], ends[part], model.fit)) * size[part, None]
                np.add.at(total, row[part], x)
            p = softmax(total / np.bincount(row, size, len(batch))[:, None])
            letter = batch.column("_letter").to_numpy(zero_copy_only=False).astype(bool)
            names = [model.langs[i] if ok else UNKNOWN for i, ok in zip(p.argmax(1).tolist(), letter.tolist())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names, pa.string()), pa.array(np.where(letter, p.max(1), 0.0))], ["doc_id", "lang_pred", "score"])

    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language, learnt from rows outside the fold crc32(doc_id) mod 4 = 2."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    told = predict(docs, learn(docs))
    return told.select("doc_id", F.coalesce(id_fold("doc_id", 4) == 2, F.lit(True)).alias("held_out"), "lang_pred", "score")
