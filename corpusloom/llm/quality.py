"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

Low-rank factors give every pair of features an interaction. The sum-of-squares identity
``sum_{i<j} <v_i, v_j> x_i x_j = (|sum v_i x_i|^2 - sum |v_i x_i|^2) / 2`` scores a text in time
linear in its words. The machine is trained on the driver from a bounded labelled sample
(``Fit.rows``) whose features the executors compute; its size does not depend on the data.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.session import id_fold, labelled_sample, small
from corpusloom.llm.wordkernel import BYTE_CODE, LOWER, SPACE, pieces, row_of, runs, span_hash, utf8
from corpusloom.sources.tables import table


@dataclass(frozen=True)
class Fit:
    """rows: most labelled rows to learn from. buckets: hashed words. rank: factors of a feature."""

    rows: int = 4000
    buckets: int = 1 << 15
    rank: int = 8
    epochs: int = 30
    batch: int = 64
    rate: float = 0.02
    decay: float = 1e-3
    seed: int = 7


STATS = ("empty", "log_words", "log_lines", "upper", "digit", "symbol", "punct", "wide", "word_len", "distinct", "same_line", "symbol_words")


def _ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a / np.maximum(b, 1)


def features(data: np.ndarray, offsets: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket, weight of each distinct hashed word of a row; rows x STATS). Weights of a row have norm 1."""
    n, low = len(offsets) - 1, LOWER[data]
    starts, ends = runs(~SPACE[data], offsets)
    owner = row_of(starts, offsets)
    bare = ((low >= 97) & (low <= 122)) | (data >= 128)
    word = span_hash(np.where(bare, BYTE_CODE[low], np.uint64(0)), starts, ends)
    mark = span_hash(np.where(bare, np.uint64(0), BYTE_CODE[low]), starts, ends)
    key = np.concatenate([owner, owner]).astype(np.int64) * buckets + (np.concatenate([word, mark]) % np.uint64(buckets)).astype(np.int64)
    key, counts = np.unique(key, return_counts=True)
    row, bucket = key // buckets, key % buckets
    weight = np.log1p(counts)
    weight = weight / np.sqrt(np.bincount(row, weight**2, n))[row]

    def per_row(flag: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flag)])
        return (total[offsets[1:]] - total[offsets[:-1]]).astype(float)

    size = np.diff(offsets).astype(float)
    words = np.bincount(owner, minlength=n).astype(float)
    sign = np.isin(data, np.frombuffer(b"#*$%&|<>", np.uint8))
    signs = np.concatenate([[0], np.cumsum(sign)])
    line_from, line_to = runs(data != 10, offsets)
    line_row = row_of(line_from, offsets)
    line_key = span_hash(BYTE_CODE[data], line_from, line_to) ^ (line_row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, once = np.unique(line_key, return_index=True)
    lines = np.bincount(line_row, minlength=n).astype(float)
    stats = np.stack([
        (words == 0).astype(float), np.log1p(words), np.log1p(lines),
        _ratio(per_row((data >= 65) & (data <= 90)), size), _ratio(per_row((data >= 48) & (data <= 57)), size), _ratio(per_row(sign), size),
        _ratio(per_row((data > 32) & (data < 127) & ~bare & ~sign), size), _ratio(per_row(data >= 128), size),
        _ratio(per_row(~SPACE[data]), words), _ratio(np.bincount(row, minlength=n).astype(float), 2 * words),
        1 - _ratio(np.bincount(line_row[once], minlength=n).astype(float), np.maximum(lines, 1)) * (lines > 0) - (lines == 0),
        _ratio(np.bincount(owner, signs[ends] > signs[starts], n), words),
    ], 1)
    return row, bucket, weight, stats


@dataclass
class Machine:
    """bias, weights and factors; the first ``buckets`` features are words, the others statistics and metadata."""

    buckets: int
    bias: float
    weights: np.ndarray
    factors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def logits(self, row: np.ndarray, bucket: np.ndarray, weight: np.ndarray, dense: np.ndarray) -> np.ndarray:
        n = len(dense)
        z = np.clip((dense - self.mean) / self.scale, -4, 4) / np.sqrt(dense.shape[1])
        w, v = self.weights, self.factors
        linear = np.bincount(row, w[bucket] * weight, n) + z @ w[self.buckets :]
        vz = v[self.buckets :]
        squares = z**2 @ (vz**2)
        total = z @ vz
        for f in range(v.shape[1]):
            own = v[bucket, f] * weight
            total[:, f] += np.bincount(row, own, n)
            squares[:, f] += np.bincount(row, own**2, n)
        return self.bias + linear + 0.5 * (total**2 - squares).sum(1)


def train(rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]], y: np.ndarray, fit: Fit) -> Machine:
    """Adam on the logistic loss. ``rows`` holds (buckets, weights, dense) of each text."""
    dims = len(rows[0][2]) if rows else len(STATS)
    rng = np.random.Generator(np.random.PCG64(fit.seed))
    size = fit.buckets + dims
    if not rows:
        return Machine(fit.buckets, 0.0, np.zeros(size), np.zeros((size, fit.rank)), np.zeros(dims), np.ones(dims))
    dense = np.stack([r[2] for r in rows])
    mean, scale = dense.mean(0), np.maximum(dense.std(0), 1e-3)
    z = np.clip((dense - mean) / scale, -4, 4) / np.sqrt(dims)
    rate = np.clip(y.mean(), 0.01, 0.99)
    theta = np.concatenate([np.zeros((size, 1)), rng.normal(0, 0.05, (size, fit.rank))], 1)
    bias, bias_m, bias_v = float(np.log(rate / (1 - rate))), 0.0, 0.0
    m, s, step = np.zeros_like(theta), np.zeros_like(theta), 0
    for _ in range(fit.epochs):
        order = rng.permutation(len(rows))
        for k in range(0, len(order), fit.batch):
            part = order[k : k + fit.batch]
            at = np.concatenate([np.concatenate([rows[i][0], np.arange(fit.buckets, size)]) for i in part])
            x = np.concatenate([np.concatenate([rows[i][1], z[i]]) for i in part])
            owner = np.repeat(np.arange(len(part)), [len(rows[i][0]) + dims for i in part])
            first = np.searchsorted(owner, np.arange(len(part)))
            used, local = np.unique(at, return_inverse=True)
            th = theta[at]
            vx = th[:, 1:] * x[:, None]
            total = np.add.reduceat(vx, first)
            out = bias + np.add.reduceat(th[:, 0] * x, first) + 0.5 * (total**2 - np.add.reduceat(vx**2, first)).sum(1)
            err = (1 / (1 + np.exp(-np.clip(out, -30, 30))) - y[part]) / len(part)
            g = np.empty_like(th)
            g[:, 0] = err[owner] * x
            g[:, 1:] = (err[owner] * x)[:, None] * (total[owner] - vx)
            grad = np.stack([np.bincount(local, g[:, c], len(used)) for c in range(g.shape[1])], 1) + fit.decay * theta[used] / len(part)
            step += 1
            m[used] = 0.9 * m[used] + 0.1 * grad
            s[used] = 0.999 * s[used] + 0.001 * grad**2
            theta[used] -= fit.rate * (m[used] / (1 - 0.9**step)) / (np.sqrt(s[used] / (1 - 0.999**step)) + 1e-8)
            bias_m, bias_v = 0.9 * bias_m + 0.1 * err.sum(), 0.999 * bias_v + 0.001 * err.sum() ** 2
            bias -= fit.rate * (bias_m / (1 - 0.9**step)) / (np.sqrt(bias_v / (1 - 0.999**step)) + 1e-8)
    return Machine(fit.buckets, bias, theta[:, 0].copy(), theta[:, 1:].copy(), mean, scale)


def _metadata(batch: pa.RecordBatch, names: tuple[str, ...]) -> np.ndarray:
    """Numeric metadata columns; null and non-finite values count as 0."""
    if not names:
        return np.zeros((len(batch), 0))
    cols = [batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in names]
    return np.nan_to_num(np.stack(cols, 1), posinf=0.0, neginf=0.0)


def learn(docs: DataFrame, labels: DataFrame, fit: Fit = Fit(), metadata: tuple[str, ...] = (), folds: int = 3, held: int = 1) -> Machine:
    """Train from the labelled rows outside fold ``held``; without any, every score is 0.5."""
    sample = labelled_sample(docs.select("doc_id", "text", *metadata), labels, "quality", folds, held, fit.rows)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(parts):
            data, offsets = utf8(batch.column("text"))
            meta = _metadata(batch, metadata)
            for i, j in pieces(offsets):
                row, bucket, weight, stats = features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], fit.buckets)
                edge = np.searchsorted(row, np.arange(j - i + 1))
                dense = np.concatenate([stats, meta[i:j]], 1)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": batch.column("doc_id").slice(i, j - i), "y": batch.column("_label").slice(i, j - i),
                    "at": pa.ListArray.from_arrays(edge.astype(np.int32), pa.array(bucket.astype(np.int32))),
                    "x": pa.ListArray.from_arrays(edge.astype(np.int32), pa.array(weight.astype(np.float32))),
                    "dense": pa.array(list(dense), pa.list_(pa.float64())),
                })

    got = sample.select("doc_id", "text", "_label", *metadata).mapInArrow(run, "doc_id long, y int, at array<int>, x array<float>, dense array<double>")
    got = got.toArrow().sort_by([("doc_id", "ascending"), ("y", "ascending")])  # at most fit.rows documents
    rows = [(np.array(a, np.int64), np.array(x), np.array(d)) for a, x, d in zip(got["at"].to_pylist(), got["x"].to_pylist(), got["dense"].to_pylist())]
    return train(rows, np.array(got["y"].to_pylist(), float), fit)


def score(docs: DataFrame, machine: Machine, metadata: tuple[str, ...] = (), keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` of each row of ``docs`` with score (0 to 1) and predicted (1 from 0.5 on).

    Whole texts of any length are scored; null counts as empty and has a score too. Equal rows get
    equal scores; an empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(machine)  # a few MB, set by Fit alone

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for batch in small(parts):
            data, offsets = utf8(batch.column(batch.num_columns - 1))
            meta, out = _metadata(batch, metadata), np.zeros(len(batch))
            for i, j in pieces(offsets):
                row, bucket, weight, stats = features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], model.buckets)
                out[i:j] = model.logits(row, bucket, weight, np.concatenate([stats, meta[i:j]], 1))
            p = 1 / (1 + np.exp(-np.clip(out, -30, 30)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], [*keep, "score", "predicted"])

    rows = docs.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*keep, *metadata])], F.col("text").alias("_scored"))
    shape = T.StructType([*(docs.schema[c] for c in keep), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return rows.mapInArrow(run, shape)


def op5_quality_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality score, learnt from labels outside the fold crc32(doc_id) mod 3 = 1."""
    docs, meta = table(spark, sf_dir, "documents"), ("n_chars",)
    scored = score(docs, learn(docs, table(spark, sf_dir, "labels"), metadata=meta), metadata=meta)
    return scored.select("doc_id", F.coalesce(id_fold("doc_id", 3) == 1, F.lit(True)).alias("held_out"), "score", "predicted")
