"""Quality rules by line sequence labelling.

Each line of a text is content or boilerplate. A linear-chain conditional random field scores
line features and the step from one label to the next; Viterbi decoding labels the lines, and the
share of words in content lines decides whether the text stays. The field is trained in numpy, on
a bounded sample of labelled texts: lines of good texts count as content, except copies of an
earlier line, and lines of bad texts as boilerplate; what both have, the field weighs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.session import labelled_sample, small
from corpusloom.llm.wordkernel import BYTE_CODE, SPACE, chain, pieces, row_of, runs, span_hash, utf8
from corpusloom.sources.tables import table

CONTENT, BOILERPLATE = 1, 0
SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
FEATURES = 19


@dataclass(frozen=True)
class Fit:
    """rows: most labelled texts to learn from, all their lines. share: least part of words in content lines.
    step_decay: keeps the steps weak, as the sample's texts are mostly of one label."""

    rows: int = 2000
    epochs: int = 100
    rate: float = 0.05
    decay: float = 1e-3
    step_decay: float = 0.1
    share: float = 0.5


@dataclass
class Scan:
    """Counts of each row, and the lines of all rows one after another with n+1 offsets."""

    words: np.ndarray
    word_chars: np.ndarray
    symbols: np.ndarray
    dup_lines: np.ndarray
    repeat_words: np.ndarray
    line_at: np.ndarray
    line_words: np.ndarray
    features: np.ndarray


def scan(data: np.ndarray, offsets: np.ndarray) -> Scan:
    """All counts of a run of rows by passes over their bytes."""
    n = len(offsets) - 1

    def upto(flag: np.ndarray) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(flag)])

    def between(total: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return total[b] - total[a]

    solid = ~SPACE[data]
    starts, ends = runs(solid, offsets)
    owner = row_of(starts, offsets)
    words = np.bincount(owner, minlength=n)
    chars = upto(solid & ((data & 0xC0) != 0x80))
    signs = upto(SYMBOLS[data])
    code = BYTE_CODE[data]
    word = span_hash(code, starts, ends)

    # words of 3-word windows that a row has twice or more
    covered = np.zeros(len(word), bool)
    if len(word) >= 3:
        gram, own = chain(word, 3), owner[: len(word) - 2]
        inside = np.flatnonzero(own == owner[2:])
        key = gram[inside] ^ (own[inside].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        _, which, counts = np.unique(key, return_inverse=True, return_counts=True)
        again = inside[counts[which] > 1]
        for k in range(3):
            covered[again + k] = True

    # lines: every \n ends one, and every row's end
    breaks = np.flatnonzero(data == 10)
    line_row = np.concatenate([row_of(breaks, offsets), np.arange(n)])
    line_end = np.concatenate([breaks, offsets[1:]])
    order = np.lexsort((line_end, line_row))
    line_row, line_end = line_row[order], line_end[order]
    first = np.concatenate([[True], line_row[1:] != line_row[:-1]]) if len(line_row) else np.zeros(0, bool)
    line_from = np.where(first, offsets[line_row], np.concatenate([[0], line_end[:-1] + 1])[: len(line_end)])
    line_words = np.searchsorted(starts, line_end) - np.searchsorted(starts, line_from)
    line_key = span_hash(code, line_from, line_end) ^ (line_row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    worded = np.flatnonzero(line_words > 0)
    _, once = np.unique(line_key[worded], return_index=True)
    copy = np.zeros(len(line_row), bool)
    copy[worded] = True
    copy[worded[once]] = False

    size = np.maximum(line_end - line_from, 1)
    some = np.maximum(line_words, 1)

    def share(flag: np.ndarray) -> np.ndarray:
        return between(upto(flag), line_from, line_end) / size

    w0, w1 = np.searchsorted(starts, line_from), np.searchsorted(starts, line_end)
    signed = (signs[ends] > signs[starts]) if len(starts) else np.zeros(0, bool)
    upper, digit, bang = share((data >= 65) & (data <= 90)), share((data >= 48) & (data <= 57)), share(data == 33)
    symbol = between(signs, line_from, line_end) / size
    covers = between(upto(covered), w0, w1) / some
    marked = between(upto(signed), w0, w1) / some
    mean = between(chars, line_from, line_end) / some
    near = np.log1p(np.bincount(line_row, minlength=n))[line_row]
    feats = np.stack([
        np.ones(len(size)), line_words == 0, line_words < 5, line_words >= 20, copy, upper, upper > 0.3, digit, digit > 0.2, bang > 0.03,
        np.minimum(symbol * 5, 2), symbol > 0.02, marked, marked > 0.3, covers, covers > 0.3, mean / 10, mean > 12, near / 5,
    ], 1).astype(np.float64)
    per = lambda flag: np.bincount(owner, flag, n).astype(np.int64)
    return Scan(
        words.astype(np.int64), between(chars, offsets[:-1], offsets[1:]), between(signs, offsets[:-1], offsets[1:]), np.bincount(line_row, copy, n).astype(np.int64),
        per(covered), np.concatenate([[0], np.cumsum(np.bincount(line_row, minlength=n))]), line_words, feats,
    )


def _lockstep(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows by falling number of lines, and for each step how many rows still have a line."""
    length = np.diff(at)
    order = np.argsort(-length, kind="stable")
    return order, np.searchsorted(-length[order], -np.arange(length.max(initial=0)), "left")


@dataclass
class Field:
    """emit: FEATURES x 2 weights; step: weight of label i followed by label j."""

    emit: np.ndarray
    step: np.ndarray

    def viterbi(self, feats: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The best label of every line; all rows take their next line together."""
        e = feats @ self.emit
        back = np.zeros(e.shape, np.int8)
        order, alive = _lockstep(at)
        first = at[:-1][order]
        best = np.zeros((len(order), 2))
        for t, k in enumerate(alive.tolist()):
            lines = first[:k] + t
            if t == 0:
                best[:k] = e[lines]
            else:
                way = best[:k, :, None] + self.step[None]
                back[lines] = way.argmax(1)
                best[:k] = way.max(1) + e[lines]
        label = np.zeros(len(e), np.int8)
        last = np.zeros(len(order), np.int8)
        now = best.argmax(1).astype(np.int8)
        length = np.diff(at)[order]
        for t in range(len(alive) - 1, -1, -1):
            k = alive[t]
            lines = first[:k] + t
            ending = length[:k] == t + 1
            last[:k] = np.where(ending, now[:k], last[:k])
            label[lines] = last[:k]
            last[:k] = back[lines, last[:k]]
        return label

    def gradient(self, feats: np.ndarray, at: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gradient of the mean negative log likelihood of the lines' labels, by forward and backward sums."""
        e = feats @ self.emit
        order, alive = _lockstep(at)
        first, length = at[:-1][order], np.diff(at)[order]
        fwd, bwd = np.zeros_like(e), np.zeros_like(e)
        for t, k in enumerate(alive.tolist()):
            lines = first[:k] + t
            fwd[lines] = e[lines] if t == 0 else e[lines] + np.logaddexp.reduce(fwd[lines - 1][:, :, None] + self.step[None], 1)
        for t in range(len(alive) - 2, -1, -1):
            lines = (first + t)[: alive[t + 1]]
            bwd[lines] = np.logaddexp.reduce(self.step[None] + (e[lines + 1] + bwd[lines + 1])[:, None, :], 2)
        total = np.logaddexp.reduce(fwd + bwd, 1)
        p = np.exp(fwd + bwd - total[:, None])
        p[np.arange(len(y)), y] -= 1
        inner = np.ones(len(e), bool)
        inner[at[1:][np.diff(at) > 0] - 1] = False
        i = np.flatnonzero(inner)
        pair = np.exp(fwd[i][:, :, None] + self.step[None] + (e[i + 1] + bwd[i + 1])[:, None, :] - total[i][:, None, None])
        g = pair.sum(0)
        np.subtract.at(g, (y[i], y[i + 1]), 1)
        return feats.T @ p / len(y), g / len(y)


def train(feats: np.ndarray, at: np.ndarray, y: np.ndarray, fit: Fit) -> Field:
    field = Field(np.zeros((FEATURES, 2)), np.zeros((2, 2)))
    p = [field.emit, field.step]
    m, s = [np.zeros_like(x) for x in p], [np.zeros_like(x) for x in p]
    for t in range(1, fit.epochs + 1):
        for i, g in enumerate(field.gradient(feats, at, y)):
            g = g + (fit.decay if i == 0 else fit.step_decay) * p[i]
            m[i] = 0.9 * m[i] + 0.1 * g
            s[i] = 0.99 * s[i] + 0.01 * g**2
            p[i] -= fit.rate * 3 * (m[i] / (1 - 0.9**t)) / (np.sqrt(s[i] / (1 - 0.99**t)) + 1e-8)
    return field


def learn(docs: DataFrame, labels: DataFrame, fit: Fit = Fit(), folds: int = 1, held: int = -1) -> Field | None:
    """Train from labelled texts, see the module; None where there are none, then every line is content.

    A fold of the ids can be held out to measure the verdicts there.
    """
    sample = labelled_sample(docs.select("doc_id", "text"), labels, "quality", folds, held, fit.rows)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(parts):
            data, offsets = utf8(batch.column("text"))
            good = batch.column("_label").to_pylist()
            for i, j in pieces(offsets):
                got = scan(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                out = []
                for r, (a, b) in enumerate(zip(got.line_at[:-1], got.line_at[1:])):
                    f = got.features[a:b]
                    y = np.where(f[:, 4] > 0, BOILERPLATE, CONTENT if good[i + r] else BOILERPLATE)
                    out.append({"doc_id": batch.column("doc_id")[i + r].as_py(), "y": y.astype(np.int8).tobytes(), "f": f.tobytes()})
                yield pa.RecordBatch.from_pylist(out, pa.schema([("doc_id", pa.int64()), ("y", pa.binary()), ("f", pa.binary())]))

    rows = sample.select("doc_id", "text", "_label").mapInArrow(run, "doc_id long, y binary, f binary").collect()  # at most fit.rows
    rows = sorted(map(tuple, rows))
    if not rows:
        return None
    y = [np.frombuffer(r[1], np.int8) for r in rows]
    at = np.concatenate([[0], np.cumsum([len(x) for x in y])])
    return train(np.concatenate([np.frombuffer(r[2]).reshape(-1, FEATURES) for r in rows]), at, np.concatenate(y).astype(int), fit)


OUT = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, content_words long"


def judge(docs: DataFrame, field: Field | None, fit: Fit = Fit()) -> DataFrame:
    """Counts and verdict of each row of ``docs`` (doc_id, text), see ``OUT``.

    Texts are read whole. A null text has no words and fails, as does an empty one. Equal rows stay
    rows of their own; an empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(field)  # about forty numbers

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(parts):
            data, offsets = utf8(batch.column("text"))
            for i, j in pieces(offsets):
                got = scan(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                label = np.ones(len(got.line_words), np.int8) if held.value is None else held.value.viterbi(got.features, got.line_at)
                good = np.concatenate([[0], np.cumsum(got.line_words * (label == CONTENT))])
                content = good[got.line_at[1:]] - good[got.line_at[:-1]]
                failed = (got.words < 50) | (100 * got.repeat_words > 50 * got.words)
                kept = ~failed & (content >= fit.share * got.words)
                cols = [got.words, got.word_chars, got.symbols, got.dup_lines, got.repeat_words, failed, kept, content.astype(np.int64)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), *map(pa.array, cols)], [x.split()[0] for x in OUT.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(run, OUT)


def op9_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's counts, base rules and the verdict of its labelled lines."""
    docs = table(spark, sf_dir, "documents")
    return judge(docs, learn(docs, table(spark, sf_dir, "labels")))
