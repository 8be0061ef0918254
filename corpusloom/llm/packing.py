"""Best-fit decreasing packing of token sequences.

Texts become ids, ids become pieces of at most ``most`` tokens, and pieces are put, longest first,
each into the open sequence with the least room that still holds it. Pieces of one length are alike
to that rule, so the packing needs only how many pieces each length has: a table of at most ``most``
rows. A segment tree over remaining capacities finds the tightest open sequences for a length; runs
of sequences with equal room are filled together. Pieces then find their place by their length and
their rank among the pieces of that length; ranks come from counts of each task, so nothing is
sorted or gathered.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.llm.session import small
from corpusloom.llm.tokenstore import encoder
from corpusloom.llm.wordkernel import pieces, utf8
from corpusloom.sources.tables import materialize, table

#: Bits of a rank in the key of length and rank.
RANK_BITS = 48


class CapacityTree:
    """Which remaining capacities, 1 to ``most``, have open sequences: a segment tree of flags."""

    def __init__(self, most: int):
        self.width = 1 << most.bit_length()
        self.open = [False] * (2 * self.width)

    def mark(self, room: int, is_open: bool) -> None:
        k = room + self.width
        self.open[k] = is_open
        while k > 1:
            k >>= 1
            self.open[k] = self.open[2 * k] or self.open[2 * k + 1]

    def tightest(self, length: int) -> int:
        """The least open capacity of at least ``length``, in logarithmic time; -1 if there is none."""
        k = length + self.width
        while not self.open[k]:
            while k & 1:  # a right child has nothing further right below its parent
                k >>= 1
            if k == 0:
                return -1
            k += 1
        while k < self.width:
            k = 2 * k if self.open[2 * k] else 2 * k + 1
        return k - self.width


@dataclass(frozen=True)
class Plan:
    """Runs of pieces of one length, by key of length and first rank. The i-th piece of a run lies in sequence
    ``sequence`` + i // ``each`` at ``offset`` + i % ``each`` times its length.

    A length adds at most three runs of sequences with equal room (one opened, one cut in three), and takes each run
    once; so there are at most 1.5 * most ** 2 rows, whatever the number of pieces.
    """

    key: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    each: np.ndarray
    sequences: int

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of the pieces with the given lengths and ranks."""
        key = (length << RANK_BITS) | rank
        row = np.searchsorted(self.key, key, "right") - 1
        i = key - self.key[row]
        return self.sequence[row] + i // self.each[row], self.offset[row] + i % self.each[row] * length


def best_fit(counts: dict[int, int], most: int) -> Plan:
    """The best-fit decreasing packing of ``counts`` (length to number of pieces) into sequences of ``most`` tokens."""
    tree, rooms = CapacityTree(most), defaultdict(list)  # remaining capacity to runs (first sequence, number)
    rows, used = [], 0

    def put(room: int, first: int, n: int) -> None:
        if room and n:
            if not rooms[room]:
                tree.mark(room, True)
            rooms[room].append((first, n))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            room = tree.tightest(length)
            if room < 0:
                room, runs = most, [(used, -(-left // (most // length)))]
                used += runs[0][1]
            else:
                runs = rooms.pop(room)
                tree.mark(room, False)
            each = room // length  # a sequence just filled is tighter than its neighbours: it goes on until it is full
            for first, n in runs:
                own = min(left, n * each)
                if own:
                    rows.append(((length << RANK_BITS) | rank, first, most - room, each))
                full, rest = divmod(own, each)
                put(room - each * length, first, full)
                if rest:
                    put(room - rest * length, first + full, 1)
                put(room, first + full + bool(rest), n - full - bool(rest))
                rank, left = rank + own, left - own
    table_ = np.array(sorted(rows), np.int64).reshape(-1, 4)
    return Plan(*table_.T, sequences=used)


def cut_lengths(n: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Document, piece, start and length of all pieces of documents of n tokens: only the first may be shorter than ``most``."""
    parts = np.maximum(1, -(-n // most))
    doc = np.repeat(np.arange(len(n)), parts)
    piece = np.arange(len(doc)) - np.repeat(np.cumsum(parts) - parts, parts)
    first = (n - (parts - 1) * most)[doc]
    return doc, piece, np.where(piece == 0, 0, first + (piece - 1) * most), np.where(piece == 0, first, most)


def _ranks(length: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """Rank of each piece among those of its length that the task has seen; ``seen`` is moved on."""
    order = np.argsort(length, kind="stable")
    of, begin, n = np.unique(length[order], return_index=True, return_counts=True)
    out = np.empty(len(length), np.int64)
    out[order] = np.arange(len(length)) - np.repeat(begin - seen[of], n)
    seen[of] += n
    return out


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"


def cut_pieces(docs: DataFrame, tokenizer: str, end_id: int, most: int, ids: bool = False) -> DataFrame:
    """Pieces of all ``docs`` (doc_id, text): doc_id, piece, start, length, ids_crc32, and with ``ids`` the ids themselves.

    part and nth tell a piece from all others of its length: the task, and its rank there. A null text is the end id
    alone; every row is a document of its own, also one without id. Other columns are ignored.
    """

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, part, seen = encoder(tokenizer), TaskContext.get().partitionId(), np.zeros(most + 1, np.int64)
        for batch in small(parts, "encoder"):
            doc_ids, (data, offsets) = batch.column("doc_id"), utf8(batch.column("text"))
            for i, j in pieces(offsets, 1 << 20):
                flat, at = known.encode(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                flat, at = np.insert(flat, at[1:], end_id).astype("<u4"), at + np.arange(j - i + 1)
                doc, piece, start, length = cut_lengths(np.diff(at), most)
                begin = at[doc] + start  # pieces follow one another
                raw = memoryview(flat).cast("B")
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(begin.tolist(), (begin + length).tolist())]
                own = {
                    "doc_id": doc_ids.take(pa.array(i + doc)), "piece": pa.array(piece, pa.int32()), "start": pa.array(start), "length": pa.array(length),
                    "ids_crc32": pa.array(crc, pa.int64()), "part": pa.array(np.full(len(doc), part, np.int32)), "nth": pa.array(_ranks(length, seen)),
                }
                if ids:
                    own["ids"] = pa.ListArray.from_arrays(np.append(begin, len(flat)).astype(np.int32), flat.astype(np.int32))
                yield pa.RecordBatch.from_pydict(own)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, PIECES + (", ids array<int>" if ids else ""))


def pack(docs: DataFrame, tokenizer: str, end_id: int = 0, most: int = 2048, ids: bool = True) -> DataFrame:
    """Each piece of ``docs`` (doc_id, text) with its place: ``cut_pieces`` and sequence_id, offset.

    Sequences hold at most ``most`` tokens, without gaps from 0. An empty table gives no rows; ties in length go in
    the order of tasks and rows. Only the number of pieces of each length comes to the driver (at most ``most`` rows),
    and the plan that goes to the tasks is bounded by ``most`` too, see ``Plan``.
    """
    spark = docs.sparkSession
    cut = materialize(cut_pieces(docs, tokenizer, end_id, most, ids), "packing-pieces")
    counts = cut.groupBy("part", "length").agg(F.count("*").alias("_n"))
    plan = spark.sparkContext.broadcast(best_fit({r.length: r.n for r in counts.groupBy("length").agg(F.sum("_n").alias("n")).collect()}, most))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per task at most
    base = counts.select("part", "length", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            if len(batch):
                length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "_rank"))
                sequence, offset = plan.value.place(length, rank)
                kept = [c for c in batch.schema.names if c != "_rank"]
                yield pa.RecordBatch.from_arrays([*map(batch.column, kept), pa.array(sequence), pa.array(offset)], [*kept, "sequence_id", "offset"])

    told = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * ids
    ranked = cut.join(base, ["part", "length"]).select(*told, (F.col("_before") + F.col("nth")).alias("_rank"))
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema if f.name != "_rank")
    return ranked.mapInArrow(run, f"{shape}, sequence_id long, offset long")


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, n_tokens and ids of each sequence of ``pack``; one has at most ``most`` pieces."""
    own = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("_p"))
    flat = F.flatten(F.col("_p.ids"))
    return own.select("sequence_id", F.size(flat).cast("long").alias("n_tokens"), flat.alias("ids"))


def op11_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 public byte-level ids, each document ended by id 0."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), ids=False)
