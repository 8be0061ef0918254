"""Byte-level BPE encoding and decoding with padded numpy matrices.

Pretokens of a batch that were not met before go into matrices by length bucket, one row each,
padded with -1. In each round every row merges its leftmost pair of least rank; pairs are looked
up in an open-addressing hash table; rows without a pair that can merge leave the matrix, and the
others close the gap (compaction). Ids decode through a table of token bytes.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.chunks import Codes, SpanTable, gathered
from corpusloom.llm.session import KEPT, forget, release
from corpusloom.llm.wordkernel import pieces, utf8
from corpusloom.sources.tables import table

#: Longer pretokens would make matrices too wide; they use one row at a time, by linked list and heap.
WIDEST = 256
NONE = np.int32(2**31 - 1)


class PairTable:
    """Open-addressing hash table from a pair of ids to the id (rank) of their merge."""

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(left)) * 2.5))))
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.vals = np.full(1 << self.bits, NONE, np.int32)
        key = (left.astype(np.int64) << 32) | right.astype(np.int64)
        todo, at = np.arange(len(key)), self._home(key)
        while len(todo):
            free = self.keys[at[todo]] < 0
            put = todo[free]
            _, first = np.unique(at[put], return_index=True)
            put = put[first]
            self.keys[at[put]], self.vals[at[put]] = key[put], merged[put]
            todo = todo[self.keys[at[todo]] != key[todo]]
            at[todo] = (at[todo] + 1) & ((1 << self.bits) - 1)

    def _home(self, key: np.ndarray) -> np.ndarray:
        h = key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return ((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - self.bits)).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair's merge; NONE where the pair has none or a side is padding."""
        key = (left.astype(np.int64) << 32) | (right.astype(np.int64) & 0xFFFFFFFF)
        key[(left < 0) | (right < 0)] = -2
        shape, key = key.shape, key.ravel()
        at, out = self._home(key), np.full(len(key), NONE, np.int32)
        todo = np.flatnonzero(key >= 0)
        while len(todo):
            found = self.keys[at[todo]]
            hit = found == key[todo]
            out[todo[hit]] = self.vals[at[todo[hit]]]
            todo = todo[~hit & (found >= 0)]
            at[todo] = (at[todo] + 1) & ((1 << self.bits) - 1)
        return out.reshape(shape)


class ByteBpe:
    """Encoder and decoder of a rank file in tiktoken's format: base64 of the bytes, then the id, on each line."""

    def __init__(self, path: str, pattern: str, most_chunks: int = 200_000):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        splits = (x for t, i in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks for x in (ranks[t[:k]], ranks[t[k:]], i))
        self.pairs = PairTable(*np.fromiter(splits, np.int32).reshape(-1, 3).T)
        size = max(ranks.values()) + 1
        tokens = [b""] * size
        for t, i in ranks.items():
            tokens[i] = t
        self.token_bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.token_at = np.concatenate([[0], np.cumsum([len(t) for t in tokens])])
        self.table = SpanTable(self._apart, self._together, most_chunks)

    @cached_property
    def joined(self) -> dict[tuple[int, int], int]:
        """The merges by pair, for very long pretokens; made when one is met."""
        used = self.pairs.vals != NONE
        key = self.pairs.keys[used]
        return dict(zip(zip((key >> 32).tolist(), (key & 0xFFFFFFFF).tolist()), self.pairs.vals[used].tolist()))

    def _apart(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        codes, rows, ends = Codes(), [], [0]
        find, code_of = self.pattern.findall, codes.__getitem__
        for c in chunks:
            rows.extend(map(code_of, find(c)))
            ends.append(len(rows))
        ids, offsets = self.pretokens([w.encode() for w in codes])
        flat, upto = gathered(ids, offsets, np.array(rows, np.int64))
        return flat, upto[np.array(ends, np.int64)]

    def _together(self, chunks: bytes, upto: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Chunks that each start a match: one search over all, cut where the matches' bytes reach a chunk's end."""
        codes = Codes()
        rows = np.array(list(map(codes.__getitem__, self.pattern.findall(chunks.decode()))), np.int64)
        words = [w.encode() for w in codes]
        reached = np.concatenate([[0], np.cumsum(np.array([len(w) for w in words], np.int64)[rows])])
        at = np.searchsorted(reached, upto)
        if not np.array_equal(reached[np.minimum(at, len(rows))], upto):
            raise ValueError("a match of the pattern crosses a chunk's border")
        ids, offsets = self.pretokens(words)
        flat, ends = gathered(ids, offsets, rows)
        return flat, ends[at]

    def pretokens(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each pretoken, its own id where the file has it, else by merges; n+1 offsets."""
        known = np.array([self.ranks.get(w, -1) for w in words], np.int64)
        length = np.array([len(w) for w in words], np.int64)
        own = np.flatnonzero(known >= 0)
        order, flats, counts = [own], [known[own]], [np.ones(len(own), np.int64)]
        open_ = np.flatnonzero(known < 0)
        bucket = np.where(length > WIDEST, -1, -(-length // 4) * 4)[open_]
        for width in np.unique(bucket).tolist():
            rows = open_[bucket == width]
            step = max(1, (1 << 18) // width) if width > 0 else 1
            for k in range(0, len(rows), step):
                part = rows[k : k + step]
                if width > 0:
                    ids, n = self._matrix([words[i] for i in part.tolist()], width)
                else:
                    ids = self._long(words[part[0]])
                    n = np.array([len(ids)])
                order.append(part)
                flats.append(ids)
                counts.append(n)
        place = np.empty(len(words), np.int64)
        place[np.concatenate(order)] = np.arange(len(words))
        at = np.concatenate([[0], np.cumsum(np.concatenate(counts))])
        return gathered(np.concatenate(flats), at, place)

    def _matrix(self, words: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
        """One bucket, a row for each word, merged in rounds: ids row after row, and counts."""
        m = np.full((len(words), width), -1, np.int32)
        n = np.array([len(w) for w in words], np.int64)
        m[np.arange(width) < n[:, None]] = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        final = np.full((len(words), width), -1, np.int32)
        rank = np.full((len(words), width), NONE, np.int32)
        rank[:, :-1] = self.pairs.ranks(m[:, :-1], m[:, 1:])
        rows = np.arange(len(words))
        while len(rows):
            at = rank.argmin(1)  # the leftmost of equal ranks
            least = rank[np.arange(len(rows)), at]
            over = least == NONE
            if over.any():
                final[rows[over], : m.shape[1]] = m[over]
                live = ~over
                rows, m, rank, n, at, least = rows[live], m[live], rank[live], n[live], at[live], least[live]
                if not len(rows):
                    break
                used = int(n.max())
                m, rank = m[:, :used], rank[:, :used]
            every, col = np.arange(len(rows)), np.arange(m.shape[1])
            m[every, at] = least
            shift = col[None, :] > at[:, None]  # close the gap behind the merge
            pad = np.full((len(rows), 1), -1, np.int32)
            m = np.where(shift, np.concatenate([m[:, 1:], pad], 1), m)
            rank = np.where(shift, np.concatenate([rank[:, 1:], np.full_like(pad, NONE)], 1), rank)
            n -= 1
            after = np.minimum(at + 1, m.shape[1] - 1)
            right = np.where(at + 1 < m.shape[1], m[every, after], -1)
            rank[every, at] = self.pairs.ranks(least, right)
            before = np.maximum(at - 1, 0)
            fresh = self.pairs.ranks(np.where(at > 0, m[every, before], -1), least)
            rank[every, before] = np.where(at > 0, fresh, rank[every, before])
        return final[final >= 0], (final >= 0).sum(1)

    def _long(self, word: bytes) -> np.ndarray:
        """A very long pretoken: the same merges in the same order, by linked list and heap."""
        import heapq

        ids = self.byte_ids[np.frombuffer(word, np.uint8)].tolist()
        n = len(ids)
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(m, i, ids[i], ids[i + 1]) for i in range(n - 1) if (m := self.joined.get((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            m, i, a, b = heapq.heappop(heap)
            j = nxt[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = m, -1
            nxt[i] = nxt[j]
            if nxt[i] < n:
                prv[nxt[i]] = i
                if (x := self.joined.get((m, ids[nxt[i]]))) is not None:
                    heapq.heappush(heap, (x, i, m, ids[nxt[i]]))
            if prv[i] >= 0 and (x := self.joined.get((ids[prv[i]], m))) is not None:
                heapq.heappush(heap, (x, prv[i], ids[prv[i]], m))
        return np.array([x for x in ids if x >= 0], np.int32)

    def encode(self, column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(ids of some texts one after another, n+1 offsets) for runs of texts of a column; null counts as empty."""
        data, offsets = utf8(column)
        for i, j in pieces(offsets, 1 << 18):
            yield self.table.encode(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])

    def decode(self, ids: np.ndarray) -> bytes:
        first = self.token_at[ids]
        sizes = self.token_at[ids + 1] - first
        upto = np.concatenate([[0], np.cumsum(sizes)])
        return self.token_bytes[np.arange(upto[-1]) + np.repeat(first - upto[:-1], sizes)].tobytes()


@lru_cache(maxsize=2)
def coder(path: str, pattern: str) -> ByteBpe:
    """One coder for each worker process."""
    return ByteBpe(path, pattern)


KEPT["coder"] = coder.cache_clear


DIGEST = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def digested(text: Column, path: str, pattern: str) -> Column:
    """Struct of n_tokens, ids_sha256 and decoded_sha256 of each text."""
    kind = pa.struct([("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    @F.arrow_udf(f"struct<{DIGEST.replace(' long', ': long').replace(' string', ': string')}>")
    def run(column: pa.Array) -> pa.Array:
        forget("coder")
        bpe, out = coder(path, pattern), []
        for ids, at in bpe.encode(column):
            for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
                own = ids[a:b]
                out.append((b - a, hashlib.sha256(",".join(map(str, own.tolist())).encode()).hexdigest(), hashlib.sha256(bpe.decode(own)).hexdigest()))
        release()
        return pa.StructArray.from_arrays([pa.array([x[k] for x in out], t.type) for k, t in enumerate(kind)], fields=list(kind))

    return run(text)


def encoded(text: Column, path: str, pattern: str) -> Column:
    """Array of ids of each text."""

    @F.arrow_udf("array<int>")
    def run(column: pa.Array) -> pa.Array:
        bpe = coder(path, pattern)
        parts, ends, base = [], [np.zeros(1, np.int64)], 0
        for ids, at in bpe.encode(column):
            parts.append(ids)
            ends.append(at[1:] + base)
            base += len(ids)
        return pa.ListArray.from_arrays(np.concatenate(ends).astype(np.int32), np.concatenate([np.zeros(0, np.int32), *parts]))

    return run(text)


def decoded(ids: Column, path: str, pattern: str) -> Column:
    """Bytes of each array of ids; null for null."""

    @F.arrow_udf("binary")
    def run(column: pa.Array) -> pa.Array:
        bpe = coder(path, pattern)
        return pa.array([None if x is None else bpe.decode(np.array(x, np.int64)) for x in column.to_pylist()], pa.binary())

    return run(ids)


def encode_documents(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row of ``docs`` (doc_id, text).

    A null text counts as empty: no ids, the digests of nothing. Repeated rows are kept, an empty
    table gives no rows, other columns are ignored, texts of any length are encoded whole.
    """
    return docs.select("doc_id", digested(F.col("text"), path, pattern).alias("_d")).select("doc_id", "_d.n_tokens", "_d.ids_sha256", "_d.decoded_sha256")


def public_file() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded again with the public multilingual ranks."""
    return encode_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), *public_file())
