"""Token ids in wavelet-matrix shard files.

Texts are encoded in ascending id order and written as shards of whole documents. A shard is one
file: a directory of its documents and one bit-plane per bit of the largest id, each plane
compressed. With rank and select over the planes it answers token access, counts of an id in a
range, and the place of an id's k-th occurrence, without unpacking the ids.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.llm.chunks import SpanTable
from corpusloom.llm.session import KEPT, small
from corpusloom.llm.wordkernel import pieces, utf8
from corpusloom.sources.tables import fresh_path, materialize, table

MAGIC = b"CLWM0001"
#: Ids in a shard, about; a longer document has a shard of its own.
SHARD_IDS = 1 << 20
TOGETHER = 64


class WaveletMatrix:
    """A sequence of ids as bit-planes, most significant first; in each plane the ids with bit 0
    go before those with bit 1, in order, to form the next."""

    def __init__(self, n: int, planes: list[np.ndarray]):
        self.n, self.planes, self.bits = n, planes, len(planes)
        self.before = []
        for p in planes:
            upto = np.zeros(len(p) + 1, np.int64)
            np.cumsum(np.bitwise_count(p), out=upto[1:])
            self.before.append(upto)
        self.zeros = [n - int(b[-1]) for b in self.before]

    @staticmethod
    def build(ids: np.ndarray, bits: int | None = None) -> WaveletMatrix:
        bits = bits or max(1, int(ids.max(initial=0)).bit_length())
        planes, cur = [], ids.astype(np.uint16 if bits <= 16 else np.uint32)
        for k in range(bits - 1, -1, -1):
            one = (cur & cur.dtype.type(1 << k)) != 0
            packed = np.packbits(one, bitorder="little")
            planes.append(np.concatenate([packed, np.zeros(-len(packed) % 8, np.uint8)]).view("<u8"))
            cur = np.concatenate([cur[~one], cur[one]])
        return WaveletMatrix(len(ids), planes)

    def _bit(self, k: int, at: np.ndarray) -> np.ndarray:
        return (self.planes[k][at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)

    def _ones(self, k: int, at: np.ndarray) -> np.ndarray:
        """Ones of plane k before each position."""
        word, rest = at >> 6, (at & 63).astype(np.uint64)
        last = np.minimum(word, max(0, len(self.planes[k]) - 1))
        part = self.planes[k][last] & ((np.uint64(1) << rest) - np.uint64(1)) if len(self.planes[k]) else np.zeros(len(at), np.uint64)
        return self.before[k][word] + np.where(rest > 0, np.bitwise_count(part), 0)

    def access(self, at: np.ndarray) -> np.ndarray:
        """Ids at the given positions."""
        at, out = np.asarray(at, np.int64), np.zeros(len(at), np.int64)
        for k in range(self.bits):
            bit, ones = self._bit(k, at).astype(bool), self._ones(k, at)
            out = (out << 1) | bit
            at = np.where(bit, self.zeros[k] + ones, at - ones)
        return out

    def _range(self, token: int, i: int, j: int) -> tuple[int, int]:
        edge = np.array([i, j], np.int64)
        if token >> self.bits:
            return 0, 0
        for k in range(self.bits):
            ones = self._ones(k, edge)
            edge = self.zeros[k] + ones if (token >> (self.bits - 1 - k)) & 1 else edge - ones
        return int(edge[0]), int(edge[1])

    def count(self, token: int, i: int = 0, j: int | None = None) -> int:
        """Occurrences of an id at positions i to j, j exclusive."""
        a, b = self._range(token, i, self.n if j is None else j)
        return b - a

    def select(self, token: int, nth: int) -> int:
        """Position of the nth occurrence (from 0) of an id; -1 if there are fewer."""
        a, b = self._range(token, 0, self.n)
        if nth < 0 or a + nth >= b:
            return -1
        at = a + nth
        for k in range(self.bits - 1, -1, -1):
            one = (token >> (self.bits - 1 - k)) & 1
            at = self._find(k, at - self.zeros[k] if one else at, bool(one))
        return at

    def _find(self, k: int, nth: int, one: bool) -> int:
        """Position in plane k of the nth (from 0) bit of the given kind."""
        upto = self.before[k] if one else np.arange(len(self.before[k])) * 64 - self.before[k]
        word = int(np.searchsorted(upto, nth, "right")) - 1
        flags = np.unpackbits(self.planes[k][word : word + 1].view(np.uint8), bitorder="little").astype(bool)
        return word * 64 + int(np.flatnonzero(flags == one)[nth - int(upto[word])])

    def decode(self) -> np.ndarray:
        """All ids: the planes are undone from the last to the first, each in one pass."""
        out = np.zeros(self.n, np.uint16 if self.bits <= 16 else np.uint32)
        for k in range(self.bits - 1, -1, -1):
            one = np.unpackbits(self.planes[k].view(np.uint8), count=self.n, bitorder="little").view(bool)
            now, zeros = np.empty_like(out), self.zeros[k]
            now[~one] = out[:zeros]
            now[one] = out[zeros:] | out.dtype.type(1 << (self.bits - 1 - k))
            out = now
        return out


def pack(ids: np.ndarray, doc_ids: list[int | None], counts: np.ndarray) -> bytes:
    """Bytes of a shard file: magic, header, directory, planes."""
    wm = WaveletMatrix.build(ids)
    squeeze = zstandard.ZstdCompressor(level=1).compress
    known = np.array([d is not None for d in doc_ids], np.uint8)
    directory = squeeze(known.tobytes() + np.array([d or 0 for d in doc_ids], "<i8").tobytes() + counts.astype("<u4").tobytes())
    planes = [squeeze(p.astype("<u8").tobytes()) for p in wm.planes]
    head = struct.pack("<QIII", wm.n, wm.bits, len(doc_ids), len(directory)) + struct.pack(f"<{wm.bits}I", *map(len, planes))
    return MAGIC + head + directory + b"".join(planes)


def unpack(data: bytes) -> tuple[WaveletMatrix, list[int | None], np.ndarray]:
    """(ids, document ids, their counts of ids) of a shard file."""
    if data[:8] != MAGIC:
        raise ValueError("not a token shard")
    n, bits, docs, size = struct.unpack_from("<QIII", data, 8)
    lengths = struct.unpack_from(f"<{bits}I", data, 28)
    at, open_ = 28 + 4 * bits, zstandard.ZstdDecompressor().decompress
    directory = open_(data[at : at + size])
    known = np.frombuffer(directory, np.uint8, docs)
    ids = np.frombuffer(directory, "<i8", docs, docs)
    counts = np.frombuffer(directory, "<u4", docs, 9 * docs).astype(np.int64)
    at, planes = at + size, []
    for length in lengths:
        planes.append(np.frombuffer(open_(data[at : at + length]), "<u8"))
        at += length
    return WaveletMatrix(n, planes), [int(i) if k else None for i, k in zip(ids, known)], counts


@lru_cache(maxsize=2)
def encoder(path: str) -> SpanTable:
    """The tokenizers library's encoder for one worker process; chunks met before are not encoded again."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    added = {i: t.content for i, t in tokenizer.get_added_tokens_decoder().items()}
    # in this alphabet every byte is one character; added tokens stand as they are
    length = np.zeros(max([*tokenizer.get_vocab().values(), *added]) + 1, np.int64)
    for token, i in tokenizer.get_vocab().items():
        length[i] = len(added[i].encode()) if i in added else len(token)

    def apart(chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        got = [np.array(e.ids, np.int32) for e in tokenizer.encode_batch_fast(chunks, add_special_tokens=False)]
        return np.concatenate(got), np.concatenate([[0], np.cumsum([len(ids) for ids in got])])

    def together(chunks: bytes, upto: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Chunks that start with their space: encoded ``TOGETHER`` at a time, then cut where the tokens' bytes reach a chunk's end."""
        cuts = [*upto[:-1:TOGETHER].tolist(), len(chunks)]
        joined = [chunks[a:b].decode() for a, b in zip(cuts, cuts[1:])]
        ids = np.concatenate([np.array(e.ids, np.int32) for e in tokenizer.encode_batch_fast(joined, add_special_tokens=False)])
        reached = np.concatenate([[0], np.cumsum(length[ids])])
        at = np.searchsorted(reached, upto)
        if not np.array_equal(reached[np.minimum(at, len(ids))], upto):  # a token's bytes are not as said above
            return apart([chunks[a:b].decode() for a, b in zip(upto.tolist(), upto[1:].tolist())])
        return ids, at

    return SpanTable(apart, together, special=tuple(added.values()))


KEPT["encoder"] = encoder.cache_clear


def _save(folder: str, name: str, data: bytes) -> None:
    store, base = fs.FileSystem.from_uri(folder)
    store.create_dir(base, recursive=True)
    with store.open_output_stream(f"{base}/{name}") as f:
        f.write(data)


MANIFEST = "part int, shard int, name string, n_docs long, n_tokens long"


def write_shards(docs: DataFrame, tokenizer: str, end_id: int, folder: str) -> DataFrame:
    """Encode ``docs`` (doc_id, text) in ascending (doc_id, text) order into shard files below ``folder``.

    Returns the manifest: part, shard, name, n_docs, n_tokens. Every document ends with ``end_id``;
    a null text is that id alone. Null ids come first; rows that are equal stay rows of their own.
    """
    ordered = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    ordered = ordered.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"), "text")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table_, part = encoder(tokenizer), TaskContext.get().partitionId()
        held: list[np.ndarray] = []
        owners: list[int | None] = []
        sizes: list[int] = []
        total = shard = 0
        done: list[dict] = []

        def flush() -> None:
            nonlocal held, owners, sizes, total, shard
            name = f"part-{part:06d}-{shard:06d}-{TaskContext.get().taskAttemptId()}.wm"
            _save(folder, name, pack(np.concatenate(held), owners, np.array(sizes)))
            done.append({"part": part, "shard": shard, "name": name, "n_docs": len(owners), "n_tokens": total})
            held, owners, sizes, total, shard = [], [], [], 0, shard + 1

        for batch in small(parts, "encoder"):
            ids_of, (data, offsets) = batch.column("doc_id").to_pylist(), utf8(batch.column("text"))
            for i, j in pieces(offsets, 1 << 20):
                ids, at = table_.encode(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                ids = np.insert(ids, at[1:], end_id)
                at = at + np.arange(j - i + 1)
                first = 0
                for k, n in enumerate(np.diff(at).tolist()):
                    if total and total + n > SHARD_IDS:
                        held.append(ids[at[first] : at[k]])
                        first = k
                        flush()
                    owners.append(ids_of[i + k])
                    sizes.append(n)
                    total += n
                held.append(ids[at[first] :])
        if owners:
            flush()
        yield pa.RecordBatch.from_pylist(done, pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("name", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

    return ordered.mapInArrow(run, MANIFEST)


def _per_document(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches_:
        for path, data in zip(batch.column("path").to_pylist(), batch.column("content")):
            wm, owners, counts = unpack(data.as_py())
            ids = wm.decode().astype("<u4")
            at = np.concatenate([[0], np.cumsum(counts)])
            yield pa.RecordBatch.from_pydict({
                "name": pa.array([path.rsplit("/", 1)[1]] * len(owners), pa.string()),
                "doc_id": pa.array(owners, pa.int64()),
                "offset": pa.array(at[:-1], pa.int64()),
                "n_tokens": pa.array(counts, pa.int64()),
                "ids_crc32": pa.array([zlib.crc32(ids[a:b].tobytes()) for a, b in zip(at, at[1:])], pa.int64()),
            })


def read_documents(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the shard files below ``folder``.

    A shard's first position is the sum over earlier parts and over earlier shards of its part.
    """
    parts = manifest.groupBy("part").agg(F.sum("n_tokens").alias("_n"))  # one row per writing task
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_part"))
    inside = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    base = manifest.withColumn("_shard", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).join(parts, "part").select("name", (F.col("_part") + F.col("_shard")).alias("_base"))
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wm").load(folder).select("path", "content")
    rows = files.mapInArrow(_per_document, "name string, doc_id long, offset long, n_tokens long, ids_crc32 long")
    return rows.join(base, "name").select("doc_id", (F.col("_base") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")


def store_and_read(docs: DataFrame, tokenizer: str, end_id: int, folder: str | None = None) -> DataFrame:
    """Write ``docs`` as shard files and read them back, see ``read_documents``. An empty table gives no rows."""
    spark = docs.sparkSession
    folder = folder or fresh_path(spark, "token-shards")
    manifest = materialize(write_shards(docs, tokenizer, end_id, folder), "token-manifest")
    if manifest.isEmpty():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    return read_documents(spark, folder, manifest)


def op3_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as wavelet-matrix shards of public byte-level ids, read back from the files."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return store_and_read(docs, public_tokenizers.path("byte_bpe_50k.json"), 2)
