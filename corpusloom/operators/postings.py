"""A stored inverted index that follows its files: versions of a file list over immutable postings.

A sync compares the metadata of a snapshot with the stored list, tokenises only files that are new or changed, and writes
their postings as one generation. The list of the new version names the generation of each file, so postings of changed or
deleted files stay where they are and are no longer read. A version counts once its commit line is written; a sync that fails
before leaves the last version as it was and its generation is written anew by the next. One writer at a time; any number
of readers, each on one version.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators.upkeep import changed

FILES = "path string, modified long, size long, gen int, units long, tokens long"
#: One row for each unit and bucket with its terms there.
POSTINGS = "path string, start_line int, end_line int, unit long, dl long, terms array<string>, tfs array<long>, bucket int, gen int"
UNITS = "path string, start_line int, end_line int, content string, unit long, gen int"
COMMITS = "version int, files long"
#: Terms asked for, and blocks of units, that each task may hold; more are joined by a shuffle.
HELD = 200_000


def whole_files(files: DataFrame) -> DataFrame:
    """Each file (path, text) as one unit, at lines 0 to 0; a null text has no tokens."""
    return files.select("path", F.lit(0).alias("start_line"), F.lit(0).alias("end_line"), F.col("text").alias("content"))


def counted(buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of ``POSTINGS`` without gen from rows of path, start_line, end_line, unit and tokens; a unit's tokens are counted where it lies, without a shuffle."""

    def count(part: pa.RecordBatch) -> pa.RecordBatch:
        sizes = pc.fill_null(pc.list_value_length(part.column(4)), 0).to_numpy().astype(np.int64)
        found = pc.list_flatten(part.column(4)).cast(pa.string()).dictionary_encode()
        words, codes = found.dictionary, found.indices.to_numpy()
        bucket = np.array([crc32(w.encode()) % buckets for w in words.to_pylist()], np.int64)
        cells = np.repeat(np.arange(len(sizes)), sizes) * buckets + bucket[codes]
        pairs, tfs = np.unique(cells * len(words) + codes, return_counts=True)
        cells = pairs // len(words)
        first = np.flatnonzero(np.concatenate([[True], cells[1:] != cells[:-1]]))
        ends = pa.array(np.append(first, len(cells)), pa.int32())
        row = cells[first] // buckets
        own = [part.column(i).take(pa.array(row)) for i in range(4)]
        lists = [pa.ListArray.from_arrays(ends, x) for x in (words.take(pa.array(pairs % len(words))), pa.array(tfs, pa.int64()))]
        return pa.RecordBatch.from_arrays([*own, pa.array(sizes[row], pa.int64()), *lists, pa.array(cells[first] % buckets, pa.int32())], names=["path", "start_line", "end_line", "unit", "dl", "terms", "tfs", "bucket"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                if len(pc.list_flatten(part.column(4))):
                    yield count(part)

    return run


@dataclass(frozen=True)
class PostingStore:
    """An index in ``folder``. ``units`` cuts files (path, text) into path, start_line, end_line, content; ``tokens`` gives the
    tokens of such a row. Paths are not null and not repeated."""

    spark: SparkSession
    folder: str
    units: Callable[[DataFrame], DataFrame]
    tokens: Callable[[], Column]
    buckets: int = 16

    def _read(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}")
        except AnalysisException:  # nothing is written yet
            return self.spark.createDataFrame([], schema)

    def version(self) -> int:
        """The last whole version; 0 before the first sync."""
        try:
            return self.spark.read.schema(COMMITS).json(f"{self.folder}/commits").agg(F.max("version")).first()[0] or 0
        except AnalysisException:
            return 0

    def files(self, version: int | None = None) -> DataFrame:
        """path, modified, size, gen, units, tokens of the files of a version."""
        return self._read(f"files/version={self.version() if version is None else version}", FILES)

    def bucket(self, term: str) -> Column:
        return F.pmod(F.crc32(F.encode(term, "UTF-8")), F.lit(self.buckets)).cast("int")

    def sync(self, snapshot: DataFrame) -> DataFrame:
        """Make the index follow ``snapshot`` (path, modified, size, text). Returns path and state: new, changed, unchanged, stale.

        Files with equal modified and size are not read again; a snapshot without rows empties the index.
        """
        last = self.version()
        old, gen = self.files(last), last + 1
        states_at = f"{self.folder}/states/version={gen}"
        changed(snapshot, old, "path", ["modified", "size"]).write.mode("overwrite").parquet(states_at)
        states = self.spark.read.schema("path string, state string").parquet(states_at)
        fresh = states.where("state in ('new', 'changed')").select("path")
        units_at = f"{self.folder}/units/gen={gen}"
        read = snapshot if last == 0 else snapshot.join(fresh, "path", "left_semi")  # at first all files are new
        self.units(read.select("path", "text")).withColumn("unit", F.monotonically_increasing_id()).write.mode("overwrite").parquet(units_at)
        units = self.spark.read.schema(UNITS.removesuffix(", gen int")).parquet(units_at)
        told = units.select("path", "start_line", "end_line", "unit", self.tokens().alias("_t"))
        posted = told.mapInArrow(counted(self.buckets), POSTINGS.removesuffix(", gen int"))
        # each task writes its own part of each bucket, so a common term is not one task's
        postings_at = f"{self.folder}/postings/gen={gen}"
        posted.write.mode("overwrite").partitionBy("bucket").parquet(postings_at)
        tokens = self.spark.read.schema(POSTINGS.removesuffix(", gen int")).parquet(postings_at).groupBy("path").agg(F.sum(F.aggregate("tfs", F.lit(0).cast("long"), lambda s, n: s + n)).alias("tokens"))
        counts = units.groupBy("path").agg(F.count("*").alias("units")).join(tokens, "path", "left")
        kept = old.join(states.where("state = 'unchanged'"), "path", "left_semi")
        added = read.select("path", "modified", "size").join(counts, "path", "left")
        added = added.select("path", "modified", "size", F.lit(gen).alias("gen"), F.coalesce("units", F.lit(0)).alias("units"), F.coalesce("tokens", F.lit(0)).alias("tokens"))
        now_at = f"{self.folder}/files/version={gen}"
        kept.select(*added.columns).union(added).write.mode("overwrite").parquet(now_at)
        self.spark.range(1).select(F.lit(gen).alias("version"), F.lit(self.files(gen).count()).alias("files")).coalesce(1).write.mode("append").json(f"{self.folder}/commits")
        return states

    def size(self, version: int | None = None) -> DataFrame:
        """One row: n units and avgdl, their mean number of tokens."""
        return self.files(version).agg(F.coalesce(F.sum("units"), F.lit(0)).alias("n"), (F.sum("tokens") / F.sum("units")).alias("avgdl"))

    def postings(self, terms: DataFrame | None = None, version: int | None = None) -> DataFrame:
        """term, path, start_line, end_line, tf, dl of a version; with ``terms`` (term) of these only, read from their buckets."""
        rows, single = self._live("postings", POSTINGS, version), F.explode(F.arrays_zip(F.col("terms").alias("term"), F.col("tfs").alias("tf"))).alias("_p")
        own = ("path", "start_line", "end_line")
        if terms is None:
            return rows.select(*own, "dl", single).select("_p.term", *own, "_p.tf", "dl")
        asked = terms.select("term").distinct().withColumn("bucket", self.bucket("term"))
        if asked.limit(HELD + 1).count() <= HELD:
            asked = F.broadcast(asked)
        return rows.select(*own, "dl", "bucket", single).select(*own, "dl", "bucket", "_p.term", "_p.tf").join(asked, ["bucket", "term"], "left_semi").select("term", *own, "tf", "dl")

    def contents(self, version: int | None = None) -> DataFrame:
        """path, start_line, end_line, content of the units of a version."""
        return self._live("units", UNITS, version).select("path", "start_line", "end_line", "content")

    def _live(self, name: str, schema: str, version: int | None) -> DataFrame:
        """Rows of the units of a version. A bit for each unit tells which are; 64 of them are a row, so that rows need no shuffle by path."""
        files, block = self.files(version), F.shiftright("unit", 6).alias("_block")
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("unit") % 64).cast("int"))
        units = self._read("units", UNITS).select("path", "gen", "unit").join(files.select("path", "gen"), ["path", "gen"], "left_semi")
        bits = units.groupBy("gen", block).agg(F.bit_or(bit).alias("_bits"))
        if (files.agg(F.sum("units")).first()[0] or 0) <= 64 * HELD:
            bits = F.broadcast(bits)
        rows = self._read(name, schema).withColumn("_block", block).join(bits, ["gen", "_block"])
        return rows.where(F.col("_bits").bitwiseAND(bit) != 0).drop("_block", "_bits")

    def term_counts(self, version: int | None = None) -> DataFrame:
        """term, df (units) and occurrences of a version."""
        return self.postings(version=version).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("occurrences"))
