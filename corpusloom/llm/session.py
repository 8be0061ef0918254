"""Session settings and small column helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of long texts that a task works on at a time.
ROWS = 1000


def release() -> None:
    """Give memory that is free back to the system: workers stay for the stages that follow."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # of the GNU C library
        trim(0)


#: What worker processes keep from task to task, by name: how to drop it.
KEPT: dict[str, Callable[[], None]] = {}


def forget(but: str = "") -> None:
    """Drop what this worker keeps for other operators' tasks, all but the named: a worker stays for the stages that follow."""
    for name, drop in KEPT.items():
        if name != but:
            drop()


def small(parts: Iterator[pa.RecordBatch], keeps: str = "") -> Iterator[pa.RecordBatch]:
    """The batches cut into at most ``ROWS`` rows (Spark bounds their bytes). Only what ``keeps`` names is kept of earlier tasks."""
    forget(keeps)
    for batch in parts:
        for i in range(0, len(batch), ROWS):
            yield batch.slice(i, ROWS)
    release()


def id_fold(doc_id: str, folds: int) -> Column:
    """crc32 of the decimal id modulo ``folds``; null for a null id."""
    return (F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds).cast("int")


def row_key(*columns: str) -> Column:
    """A 64-bit hash of the given columns; nulls hash like any value."""
    return F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\x00null")) for c in columns])


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held: int, rows: int) -> DataFrame:
    """Documents with a label outside the held-out fold, at most ``rows`` of them, chosen by a hash of the id.

    The chosen ids (not more than ``rows``) are broadcast, so texts are not shuffled. Of rows that share a chosen id
    one is kept: that whose text has the least hash.
    """
    chosen = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
        .where(id_fold("doc_id", folds) != held)
        .groupBy("doc_id")
        .agg(F.max(F.col(label).cast("int")).alias("_label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(rows)
    )
    found = docs.join(F.broadcast(chosen), "doc_id").withColumn("_hash", F.xxhash64("text"))
    return found.groupBy("doc_id").agg(F.min_by(F.struct(*[c for c in found.columns if c not in ("doc_id", "_hash")]), "_hash").alias("_one")).select("doc_id", "_one.*")
