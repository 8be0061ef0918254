"""Rotated log files: what there is, the last lines of several, and a tail that remembers how far it has read."""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Backups of a log: name.1 is the newest, name.<BACKUPS> the oldest.
BACKUPS = 5
# The form of a log line with its time to the millisecond.
LINE_FORM = r"^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}\.\d{3}) \[([A-Z]+)\] \[([^\]]+)\] (.*)$"
EVENTS = "path string, kind string, n int, line string"


def _read(spark: SparkSession, folder: str, columns: list) -> DataFrame:
    return spark.read.format("binaryFile").load(folder).select(*columns)


def _backup(name: str) -> Column:
    """The number of a backup, 0 for the log itself, null for other files."""
    form = rf"/{re.escape(name)}(?:\.([1-9][0-9]?))?$"
    own = F.regexp_extract("path", form, 1)
    number = F.when(own == "", 0).otherwise(own.cast("int"))
    return F.when(F.col("path").rlike(form) & (number <= BACKUPS), number)


def log_files(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """target, path, size, modified of the log ``name`` (``current``) and its backups (``backup:1`` and on) in ``folder``."""
    rows = _read(spark, folder, ["path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"), _backup(name).alias("_b")]).where("_b is not null")
    return rows.select(F.when(F.col("_b") == 0, "current").otherwise(F.concat(F.lit("backup:"), "_b")).alias("target"), "path", "size", "modified")


def lines_of(text: Column) -> Column:
    """Lines without their ends, also empty ones; none for an empty text."""
    parts = F.transform(F.split(F.regexp_replace(text, r"\n\z", ""), "\n"), lambda x: F.regexp_replace(x, r"\r+$", ""))
    return F.when(text == "", F.array().cast("array<string>")).otherwise(parts)


def last_lines(spark: SparkSession, folder: str, name: str, target: str = "combined", most: int = 1000) -> DataFrame:
    """place (from 1, oldest first) and line: the last lines of a log, ``most`` of them, from 100 to 5000.

    ``combined`` reads the backups from the oldest on and then the log, ``current`` the log, ``backup:N`` one backup; a number that is none of a
    backup, and files that are not there, give no rows. Each file gives its last ``most`` lines at most.
    """
    most = min(5000, max(100, most))
    if target in ("", "combined"):
        wanted = F.lit(True)
    elif target == "current":
        wanted = F.col("_b") == 0
    elif target.startswith("backup:"):
        number = target.removeprefix("backup:")
        wanted = (F.col("_b") == (int(number) if number.isdigit() else -1)) & (F.col("_b") > 0)
    else:
        raise ValueError(f"{target} is no target of a log")
    files = _read(spark, folder, [_backup(name).alias("_b"), lines_of(F.col("content").cast("string")).alias("_l")]).where(F.col("_b").isNotNull() & wanted)
    tails = files.select("_b", F.slice("_l", F.greatest(F.size("_l") - most + 1, F.lit(1)), F.lit(most)).alias("_l"))
    last = tails.select("_b", F.posexplode("_l").alias("_n", "line")).orderBy("_b", F.desc("_n")).limit(most)
    kept = last.groupBy().agg(F.collect_list(F.struct((-F.col("_b")).alias("b"), "_n", "line")).alias("_a"))  # most rows
    return kept.select(F.posexplode(F.array_sort("_a")).alias("_p", "_x")).select((F.col("_p") + 1).alias("place"), "_x.line")


def log_columns(line: Column) -> Column:
    """Struct of timestamp, level, module, message and raw of a line; where it has another form the message is the line and the rest is empty."""
    form = LINE_FORM
    names, found = ("timestamp", "level", "module", "message"), line.rlike(form)
    parts = [F.when(found, F.regexp_extract(line, form, k)).otherwise(line if n == "message" else F.lit("")).alias(n) for k, n in enumerate(names, 1)]
    return F.struct(*parts, line.alias("raw"))


class LogTail:
    """Follows files: each poll gives what came since the last one. Its state, in ``folder``, is the number of bytes read of each file.

    A poll's events are written before its state is; after a failure in between the next poll gives the same events again.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _polls(self) -> int:
        try:
            return self.spark.read.schema("poll int").json(f"{self.folder}/polls").agg(F.max("poll")).first()[0] or 0
        except AnalysisException:  # the first poll
            return 0

    def poll(self, files: str) -> DataFrame:
        """path, kind, n, line of new lines (``append``, n from 1) in ``files``, a folder or pattern; empty lines are left out.

        A file is followed from its end when it is first seen. One that got shorter is read from its beginning, after an event ``reset``.
        """
        last = self._polls()
        shape = "path string, offset long"
        state = self.spark.read.schema(shape).parquet(f"{self.folder}/offsets/poll={last}") if last else self.spark.createDataFrame([], shape)
        now = _read(self.spark, files, ["path", "content"]).withColumn("size", F.octet_length("content").cast("long"))
        both = now.join(state, "path", "left")
        cut = F.col("size") < F.col("offset")
        start = F.when(F.col("offset").isNull(), F.col("size")).when(cut, 0).otherwise(F.col("offset"))
        fresh = F.filter(lines_of(F.substring("content", (start + 1).cast("int"), F.octet_length("content")).cast("string")), lambda x: x != "")
        event = lambda kind, n, line: F.struct(F.lit(kind).alias("kind"), n.cast("int").alias("n"), line.alias("line"))
        appended = F.transform(fresh, lambda x, i: event("append", i + 1, x))
        reset = F.array(event("reset", F.lit(0), F.lit(None).cast("string")))
        told = both.select("path", F.inline(F.when(cut, F.concat(reset, appended)).otherwise(appended)))
        events_at = f"{self.folder}/events/poll={last + 1}"
        told.select("path", "kind", "n", "line").write.mode("overwrite").parquet(events_at)
        offsets = both.select("path", F.col("size").alias("offset")).union(state.join(now, "path", "left_anti").select("path", "offset"))
        offsets.write.mode("overwrite").parquet(f"{self.folder}/offsets/poll={last + 1}")
        self.spark.range(1).select(F.lit(last + 1).alias("poll")).coalesce(1).write.mode("append").json(f"{self.folder}/polls")
        return self.spark.read.schema(EVENTS).parquet(events_at)
