"""Index requests from file events: sessions of changes that timers close, routing to projects, and coalescing of requests.

The stream forms keep their state in RocksDB: the session must set ``ROCKS`` before a query starts. Each has a batch form
with the same results.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from corpusloom.functions.text import ancestors
from corpusloom.streaming.sessions import _by_key

ROCKS = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
SESSIONS = "key string, first_ms long, last_ms long, end_ms long, n_events long, reason string"
STARTS = "project string, seq long, mode string"


def checked(spark: SparkSession) -> None:
    """An error where the session's state store can't hold what these operators need."""
    if spark.conf.get(ROCKS[0], None) != ROCKS[1]:
        raise ValueError(f"set {ROCKS[0]} to {ROCKS[1]} first")


def _names(shape: str) -> list[str]:
    return [c.split()[0] for c in shape.split(", ")]


class Sessions(StatefulProcessor):
    """A session ends ``quiet_ms`` after its last event or ``most_ms`` after its first, whichever is sooner. State: three numbers."""

    def __init__(self, quiet_ms: int, most_ms: int):
        self.quiet_ms, self.most_ms = quiet_ms, most_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("session", "first long, last long, n long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        held = self.state.get() if self.state.exists() else None
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        done, held = folded(key[0], sorted(int(t) for part in rows for t in part["ms"]), held, self.quiet_ms, self.most_ms)
        self.state.update(held)
        self.handle.registerTimer(max(min(held[1] + self.quiet_ms, held[0] + self.most_ms) + 1, timerValues.getCurrentWatermarkInMs() + 1))
        yield pd.DataFrame(done, columns=_names(SESSIONS))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        held = self.state.get()
        self.state.clear()
        yield pd.DataFrame([ended(key[0], held, self.quiet_ms, self.most_ms)], columns=_names(SESSIONS))

    def close(self) -> None:
        pass


def ended(key: str, held: tuple, quiet_ms: int, most_ms: int) -> tuple:
    """A session's row: its end is the sooner of both limits."""
    first, last, n = held
    quiet = last + quiet_ms <= first + most_ms
    return key, first, last, last + quiet_ms if quiet else first + most_ms, n, "quiet" if quiet else "max_wait"


def folded(key: str, times: list[int], held: tuple | None, quiet_ms: int, most_ms: int) -> tuple[list[tuple], tuple | None]:
    """Ended sessions of a key and the open one, from events in order of time; an event at the very end still belongs."""
    done = []
    for t in times:
        if held and t > min(held[1] + quiet_ms, held[0] + most_ms):
            done.append(ended(key, held, quiet_ms, most_ms))
            held = None
        held = (held[0], max(t, held[1]), held[2] + 1) if held else (t, t, 1)
    return done, held


def change_sessions(events: DataFrame, quiet_ms: int, most_ms: int, late: str = "0 seconds") -> DataFrame:
    """Sessions of a stream (key, ts), each given out once the watermark has passed its end, without waiting for a next event."""
    checked(events.sparkSession)
    marked = events.where("key is not null").withWatermark("ts", late).select("key", "ts", F.unix_millis("ts").alias("ms"))
    return marked.groupBy("key").transformWithStateInPandas(Sessions(quiet_ms, most_ms), SESSIONS, "Append", "eventTime")


def change_sessions_batch(events: DataFrame, quiet_ms: int, most_ms: int) -> DataFrame:
    """All sessions of a table (key, ts), also the last ones, as if time went on. A key's events are read in order, batch by batch."""

    def walk(key: tuple, parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for part in parts:
            done, held = folded(key[0], [int(t) for t in part["ms"]], held, quiet_ms, most_ms)
            yield pd.DataFrame(done, columns=_names(SESSIONS))
        yield pd.DataFrame([ended(key[0], held, quiet_ms, most_ms)] if held else [], columns=_names(SESSIONS))

    rows = events.where("key is not null and ts is not null").select("key", F.unix_millis("ts").alias("ms"))
    return rows.repartition("key").sortWithinPartitions("key", "ms").mapInPandas(_by_key(walk), SESSIONS)


def affected_projects(changes: DataFrame, nested: DataFrame) -> DataFrame:
    """flush, project, changed: the projects that each flush of ``changes`` (flush, parent, path) touches, and by how many paths.

    A path belongs to the longest root of ``nested`` (root) that is the path or a folder above it, else to its parent where
    it begins with that; others drop. Without nested roots all go to their parent. Null paths drop.
    """
    any_root = nested.limit(1).agg(F.count("*").alias("_roots"))
    keys = changes.where("path is not null").distinct().withColumn("root", F.explode(F.array_append(ancestors(F.col("path")), F.col("path"))))
    roots = nested.select("root", F.lit(True).alias("_hit")).distinct()
    found = keys.join(roots, "root", "left").groupBy("flush", "parent", "path").agg(F.max_by("root", F.when(F.col("_hit"), F.length("root"))).alias("_root"), F.bool_or(F.coalesce("_hit", F.lit(False))).alias("_hit"))
    inside = (F.col("_roots") == 0) | F.startswith("path", "parent")
    project = F.when(F.col("_hit"), F.col("_root")).when(inside, F.col("parent"))
    own = found.join(F.broadcast(any_root)).withColumn("project", project).where("project is not null")  # one row
    return own.groupBy("flush", "project").agg(F.count("*").alias("changed"))


def routed_flushes(changes: DataFrame, nested: DataFrame, request: Callable[[DataFrame, int], None]):
    """A writer of a stream of ``changes``: each micro-batch is one flush, routed by ``affected_projects`` and handed to ``request(projects, batch)``.

    A batch may be handed over twice after a failure, with the same number.
    """

    def flush(batch: DataFrame, number: int) -> None:
        request(affected_projects(batch.withColumn("flush", F.lit(number)).select("flush", "parent", "path"), nested), number)

    return changes.writeStream.foreachBatch(flush)


def coalesced(held: str | None, kind: str, mode: str) -> tuple[str | None, str | None]:
    """(state, started mode) after an event of kind ``request`` or ``done``. State: None idle, ``run`` at work, else the mode that follows.

    While a job is at work one request is kept, and ``full`` outweighs any other.
    """
    if kind == "request":
        if held is None:
            return "run", mode
        return (held if held == "full" else mode), None
    if held in (None, "run"):
        return None, None
    return "run", held


class Coalesce(StatefulProcessor):
    """Starts of jobs from requests and ends of jobs, in order of seq within a batch. State: one word a project."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("job", "held string")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        held, out = (self.state.get()[0] if self.state.exists() else None), []
        for seq, kind, mode in sorted(r for part in rows for r in part[["seq", "kind", "mode"]].itertuples(index=False, name=None)):
            held, started = coalesced(held, kind, mode)
            if started:
                out.append((key[0], seq, started))
        if held is None:
            self.state.clear()
        else:
            self.state.update((held,))
        yield pd.DataFrame(out, columns=_names(STARTS))

    def close(self) -> None:
        pass


def job_starts(events: DataFrame) -> DataFrame:
    """project, seq, mode of each job that starts, from a stream (project, seq, kind, mode); see ``coalesced``. Null projects drop."""
    checked(events.sparkSession)
    own = events.where("project is not null").select("project", "seq", "kind", F.coalesce("mode", F.lit("")).alias("mode"))
    return own.groupBy("project").transformWithStateInPandas(Coalesce(), STARTS, "Append", "None")


def job_starts_batch(events: DataFrame) -> DataFrame:
    """The same starts of a whole table. A project's events are read in order of seq, batch by batch; what is held is one word."""

    def walk(key: tuple, parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for part in parts:
            out = []
            for seq, kind, mode in part[["seq", "kind", "mode"]].itertuples(index=False, name=None):
                held, started = coalesced(held, kind, mode)
                if started:
                    out.append((key[0], seq, started))
            yield pd.DataFrame(out, columns=_names(STARTS))

    own = events.where("project is not null").select(F.col("project").alias("key"), "seq", "kind", F.coalesce("mode", F.lit("")).alias("mode"))
    return own.repartition("key").sortWithinPartitions("key", "seq").mapInPandas(_by_key(walk), STARTS)
