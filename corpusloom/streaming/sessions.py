"""Streams: log lines as rows, and change sessions that end when it is quiet or after the longest wait."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from corpusloom.functions.text import log_fields

OUT = "key string, first_ms long, last_ms long, n_events long, reason string"
STATE = "first long, last long, n long"


def log_tail(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of ts, level, module and message from the log files that come into ``folder``; lines of another form are left out."""
    lines = spark.readStream.text(folder)
    return lines.select(log_fields(F.col("value")).alias("_f")).where("_f is not null").select("_f.*")


def _end(state: tuple, quiet_ms: int, most_ms: int) -> int:
    """The sooner of both limits."""
    return min(state[1] + quiet_ms, state[0] + most_ms)


def _reason(state: tuple, quiet_ms: int, most_ms: int) -> str:
    return "quiet" if state[1] + quiet_ms <= state[0] + most_ms else "max_wait"


def _fold(key: str, times: list[int], state: tuple | None, quiet_ms: int, most_ms: int) -> tuple[list[tuple], tuple | None]:
    """Finished sessions of one key and the open one, from events in order of time."""
    done = []
    for t in times:
        if state and t > _end(state, quiet_ms, most_ms):
            done.append((key, *state, _reason(state, quiet_ms, most_ms)))
            state = None
        state = (state[0], max(t, state[1]), state[2] + 1) if state else (t, t, 1)
    return done, state


def capped_sessions(events: DataFrame, quiet_ms: int, most_ms: int, late: str = "0 seconds") -> DataFrame:
    """key, first_ms, last_ms, n_events and reason of each session of a stream (key, ts).

    A session ends ``quiet_ms`` after its last event or ``most_ms`` after its first (reason ``max_wait``), whichever is sooner,
    once the watermark has passed that or a later event comes. State is three numbers a key. Events of one batch are
    sorted by key; later batches are taken to follow. ``requests.change_sessions`` does the same with timers.
    """

    def update(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = tuple(state.get) if state.exists else None
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([(key[0], *held, _reason(held, quiet_ms, most_ms))], columns=[c.split()[0] for c in OUT.split(", ")])
            return
        times = sorted(int(t) for p in parts for t in p["ms"])
        done, held = _fold(key[0], times, held, quiet_ms, most_ms)
        state.update(held)
        state.setTimeoutTimestamp(max(_end(held, quiet_ms, most_ms) + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(done, columns=[c.split()[0] for c in OUT.split(", ")])

    marked = events.withWatermark("ts", late).withColumn("ms", F.unix_millis("ts"))
    return marked.groupBy("key").applyInPandasWithState(update, OUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def capped_sessions_batch(events: DataFrame, quiet_ms: int, most_ms: int) -> DataFrame:
    """The same sessions of a whole table; the last one of each key, still open, has reason ``open``.

    The longest wait depends on where each session began, so a key's events are read in order, in Arrow batches.
    """

    def walk(key: tuple, parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state = None
        for p in parts:
            done, state = _fold(key[0], [int(t) for t in p["ms"]], state, quiet_ms, most_ms)
            yield pd.DataFrame(done, columns=[c.split()[0] for c in OUT.split(", ")])
        yield pd.DataFrame([(key[0], *state, "open")] if state else [], columns=[c.split()[0] for c in OUT.split(", ")])

    rows = events.where("key is not null and ts is not null").select("key", F.unix_millis("ts").alias("ms"))
    return rows.repartition("key").sortWithinPartitions("key", "ms").mapInPandas(_by_key(walk), OUT)


def _by_key(walk):
    """Calls ``walk`` with each key of sorted batches and its rows, batch by batch."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def runs():
            for p in parts:
                for key, rows in p.groupby("key", sort=False):
                    yield key, rows

        source, ahead = runs(), None
        ahead = next(source, None)
        while ahead is not None:
            key = ahead[0]

            def own(key=key):
                nonlocal ahead
                while ahead is not None and ahead[0] == key:
                    rows = ahead[1]
                    ahead = next(source, None)
                    yield rows

            yield from walk((key,), own())

    return run
