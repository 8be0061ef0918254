"""Texts from server-sent events that come in chunks: lines may cross the borders of chunks, and chunks may come out of order."""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from corpusloom.streaming.requests import _names, checked
from corpusloom.streaming.sessions import _by_key

EVENTS = "stream string, n long, text string, progress int"


def line_text(line: bytes) -> str | None:
    """The non-empty string ``text`` of a line's JSON object, with or without ``data:`` before it; None where there is none."""
    payload = line.decode("utf-8", "replace").strip().removeprefix("data:").strip()
    try:
        found = json.loads(payload)
    except ValueError:
        return None
    text = found.get("text") if isinstance(found, dict) else None
    return text if isinstance(text, str) and text else None


def fed(rest: bytes, data: bytes, last: bool) -> tuple[list[str], bytes]:
    """Texts of the lines that ``data`` ends, and the unfinished line; after the last chunk that counts as a line too."""
    *lines, rest = (rest + data).split(b"\n")
    if last:
        lines, rest = [*lines, rest], b""
    return [t for t in map(line_text, lines) if t is not None], rest


def _rows(stream: str, n: int, texts: list[str]) -> list[tuple]:
    return [(stream, n + k, t, min(90, 2 * (n + k) % 256)) for k, t in enumerate(texts, 1)]


class Assembly(StatefulProcessor):
    """Chunks wait until all before them have come. State of a stream: its next chunk, texts so far, the unfinished line, waiting chunks."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("place", "seq long, n long, rest binary")
        self.waiting = handle.getMapState("waiting", "seq long", "data binary, last boolean")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        seq, n, rest = self.state.get() if self.state.exists() else (0, 0, b"")
        for part in rows:
            for at, data, last in part[["seq", "data", "last"]].itertuples(index=False, name=None):
                if at >= seq:  # a chunk that came before is not taken again
                    self.waiting.updateValue((int(at),), (bytes(data or b""), bool(last)))
        out: list[tuple] = []
        while self.waiting.containsKey((seq,)):
            data, last = self.waiting.getValue((seq,))
            self.waiting.removeKey((seq,))
            texts, rest = fed(bytes(rest), bytes(data), last)
            out += _rows(key[0], n, texts)
            seq, n = seq + 1, n + len(texts)
        self.state.update((seq, n, bytes(rest)))
        yield pd.DataFrame(out, columns=_names(EVENTS))

    def close(self) -> None:
        pass


def texts_of_chunks(chunks: DataFrame) -> DataFrame:
    """stream, n, text, progress of each event of a stream of ``chunks`` (stream, seq from 0, data binary, last boolean).

    However a stream's bytes are cut, the events are the same. Lines that are no JSON object with a text are passed over; progress
    is twice the number of texts in one byte, so it wraps at 256, at most 90. Null streams drop; null data is empty.
    """
    checked(chunks.sparkSession)
    own = chunks.where("stream is not null").select("stream", "seq", "data", F.coalesce("last", F.lit(False)).alias("last"))
    return own.groupBy("stream").transformWithStateInPandas(Assembly(), EVENTS, "Append", "None")


def texts_of_chunks_batch(chunks: DataFrame) -> DataFrame:
    """The same events of a whole table. A stream's chunks are read in order, batch by batch; what is held is the unfinished line."""

    def walk(key: tuple, parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, rest = 0, b""
        for part in parts:
            out = []
            for data, last in part[["data", "last"]].itertuples(index=False, name=None):
                texts, rest = fed(rest, bytes(data or b""), bool(last))
                out += _rows(key[0], n, texts)
                n += len(texts)
            yield pd.DataFrame(out, columns=_names(EVENTS))

    own = chunks.where("stream is not null").dropDuplicates(["stream", "seq"]).select(F.col("stream").alias("key"), "seq", "data", F.coalesce("last", F.lit(False)).alias("last"))
    return own.repartition("key").sortWithinPartitions("key", "seq").mapInPandas(_by_key(walk), EVENTS)
