"""Streams against their batch forms: timers, routing, coalescing, and events from chunks cut anywhere."""

import json
import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from corpusloom.streaming import assembly as A
from corpusloom.streaming import requests as R


@pytest.fixture(scope="module")
def rocks(spark):
    own = spark.newSession()
    own.conf.set(*R.ROCKS)
    own.conf.set("spark.sql.shuffle.partitions", "2")
    return own


def streamed(session, batches, shape, operator, folder):
    """Rows that ``operator`` gives of a stream whose micro-batches are the given lists of rows, one file each."""
    where, name = f"{folder}/in", f"out_{abs(hash(str(folder)))}"
    for k, rows in enumerate(batches):
        session.createDataFrame(rows, shape).coalesce(1).write.mode("append").parquet(where)
    source = session.readStream.schema(shape).option("maxFilesPerTrigger", 1).parquet(where)
    query = operator(source).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{folder}/check").start()
    query.processAllAvailable()
    query.stop()
    return sorted(map(tuple, session.table(name).collect()), key=str)


def test_state_store_is_asked_for(spark):
    events = spark.readStream.format("rate").load().select(F.lit("a").alias("project"), F.col("value").alias("seq"), F.lit("request").alias("kind"), F.lit("full").alias("mode"))
    with pytest.raises(ValueError, match="stateStore"):
        R.job_starts(events)


def test_sessions_end_by_the_sooner_limit():
    own = lambda *times: R.folded("k", list(times), None, 10, 25)
    assert own(0, 10, 20, 25) == ([], (0, 25, 4))
    assert own(0, 10, 20, 26) == ([("k", 0, 20, 25, 3, "max_wait")], (26, 26, 1))
    assert own(0, 11) == ([("k", 0, 0, 10, 1, "quiet")], (11, 11, 1))
    assert own(0, 10, 20, 99)[0] == [("k", 0, 20, 25, 3, "max_wait")]  # the longest wait ends before it is quiet


def test_streamed_sessions_equal_the_batch(rocks, tmp_path):
    rng, start = random.Random(2), datetime(2024, 1, 1, tzinfo=timezone.utc)
    times = sorted(rng.sample(range(4000), 160))
    rows = [(rng.choice("abc"), start + timedelta(seconds=t)) for t in times] + [(None, start)]
    cuts = [rows[:50], rows[50:90], rows[90:], [("clock", start + timedelta(days=2))], [("clock", start + timedelta(days=3))]]
    got = streamed(rocks, cuts, "key string, ts timestamp", lambda s: R.change_sessions(s, 60_000, 200_000), tmp_path)
    want = R.change_sessions_batch(rocks.createDataFrame(rows, "key string, ts timestamp"), 60_000, 200_000)
    assert [r for r in got if r[0] != "clock"] == sorted(map(tuple, want.collect()), key=str)  # timers close them: no next event of their keys
    assert {r[5] for r in got} == {"quiet", "max_wait"}


def test_coalescing(rocks, tmp_path):
    states = []
    held = None
    for kind, mode in (("done", ""), ("request", "incremental"), ("request", "incremental"), ("request", "full"), ("request", "incremental"), ("done", ""), ("done", ""), ("request", "full")):
        held, started = R.coalesced(held, kind, mode)
        states.append(started)
    assert states == [None, "incremental", None, None, None, "full", None, "full"]
    rng = random.Random(7)
    rows = [(rng.choice(["p", "q", "r"]), k, rng.choice(["request", "request", "done"]), rng.choice(["full", "incremental", "incremental"])) for k in range(200)] + [(None, 900, "request", "full")]
    shape = "project string, seq long, kind string, mode string"
    got = streamed(rocks, [rows[:40], rows[40:41], rows[41:]], shape, R.job_starts, tmp_path)
    assert got == sorted(map(tuple, R.job_starts_batch(rocks.createDataFrame(rows, shape)).collect()), key=str) and len(got) > 20


def test_flushes_are_routed(spark, tmp_path):
    shape = "parent string, path string"
    nested = spark.createDataFrame([("/w/app",), ("/w/app/core",), ("/w/app",)], "root string")
    rows = [("/w", "/w/app/x.rs"), ("/w", "/w/app/core/y.rs"), ("/w", "/w/app/core"), ("/w", "/w/apple/z.rs"), ("/w", "/other/q"), ("/w", None), ("/w", "/w/app/x.rs")]
    got = []
    for batch in (rows[:3], rows[3:]):
        spark.createDataFrame(batch, shape).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(shape).parquet(f"{tmp_path}/in")
    query = R.routed_flushes(source, nested, lambda out, k: got.extend(tuple(r) for r in out.collect())).option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(got) == [(0, "/w", 1), (0, "/w/app", 1), (0, "/w/app/core", 2)]
    changes = spark.createDataFrame([(1, *r) for r in rows], "flush int, " + shape)
    assert [tuple(r) for r in R.affected_projects(changes, nested.limit(0)).collect()] == [(1, "/w", 5)]
    assert R.affected_projects(changes.limit(0), nested).collect() == []


def messages(rng):
    texts = [rng.choice(["ab", "漢字é", 'quote " and \\', "line\nbreak", ""]) for _ in range(rng.choice([3, 20, 60, 140]))]
    lines = [("data: " if rng.random() < 0.7 else "") + json.dumps({"text": t}, ensure_ascii=rng.random() < 0.5) for t in texts]
    for noise in (": ping", "data: [DONE]", '{"text": 5}', '{"other": "x"}', "", "null"):
        lines.insert(rng.randint(0, len(lines)), noise)
    return [t for t in texts if t], ("\r\n" if rng.random() < 0.5 else "\n").join(lines).encode()


def cut(rng, data, name):
    places = sorted(rng.sample(range(1, len(data)), min(len(data) - 1, rng.randint(0, 30))))
    parts = [data[a:b] for a, b in zip([0, *places], [*places, len(data)])]
    return [(name, k, p, k == len(parts) - 1) for k, p in enumerate(parts)]


def test_any_cut_gives_the_same_events(rocks, tmp_path):
    rng, rows, want = random.Random(11), [], []
    for k in range(12):
        texts, data = messages(rng)
        for again in range(3):  # the same bytes in other cuts
            name = f"s{k}.{again}"
            rows += cut(rng, data, name)
            want += [(name, n, t, min(90, 2 * n % 256)) for n, t in enumerate(texts, 1)]
    shape = "stream string, seq long, data binary, last boolean"
    batch = A.texts_of_chunks_batch(rocks.createDataFrame(rows + rows[:5] + [(None, 0, b"x", True)], shape))
    assert sorted(map(tuple, batch.collect()), key=str) == sorted(want, key=str)
    rng.shuffle(rows)  # out of order over batches, and some chunks twice
    third = len(rows) // 3
    got = streamed(rocks, [rows[:third], rows[third : 2 * third] + rows[:9], rows[2 * third :]], shape, A.texts_of_chunks, tmp_path)
    assert got == sorted(want, key=str)
