"""Records of projects, outputs, versions, backups and replies on odd values."""

import random
from datetime import datetime

import duckdb
from pyspark.sql import functions as F

from corpusloom.functions import records as R
from corpusloom.plans import collections


def told(spark, values, shape, column):
    rows = spark.createDataFrame([(k, *v) for k, v in enumerate(values)], f"k int, {shape}")
    return [r.x for r in rows.select("k", column.alias("x")).orderBy("k").collect()]


def test_outputs(spark):
    cases = {None: (0, 0, 0, 0), "": (0, 0, 0, 0), " \n": (0, 0, 0, 0), "ok": (1, 0, 0, 0), " (no matches) ": (0, 0, 0, 0), "Error: boom": (0, 1, 0, 0), "Error: dir not found": (0, 1, 1, 0), "x\nError: file not found": (1, 0, 0, 0), "Hint: requested path missing": (0, 0, 1, 0), "  Warning: requested path missing a\nfound": (1, 0, 1, 1), "Warning: requested path missing\n Error: a.b": (0, 1, 1, 1)}
    got = told(spark, [(v,) for v in cases], "v string", R.output_flags(F.col("v")))
    assert [tuple(map(int, r)) for r in got] == list(cases.values())


def test_highlights_put_together_are_the_text(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice("aAbB.é\n") for _ in range(rng.randint(0, 30))) for _ in range(200)]
    for query in ("ab", "a.", "é", ""):
        for text, parts in zip(texts, told(spark, [(t,) for t in texts], "v string", R.highlighted(F.col("v"), query))):
            assert "".join(p.text for p in parts) == text and parts
            assert all((p.text.lower() == query) == p.hit for p in parts) or not query
            assert not any(query in p.text.lower() for p in parts if not p.hit) or not query
    assert told(spark, [(None,)], "v string", R.highlighted(F.col("v"), "a")) == [None]


def test_choices(spark):
    options = ["Yes", " No ", "B", "é"]
    cases = {"a": ["Yes"], "B,b": [" No "], "No，yes": None, "No, Yes ,A": [" No ", "Yes"], "1": None, "Z": None, "D": ["é"], "é": ["é"], "": [], None: []}
    assert told(spark, [(c, options) for c in cases], "c string, o array<string>", R.selected_options(F.col("c"), F.col("o"))) == list(cases.values())
    assert told(spark, [("a-b_c9漢defg",), ("--",), (None,)], "v string", R.request_code(F.col("v"), "NONE")) == ["ABC9DE", "NONE", None]


def test_times_and_versions(spark):
    names = {"20240105-101112-7.m.json": datetime(2024, 1, 5, 10, 11, 12, 7000), "20240105-101112-61000.m.json": datetime(2024, 1, 5, 10, 12, 13), "20241305-101112-7.m.json": None, "20240105-101112.m.json": None, "20240105-101112-x.m.json": None, "20240105-101112-7.json": None, None: None}
    assert told(spark, [(n,) for n in names], "v string", R.backup_time(F.col("v"), ".m.json")) == list(names.values())
    pairs = {("1.2", "1.2.0"): 0, ("1.x.2", "1.0.1"): 1, ("", "0"): 0, ("1.10", "1.9"): 1, ("0.1", "a.2"): -1, (None, "1"): None}
    assert told(spark, list(pairs), "a string, b string", R.version_order_zero(F.col("a"), F.col("b"))) == list(pairs.values())


def test_projects_and_runs(spark):
    at = datetime(2024, 1, 1)
    rows = [("/w/b", "indexing", True, None), ("/w/A", "synced", True, at), ("c:\\x\\C", "synced", None, None), ("/w/d", "failed", True, at), ("/w/e", "idle", False, None), ("/w/f", "paused", False, None)]
    projects = spark.createDataFrame(rows, "root string, state string, stale boolean, succeeded timestamp")
    order = lambda by: [r.root for r in projects.orderBy(*R.project_order(by)).collect()]
    assert order("state") == ["/w/b", "/w/f", "/w/A", "/w/d", "c:\\x\\C", "/w/e"]
    assert order("name") == ["/w/A", "/w/b", "c:\\x\\C", "/w/d", "/w/e", "/w/f"] and order("time")[:2] == ["/w/A", "/w/d"]
    assert [tuple(r) for r in R.state_counts(projects, []).collect()] == [(6, 1, 1, 2, 1, 1)]
    runs = spark.createDataFrame([(1, 10, 20), (1, 11, None), (2, None, 5), (3, 7, 7), (4, 30, 10)], "g int, proxy_ms long, direct_ms long")
    assert sorted(map(tuple, R.compared(runs, ["g"]).collect())) == [(1, "proxy", 50), (2, "unknown", None), (3, "level", None), (4, "direct", 66)]
    same = spark.createDataFrame([(3, "a", None), (1, "a", None), (2, None, "a"), (4, "a", "")], "at int, x string, y string")
    assert sorted(map(tuple, R.distinct_rows(same, ["at"]).collect()), key=str) == [(1, "a", None), (2, None, "a"), (4, "a", "")]


def test_a_change_of_means_takes_no_part_of_the_order_of_rows(spark, tmp_path):
    # each order of 0.1, 0.2 and 0.3 has its own sum of doubles, and the change is a whole number of per cent
    values = {1: (0.1, 0.2, 0.3), 2: (0.3, 0.2, 0.1), 3: (0.2, 0.3, 0.1), 4: (0.7, 0.1, 0.3), 5: (0.0,), 6: (None, 0.1), 7: (), 8: (-1.0,)}
    rows = [(user, "view", v) for user, own in values.items() for v in own] + [(user, "click", 0.4) for user in values] + [(9, "view", 1.0), (10, "error", 2.0)]
    frame = spark.createDataFrame(rows, "user_id long, event_type string, value double").coalesce(1)
    frame.write.parquet(f"{tmp_path}/events.parquet")
    query, sql = collections.QUERIES["compare_verdict"]
    got = {r.user_id: (r.percent, r.verdict) for r in query(spark, f"file://{tmp_path}").collect()}
    none = (None, "unknown")
    assert got == {1: (100, "slower"), 2: (100, "slower"), 3: (100, "slower"), 4: (9, "slower"), 5: none, 6: (300, "slower"), 7: none, 8: none, 9: none, 10: none}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    assert {u: (p, v) for u, p, v in con.execute(sql).fetchall()} == got
