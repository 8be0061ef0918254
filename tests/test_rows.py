"""Nulls, empty texts and tables, files of several encodings, streams against batches."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.operators import nearness as N
from corpusloom.operators import retrieval as R
from corpusloom.operators import search as Q
from corpusloom.operators import upkeep as U
from corpusloom.sources import files
from corpusloom.streaming import sessions


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "v string").select(column(F.col("v")).alias("x")).first().x


def test_text_functions_on_null_and_empty(spark):
    for f in (X.cjk_share, X.code_tokens, X.plain_path, lambda v: X.byte_size(F.octet_length(v)), lambda v: X.thousands(F.length(v)), X.camel_parts, X.log_fields, lambda v: X.cut_output(v, 2, 2, "m"), lambda v: X.truncated(v, 3)):
        assert one(spark, f, None) is None
    assert one(spark, X.cjk_share, "") == 0 and one(spark, X.cjk_share, "漢㐀豈a") == 0.75
    assert one(spark, X.code_tokens, "") == [] and one(spark, X.code_tokens, "./src/HTTPServer2Go.rs") == ["src/httpserver2go.rs", "src", "httpserver2go", "http", "server2", "go", "rs"]
    assert one(spark, lambda v: X.slug(v, "entry"), "--") == one(spark, lambda v: X.slug(v, "entry"), None) == "entry"
    for a, b, want in (("1.2", "1.2.0", 0), ("1.10", "1.9", 1), ("v1.x.2", "1.3", -1), ("", "0.1", -1)):
        assert one(spark, lambda v, b=b: X.version_order(v, F.lit(b)), a) == want
    assert one(spark, lambda v: X.path_excluded(v, "./node/*"), "a/node/b") and not one(spark, lambda v: X.path_excluded(v, "node"), "a/nodes/b")
    assert one(spark, lambda v: X.glob_excluded(v, []), "a/b") is False and one(spark, lambda v: X.glob_excluded(v, ["*.tmp"]), "a/b.tmp/c") is True


def test_operators_on_odd_rows_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, None, "p"), (2, "", "p"), (3, "one\n\n# two\nthree", "q"), (None, "# x", None)], "doc_id long, text string, path string")
    assert {(r.doc_id, r.section, r.start_line, r.end_line) for r in U.heading_chunks(docs, 3, 1).collect()} == {(3, 0, 1, 2), (3, 1, 3, 4), (None, 0, 1, 1)}
    assert len(U.split_blobs(docs, 2).collect()) == 4
    assert len(R.line_windows(docs, 3, 1).collect()) == 3 and R.grep(docs, "two").count() == 1
    entries = spark.createDataFrame([(1, "a", "red fox"), (2, "a", "red fix"), (3, "a", None), (4, "b", "red fox"), (5, "a", "blue sky")], "id long, category string, text string")
    assert {(r.a, r.b) for r in N.pairs_above(entries, 0.6).collect()} == {(1, 2)}
    assert {(r.id, r.kept) for r in N.greedy(entries, 0.6).collect()} == {(1, True), (2, False), (3, True), (4, True), (5, True)}
    assert [(r.id, r.group, r.keep) for r in N.cleanup(entries, 0.6).orderBy("id").collect()] == [(1, 1, True), (2, 1, False)]
    asked = spark.createDataFrame([(1, "a", "RED FOX!"), (2, "a", "zzz"), (3, "c", "red fox")], "query_id long, category string, text string")
    assert {(r.query_id, r.outcome, r.id) for r in N.upsert_outcome(asked, entries, 0.7).collect()} == {(1, "ignored", 1), (2, "added", None), (3, "added", None)}
    for call in (lambda t: U.heading_chunks(t, 3, 1), lambda t: U.split_blobs(t, 2), lambda t: R.line_windows(t, 3, 1), lambda t: U.matching_lines(t, ["a"], 2)):
        assert call(docs.limit(0)).collect() == []
    for call in (lambda t: N.cleanup(t, 0.6), lambda t: N.greedy(t, 0.6), lambda t: N.pairs_above(t, 0.6)):
        assert call(entries.limit(0)).collect() == []


def test_files_of_several_encodings(spark, tmp_path):
    texts = {"a.txt": "plain é 漢".encode(), "b.txt": "简体中文文本".encode("gbk"), "c.txt": b"caf\xe9 \x93x\x94", "d.bin": b"a\x00b", "e.txt": b""}
    for name, data in texts.items():
        (tmp_path / name).write_bytes(data)
    got = {r.path.rsplit("/", 1)[1]: r.text for r in files.text_files(spark, str(tmp_path)).collect()}
    assert got == {"a.txt": "plain é 漢", "b.txt": "简体中文文本", "c.txt": "café “x”"}  # Spark does not read empty files
    (tmp_path / "t.csv").write_text('id,name\n1,"a ""b"""\n2\n')
    assert [tuple(r) for r in files.csv_table(spark, str(tmp_path / "t.csv")).collect()] == [("1", 'a "b"'), ("2", None)]
    (tmp_path / "back.json").write_text(json.dumps({"id": 1}) + "\nnot json\n")
    assert [r.id for r in files.json_or_backup(spark, str(tmp_path / "gone.json"), str(tmp_path / "back.json"), "id long").collect()] == [1]
    assert one(spark, files.front_matter, "---\nname: 'x y'\nn: 2\n---\nbody: no") == {"name": "x y", "n": "2"} and one(spark, files.front_matter, "name: x") == {}


def test_a_corrupt_file_gives_way_to_its_backup(spark, tmp_path):
    main, back = tmp_path / "main.json", tmp_path / "back.json"
    read = lambda **more: [r.id for r in files.json_or_backup(spark, str(main), str(back), "id long, name string", **more).collect()]
    back.write_text('{"id": 1}\n{"id": 2, "name": "b"}\n')
    for text, want in (('{"id": 7}\n\n{"name": null}\n', [7, None]), ('{"id": 7}\n{"id": 8', [1, 2]), ("junk", [1, 2]), ("", [])):
        main.write_text(text)
        assert read() == want, text
    main.write_text("junk")
    for text in ("more junk\n{", None):
        back.write_text(text) if text else back.unlink()
        assert read(default=True) == []
        with pytest.raises(ValueError, match="can be read"):
            read()


def test_streamed_sessions_equal_the_batch_form(spark, tmp_path):
    times = {"a": [0, 10, 20, 100, 130, 160, 190, 220, 400], "b": [5], "c": [0, 29, 58, 87, 300, 301]}
    rows = [(k, datetime(2024, 1, 1) + timedelta(seconds=t)) for k, ts in times.items() for t in ts]
    table = spark.createDataFrame(rows, "key string, ts timestamp")
    batch = {(r.key, r.first_ms, r.last_ms, r.n_events, r.reason) for r in sessions.capped_sessions_batch(table, 30_000, 60_000).collect()}
    for i, part in enumerate((F.col("ts") < "2024-01-01 00:01:45", F.col("ts") >= "2024-01-01 00:01:45")):
        table.where(part).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    query = sessions.capped_sessions(stream, 30_000, 60_000).writeStream.outputMode("append").format("memory").queryName("capped").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = {(r.key, r.first_ms, r.last_ms, r.n_events, r.reason) for r in spark.table("capped").collect()}
    assert {x[4] for x in batch} == {"quiet", "max_wait", "open"}
    assert {x for x in batch if x[4] == "max_wait"} <= got and {x[:4] for x in got} <= {x[:4] for x in batch}
    assert {x[:4] for x in batch if x[4] != "open"} <= {x[:4] for x in got}


def test_log_tail(spark, tmp_path):
    (tmp_path / "logs").mkdir()
    (tmp_path / "logs" / "a.log").write_text("2024-01-01 10:00 [INFO] [core] started\nnoise\n2024-01-01 10:01 [ERROR] [io] [x] failed\n")
    query = sessions.log_tail(spark, str(tmp_path / "logs")).writeStream.format("memory").queryName("tail").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted((r.level, r.module, r.message) for r in spark.table("tail").collect()) == [("ERROR", "io", "[x] failed"), ("INFO", "core", "started")]


def test_search_functions_on_odd_texts(spark):
    for f in (X.query_terms, X.markdown_tokens, X.fnv1a64, X.stem, X.answer_files, lambda v: X.grams(v, 1), lambda v: X.grams(v, 2)):
        assert one(spark, f, None) is None
    assert one(spark, X.query_terms, "") == one(spark, X.markdown_tokens, "a 中 !") == one(spark, X.answer_files, "none") == []
    assert one(spark, lambda v: X.grams(v, 2), "a𝄞é") == ["a𝄞", "𝄞é"] and one(spark, lambda v: X.grams(v, 3), "ab") == []
    assert one(spark, X.code_tokens, "如何x数据库") == ["如何", "x", "数据库", "数据", "据库"]
    assert one(spark, X.query_terms, "the 数据库表 getUser 如何 a 码") == ["getuser", "get", "user", "数据", "据库", "库表", "数据库", "据库表", "数据库表", "码"]
    assert one(spark, X.markdown_tokens, "A UI-card 数据库 card") == ["ui", "card", "数据", "据库"]
    for text, want in (("", "cbf29ce484222325"), ("a", "af63dc4c8601ec8c"), ("foobar", "85944171f73967e8")):
        assert one(spark, X.fnv1a64, text) == want
    for token, want in (("kindness", "kind"), ("glass", None), ("classes", "class"), ("tables", "tabl"), ("ening", None), ("café", None), ("used", None), ("cafés", None)):
        assert one(spark, X.stem, token) == want
    text = '<file path="/codebase/a\\b.rs">\n<range>0-3</range><range>9-4</range></file><file path=\'../x\'></file><file path="/etc"></file><file path="c"></file>'
    assert [(f.path, [tuple(r) for r in f.ranges]) for f in one(spark, X.answer_files, text)] == [("a/b.rs", [(1, 3), (9, 9)]), ("c", [])]


def test_searches_on_odd_rows_and_empty_tables(spark):
    files = spark.createDataFrame([("src/auth.rs", "fn login_user() {}\n"), ("src/db.rs", "open\nclose"), ("a.rs", None), ("b.rs", ""), ("src/db.rs", "open\nclose"), (None, "login")], "path string, text string")
    asked = spark.createDataFrame([(1, "login user"), (2, None), (3, ""), (4, "open"), (5, "zzz")], "item_id long, text string")
    found = Q.code_search(Q.code_chunks(files), asked, 3).collect()
    assert {(r.item_id, r.path, r["rank"], r.covered) for r in found} == {(1, "src/auth.rs", 1, 2), (4, "src/db.rs", 1, 1)}
    notes = spark.createDataFrame([(1, "# Blue\nsky\n## Left\nblue card"), (2, None), (3, ""), (4, "blue card"), (4, "blue card")], "doc_id long, text string")
    got = Q.markdown_search(notes, " Blue CARD ", 9, left_out=("Left",), title="t").orderBy("rank").collect()
    assert [(r.doc_id, r.start_line) for r in got] == [(4, 1), (4, 1), (1, 1)] and got[0].score == 8.0
    assert Q.markdown_search(notes, "", 9).count() == Q.markdown_search(notes.limit(0), "x", 9).count() == 0
    assert Q.code_search(Q.code_chunks(files.limit(0)), asked, 3).count() == Q.code_search(Q.code_chunks(files), asked.limit(0), 3).count() == 0
