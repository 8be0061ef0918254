"""Stored postings: rounds of changes against an index built anew, versions, failed syncs and odd rows."""

import random

import pytest
from pyspark.sql import functions as F

from corpusloom.functions.text import bm25_tokens
from corpusloom.operators import retrieval as R
from corpusloom.operators import search as Q
from corpusloom.operators.postings import PostingStore, whole_files

SHAPE = "path string, modified long, size long, text string"


def store(spark, folder, units=whole_files):
    return PostingStore(spark, f"file://{folder}", units, lambda: bm25_tokens(F.col("content")) if units is whole_files else Q.search_text())


def rows(frame):
    return sorted(map(tuple, frame.collect()), key=str)


def test_rounds_equal_a_rebuild(spark, tmp_path):
    rng, words = random.Random(4), ["alpha", "beta", "gammaRay", "delta_one", "漢字検索", "common"]
    files = {f"src/f{k}.rs": (1, "common words here " + rng.choice(words)) for k in range(12)} | {"null.md": (1, None), "empty.md": (1, "")}
    own, states = store(spark, tmp_path / "a"), []
    for round_ in range(2, 4):
        snap = spark.createDataFrame([(p, m, len(t or ""), t) for p, (m, t) in files.items()], SHAPE)
        got = {r.path: r.state for r in own.sync(snap).collect()}
        states.append(got)
        fresh = store(spark, tmp_path / f"fresh{round_}")
        fresh.sync(snap)
        columns = ("term", "path", "start_line", "end_line", "tf", "dl")
        assert rows(own.postings().select(*columns)) == rows(fresh.postings().select(*columns))
        assert rows(own.size()) == rows(fresh.size()) and rows(own.contents()) == rows(fresh.contents())
        asked = spark.createDataFrame([(1, "common gammaray"), (2, None), (3, "nowhere")], "item_id long, text string")
        plain = R.bm25(snap.select(F.col("path").alias("doc_id"), "text"), asked, 5)
        assert rows(R.bm25_stored(own, asked, 5)) == rows(plain)
        files = {p: v for p, v in files.items() if p != f"src/f{round_}.rs"} | {f"src/f{round_ + 5}.rs": (round_, f"edited {rng.choice(words)}"), f"new{round_}.rs": (round_, "common alpha")}
    assert set(states[0].values()) == {"new"} and states[1]["src/f2.rs"] == "stale" and states[1]["src/f7.rs"] == "changed" and states[1]["new2.rs"] == "new" and states[1]["null.md"] == "unchanged"
    assert own.version() == 2 and own.files(1).count() == 14  # an older version still reads


def test_only_changed_files_are_tokenised(spark, tmp_path):
    own = store(spark, tmp_path)
    own.sync(spark.createDataFrame([("a", 1, 5, "first text"), ("b", 1, 5, "second text")], SHAPE))
    own.sync(spark.createDataFrame([("a", 1, 5, "other words under the same metadata"), ("b", 2, 5, "third text")], SHAPE))
    assert rows(spark.read.parquet(f"{own.folder}/units/gen=2").select("path")) == [("b",)]
    assert {r.term for r in own.postings().collect()} == {"first", "text", "third"}


def test_a_failed_sync_leaves_the_last_version(spark, tmp_path):
    own = store(spark, tmp_path)
    own.sync(spark.createDataFrame([("a", 1, 5, "first text")], SHAPE))
    broken = spark.createDataFrame([("a", 2, 5, "changed text"), ("b", 1, 5, "new text")], SHAPE)
    failing = PostingStore(spark, own.folder, whole_files, lambda: F.array(F.raise_error(F.lit("stopped")).cast("string")))
    with pytest.raises(Exception, match="stopped"):
        failing.sync(broken)
    assert own.version() == 1 and {r.term for r in own.postings().collect()} == {"first", "text"}
    own.sync(broken)
    assert own.version() == 2 and {r.term for r in own.postings().collect()} == {"changed", "new", "text"}
    own.sync(broken.limit(0))
    assert own.postings().collect() == [] and own.size().first().n == 0


def test_stored_code_search_reads_the_index(spark, tmp_path):
    own = store(spark, tmp_path, Q.code_chunks)
    texts = [(f"src/m{k}.rs", 1, 9, "\n".join(f"fn handleRequest{k}(x{j}) // line" for j in range(100 * (k == 3) + 2))) for k in range(6)]
    snap = spark.createDataFrame(texts, SHAPE)
    own.sync(snap)
    asked = spark.createDataFrame([(1, "handleRequest3"), (2, "request m1.rs"), (3, "")], "item_id long, text string")
    assert rows(Q.code_search_stored(own, asked, 4)) == rows(Q.code_search(Q.code_chunks(snap), asked, 4))
    assert all(f.startswith(own.folder.removesuffix("/")) for f in Q.code_search_stored(own, asked, 4).inputFiles())


def test_postings_are_written_and_read_without_a_shuffle(spark, tmp_path):
    own = store(spark, tmp_path)
    first = [(f"f{k}.rs", 1, 5, f"common word{k} common") for k in range(200)] + [("null.md", 1, 0, None)]
    own.sync(spark.createDataFrame(first, SHAPE).repartition(3))
    own.sync(spark.createDataFrame([(p, 2 if k % 3 == 0 else 1, n, f"later {t}" if k % 3 == 0 else t) for k, (p, _, n, t) in enumerate(first) if k % 5], SHAPE).repartition(2))
    found = own.postings()
    assert "path" not in "".join(x for x in found._jdf.queryExecution().executedPlan().toString().split("\n") if "Exchange hash" in x and "term" in x)
    assert "MapInArrow" not in found._jdf.queryExecution().executedPlan().toString()
    want = {(t, p, sum(x == t for x in own_), len(own_)) for k, (p, _, _, text) in enumerate(first) if k % 5 and text for own_ in [(f"later {text}" if k % 3 == 0 else text).split()] for t in own_}
    assert {(r.term, r.path, r.tf, r.dl) for r in found.collect()} == want
    asked = spark.createDataFrame([("common",), ("later",), ("nowhere",)], "term string")
    assert {(r.term, r.path, r.tf, r.dl) for r in own.postings(asked).collect()} == {x for x in want if x[0] in ("common", "later")}
    # a unit has a row for each bucket of its terms, not one for each term
    assert spark.read.parquet(f"{own.folder}/postings/gen=1").count() < sum(len(set((t or "").split())) for _, _, _, t in first) + 1
    assert {r.path: (r.units, r.tokens) for r in own.files().collect()}["f1.rs"] == (1, 3)


def test_code_search_where_chunks_lie_equals_joins(spark, monkeypatch):
    rng = random.Random(9)
    words = ["alpha", "betaRay", "gamma_x", "delta", "fn", "漢字検索", "zeta.rs"]
    files = spark.createDataFrame([(f"src/{k % 7}/m{k}.rs", "\n".join(" ".join(rng.choices(words[k % 4 :], k=4)) for _ in range(rng.choice([1, 90, 200])))) for k in range(120)] + [("empty.rs", ""), ("null.rs", None)], "path string, text string").repartition(3)
    asked = spark.createDataFrame([(1, "alpha beta"), (2, "gamma_x zeta"), (3, "検索 delta"), (4, ""), (5, "nowhere"), (6, "fn m7.rs"), (7, None)], "item_id int, text string")
    chunks, seen, plain = Q.code_chunks(files), [], Q._ranked_where_they_lie
    monkeypatch.setattr(Q, "_ranked_where_they_lie", lambda *a: seen.append(1) or plain(*a))
    twice = chunks.unionByName(chunks.where("path like '%m1%'"))
    here, joined = [rows(Q.code_search(x, q, 3)) for x in (chunks, twice) for q in (asked, asked.limit(0))], []
    assert len(seen) == 2  # a path that comes again is joined
    monkeypatch.setattr(Q, "ITEMS", -1)
    joined = [rows(Q.code_search(x, q, 3)) for x in (chunks, twice) for q in (asked, asked.limit(0))]
    assert here == joined and len(here[0]) > 9 and len(seen) == 2
