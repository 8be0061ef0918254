"""Bounds of similarity, groups over long chains, and cleanup plans on odd rows."""

import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from corpusloom.functions.similarity import best_similarity
from corpusloom.operators import nearness as N
from corpusloom.operators import search as Q


def test_bounds_lose_no_pair(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab cdé漢.") for _ in range(rng.randint(0, 14))) for _ in range(70)]
    texts += [t[: len(t) // 2] + rng.choice(["x", ""]) + t[len(t) // 2 :] for t in texts[:30]] + [texts[0], "", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string").withColumn("category", F.lit("c"))
    a, b = rows.select(F.col("id").alias("a"), F.col("text").alias("x")), rows.select(F.col("id").alias("b"), F.col("text").alias("y"))
    every = a.crossJoin(b).where("a < b").select("a", "b", best_similarity(F.col("x"), F.col("y")).alias("s")).collect()
    for tau in (0.55, 0.7):
        got = {(r.a, r.b): r.score for r in N.pairs_above(rows, tau).collect()}
        assert got == {(r.a, r.b): r.s for r in every if r.s is not None and r.s >= tau} and got


def test_groups_of_long_chains_take_few_rounds(spark, monkeypatch):
    rng, rounds = random.Random(1), []
    order = list(range(200))
    rng.shuffle(order)
    chain = [tuple(sorted(p)) for p in zip(order, order[1:])] + [(1000, 1001), (1001, 1002)]
    plain = N.materialize
    monkeypatch.setattr(N, "materialize", lambda df, label: rounds.append(label) or plain(df, label))
    got = {r.id: r.group for r in N.groups(spark.createDataFrame(chain, "a int, b int")).collect()}
    assert got == {**dict.fromkeys(range(200), 0), 1000: 1000, 1001: 1000, 1002: 1000}
    assert len(rounds) < 30


ENTRIES = [(1, "rule", "red fox", 5), (2, "rule", "red foxx", 9), (3, "rule", "red fox!", 9), (4, "pattern", "red fox", 1), (5, "pattern", None, 1), (6, "rule", "blue sky over it", None), (7, "rule", "blue sky over it", None), (8, "rule", "", 2)]


@pytest.fixture
def entries(spark):
    return spark.createDataFrame([(i, c, t, d and datetime(2024, 1, d)) for i, c, t, d in ENTRIES], "id long, category string, text string, updated timestamp")


def test_previews(spark, entries):
    got = [tuple(r) for r in N.cleanup_preview(entries, 0.8).select("group", "group_rank", "category", "place", "id", "keep").orderBy("group_rank", "place").collect()]
    # equal dates go to the longer text, then to the lesser id; no date is the oldest
    assert got == [(1, 1, "rule", 1, 2, True), (1, 1, "rule", 2, 1, False), (1, 1, "rule", 3, 3, False), (6, 2, "rule", 1, 6, True), (6, 2, "rule", 2, 7, False)]
    across = N.cleanup_preview(entries, 0.8, across=True)
    assert {r.id for r in across.where("group = 1").collect()} == {1, 2, 3, 4} and {r.category for r in across.collect()} == {"mixed"}
    assert N.cleanup_preview(entries, 0.8, ("pattern",)).collect() == [] == N.cleanup_preview(entries.limit(0), 0.8).collect()
    words = spark.createDataFrame([("Rule",), ("偏好",), ("PATTERN",), ("背景",), ("other",), (None,)], "w string").select(N.category_named(F.col("w")).alias("c"))
    assert [r.c for r in words.collect()] == ["rule", "preference", "pattern", "context", "rule", "rule"]


def test_plans_are_applied_or_out_of_date(spark, entries):
    plan = spark.createDataFrame([(1, 2, 1), (1, 2, 2), (1, 2, 3), (2, 6, None), (2, 6, 7)], "group long, keep_id long, delete_id long")
    stay, removed = N.apply_plan(entries, plan)
    assert {r.id for r in stay.collect()} == {2, 4, 5, 6, 8} and {(r.id, r.group) for r in removed.collect()} == {(1, 1), (3, 1), (7, 2)}
    assert N.plan_faults(entries, plan).collect() == []
    late = plan.union(spark.createDataFrame([(3, 99, 98), (3, 99, 99), (4, 1, 97)], plan.schema))
    assert {tuple(r) for r in N.plan_faults(entries, late).collect()} == {(3, 99, "keep"), (3, 98, "delete"), (4, 97, "delete")}
    with pytest.raises(ValueError, match="out of date"):
        N.apply_plan(entries, late)
    assert N.apply_plan(entries, plan.limit(0))[0].count() == len(ENTRIES)


def test_markdown_passes_agree_with_scoring_all(spark):
    rng = random.Random(5)
    words = ["alpha", "beta", "gamma", "alphabet", "漢字", "x"]
    texts = ["\n".join(("## " if rng.random() < 0.2 else "") + " ".join(rng.choices(words, k=4)) for _ in range(rng.randint(1, 40))) for _ in range(12)] + [None, "", "\n\n"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    chunks = Q.heading_sections(docs, 24, 4, "")
    for query in ("alpha beta", "alphb", "", "zzzz", "gamma 漢字"):
        every = chunks.select("doc_id", "start_line", F.round(Q.markdown_score(query, F.col("heading"), F.col("content")), 6).alias("score")).collect()
        want = sorted(((-r.score, r.doc_id, r.start_line) for r in every if r.score > 0))[:5]
        got = Q.markdown_search(docs, query, 5).orderBy("rank").collect()
        assert [(-r.score, r.doc_id, r.start_line) for r in got] == want, query
