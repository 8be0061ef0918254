"""Widening, voting and the similarity tier on odd rows, against plain Python."""

import random

from pyspark.sql import functions as F

from corpusloom.functions.text import bm25_tokens, stem
from corpusloom.operators import expansion as E
from corpusloom.plans import expansion as plans


def test_terms_against_plain_python(spark):
    rng = random.Random(2)
    d = plans.dictionaries(spark)
    words = ["red", "RED", "t gear", "hot gear", "漢字", "ring", "large", "running", "old an", "red漢字", "!", "new-ring"]
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 5))) for _ in range(60)] + [None, ""]
    queries = spark.createDataFrame(list(enumerate(texts)), "item_id int, text string")
    tokens = {r.item_id: r for r in queries.select("item_id", bm25_tokens(F.col("text")).alias("t"), F.transform(bm25_tokens(F.col("text")), lambda x: stem(x)).alias("s")).collect()}
    for most in (32, 2):
        for r in E.expanded_terms(queries, d["signals"], d["phrases"], d["synonyms"], most).collect():
            text = texts[r.item_id]
            low = "".join(c if c.isascii() and c.isalnum() else " " for c in (text or "").lower()).split()
            first = {t for w, t in plans.SIGNALS if w in low} | {t for p, t in plans.PHRASES if text and p in text}
            own = set(tokens[r.item_id].t or [])
            want = sorted(first | {t for w, t in plans.SYNONYMS if w in first | own} | {s for s in tokens[r.item_id].s or [] if s}, key=lambda s: s.encode())[:most]
            assert list(r.terms) == want and r.expanded == (f"{text} {' '.join(want)}" if want else text)


def test_votes(spark):
    d = plans.dictionaries(spark)
    queries = spark.createDataFrame([(1, "HOT thing"), (2, "old plate bolt"), (3, "bolt small"), (4, None), (5, "nothing"), (6, "漢字 bolt bolt"), (7, "hot gizmo")], "item_id int, text string")
    got = {r.item_id: r.domain for r in E.domain_vote(queries, d["hints"], d["keywords"], d["domains"], "ECONOMY").collect()}
    # equal counts go by the order of the domains
    assert got == {1: "PROMO", 2: "LARGE", 3: "MEDIUM", 4: "ECONOMY", 5: "ECONOMY", 6: "SMALL", 7: "PROMO"}
    none = d["hints"].limit(0)
    assert {r.domain for r in E.domain_vote(queries, none, none, d["domains"], "x").collect()} == {"x"}


def test_only_queries_without_hits_are_compared(spark, monkeypatch):
    rows = spark.createDataFrame([("a", 1, "small ring", "small ring"), ("a", 2, "large anvil", "large anvil"), ("a", 3, "", " "), ("b", 4, "ringo", "ringo"), ("a", 5, None, None)], "domain string, row_id int, text string, short string")
    queries = spark.createDataFrame([(1, "a", "ring"), (2, "a", "rinng"), (3, "a", "qqqq"), (4, "b", "anvil"), (5, "a", None), (6, "b", "ring")], "item_id int, domain string, text string")
    asked = []
    plain = E.fuzzy_matches
    monkeypatch.setattr(E, "fuzzy_matches", lambda r, q, k: asked.extend(x.item_id for x in q.collect()) or plain(r, q, k))
    first = E.bm25_of_domain(rows, queries, 2)
    got = sorted((r.item_id, r.row_id, r.tier) for r in E.with_fallback(first, rows, queries, 2).collect())
    assert sorted(asked) == [2, 3, 4, 5, 6]
    assert got == [(1, 1, "terms"), (2, 1, "similarity"), (6, 4, "similarity")]
    assert plain(rows.limit(0), queries, 2).collect() == [] and plain(rows, queries.limit(0), 2).collect() == []


def test_similarity_keeps_what_is_near_the_best(spark):
    rows = spark.createDataFrame([("a", k, t, t) for k, t in enumerate(["gear", "gears", "geer", "gexx", "anvil", "gear"])], "domain string, row_id int, text string, short string")
    queries = spark.createDataFrame([(1, "a", "gearr"), (2, "a", "zzz")], "item_id int, domain string, text string")
    got = E.fuzzy_matches(rows, queries, 10).orderBy("rank").collect()
    assert {r.item_id for r in got} == {1} and got[0].score >= E.BEST
    assert all(r.score >= max(E.NEAR_BEST * got[0].score, E.LEAST) for r in got) and 4 not in {r.row_id for r in got}
    assert [r["rank"] for r in got] == list(range(1, len(got) + 1))


def test_keyword_set(spark):
    rows = spark.createDataFrame([("The quick", None), ("of quick-fox", "ÉTÉ ab"), (None, None)], "x string, y string")
    assert sorted(r.token for r in E.keyword_set(rows, ["x", "y"], ("the",)).collect()) == ["fox", "quick", "été"]


def test_texts_that_repeat_are_worked_out_once(spark, monkeypatch):
    names = ["small ring", "large anvil", "old gear", "rinng", "gearr", "", None]
    rows = spark.createDataFrame([("PROMO" if k % 2 else "ECONOMY", k, n, n) for k, n in enumerate(names[:3] * 200)], "domain string, row_id int, text string, short string")
    queries = spark.createDataFrame([(k, names[k % 7]) for k in range(700)], "item_id int, text string")
    seen, plain = [], E._best_rows
    monkeypatch.setattr(E, "_best_rows", lambda texts, own, k: seen.append(texts.count()) or plain(texts, own, k))
    d = plans.dictionaries(spark)
    got = sorted(map(tuple, E.domain_search(rows, queries, d, "ECONOMY", 4).select("item_id", "domain", "row_id", "rank").collect()))
    # at most five texts meet three texts in each of two domains, whatever the copies
    assert len(seen) == 2 and max(seen) <= 5 * 3
    copies = {n: [k for k in range(600) if names[k % 3] == n] for n in names[:3]}
    want = []
    for item in range(700):
        text = names[item % 7]
        domain, hit = {"small ring": ("PROMO", "small ring"), "rinng": ("ECONOMY", "small ring"), "large anvil": ("ECONOMY", "large anvil"), "old gear": ("LARGE", None), "gearr": ("ECONOMY", "old gear")}.get(text, (None, None))
        want += [(item, domain, k, r) for r, k in enumerate([k for k in copies[hit] if k % 2 == (domain == "PROMO")][:4], 1)] if hit else []
    assert got == want
