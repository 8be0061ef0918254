"""Ranked search and the source audit against plain Python versions, on odd rows, ties and skew."""

import math
import random
import re
from collections import Counter, defaultdict

import pandas as pd

from corpusloom.llm import divergence, lexsearch

WORD, LETTER = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text, pattern):
    return re.findall(pattern, (text or "").translate(LOWER))


def ranked(docs, items, k):
    own = [(i, Counter(terms(t, WORD))) for i, t in docs]
    big_n, big_l = sum(1 for _, c in own if c), sum(sum(c.values()) for _, c in own)
    df = Counter(t for _, c in own for t in c)
    out = []
    for item, asked in items.items():
        scores = []
        for i, c in own:
            n, score = sum(c.values()), 0
            for t, times in asked.items():
                if c[t]:
                    w = math.floor(1000 * math.log((2.0 * big_n + 2) / (2.0 * df[t] + 1)))
                    score += times * w * ((10**9 * c[t]) // (1000 * c[t] + 8 * (25 + 75 * n * big_n // big_l)))
            if score > 0:
                scores.append((-score, i is None, i))
        out += [(item, r, i, -s) for r, (s, _, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def some_docs(seed, n):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(40)] + ["Été", "漢字", "don't", "A-b", "x_1"]
    rows = [(k, " ".join(rng.choice(words) for _ in range(rng.randint(0, 30)))) for k in range(n)]
    return rows + [(n, None), (n + 1, ""), (n + 2, "--- !!"), (n + 3, "w1 " * 9000), (n + 4, "W1 w2"), (n + 5, "w1 W2"), (None, "w1 w2")]


def test_search_against_brute_force(spark):
    for seed in range(3):
        docs = some_docs(seed, 60)
        items = [(1, "w1 W2 w2 nowhere"), (2, "été 漢字 x_1"), (3, None), (4, "!!"), (None, "w5 w6"), (1, "w7")]
        asked = defaultdict(Counter)
        for i, t in items:
            asked[i].update(terms(t, WORD))
        frame = spark.createDataFrame([(*d, "t", 1) for d in docs], "doc_id long, text string, term string, row int").repartition(4)
        own = lexsearch.item_terms(spark.createDataFrame(items, "item_id long, text string"))
        want = ranked(docs, asked, 10)
        for known in (own, None):  # an index of the asked terms, and of all
            got = lexsearch.search(lexsearch.build_index(frame, known), own, 10)
            assert sorted(map(tuple, got.collect()), key=str) == want


def test_search_in_blocks_and_without_broadcast_terms(spark, monkeypatch):
    docs = spark.createDataFrame(some_docs(5, 50), "doc_id long, text string")
    items = lexsearch.item_terms(spark.createDataFrame([(k, f"w{k} w{k + 1} w{k + 2}") for k in range(30)], "item_id long, text string"))
    want = sorted(map(tuple, lexsearch.search(lexsearch.build_index(docs, items), items, 5).collect()))
    monkeypatch.setattr(lexsearch, "ITEM_ROWS", 20)
    monkeypatch.setattr(lexsearch, "KNOWN_TERMS", 3)
    index = lexsearch.build_index(docs, items)
    assert index.postings.where("term = 'w39'").count() > 0  # all terms are there
    assert sorted(map(tuple, lexsearch.search(index, items, 5).collect())) == want


def test_search_ties_and_empty_tables(spark):
    docs = spark.createDataFrame([(k % 50, "same words") for k in range(200)] + [(99, "other")], "doc_id long, text string").repartition(7)
    items = lexsearch.item_terms(spark.createDataFrame([(1, "words")], "item_id long, text string"))
    got = lexsearch.search(lexsearch.build_index(docs, items), items, 10).toPandas().sort_values("rank")
    assert got.doc_id.tolist() == [0, 0, 0, 0, 1, 1, 1, 1, 2, 2] and got["rank"].tolist() == list(range(1, 11)) and got.score.nunique() == 1
    none = docs.limit(0)
    assert lexsearch.search(lexsearch.build_index(none, items), items, 10).collect() == []
    assert lexsearch.search(lexsearch.build_index(docs, items), items.limit(0), 10).collect() == []


def audited(docs, least, most):
    told = [(lang or "", source or "", terms(t, LETTER)) for t, lang, source in docs]
    groups, counts = sorted({x[:2] for x in told}), defaultdict(Counter)
    df, out = defaultdict(Counter), []
    for lang, source, t in told:
        df[lang].update(set(t))
        counts[lang, source].update(t)
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in df[lang].items() if n >= least]
        sources, v, share = [s for g, s in groups if g == lang], len(kept), {}
        for s in sources:
            n = sum(counts[lang, s][t] for t in kept)
            share[s] = {t: 1 + 10**9 * (counts[lang, s][t] + 1) // (n + v) for t in kept}
        whole = {t: sum(counts[lang, s][t] for s in sources) for t in kept}
        q = {t: 1 + 10**9 * (whole[t] + 1) // (sum(whole.values()) + v) for t in kept}
        far = lambda p, q: (p - q) ** 2 // q
        for s in sources:
            pairs = [(-sum(far(share[s][t], share[o][t]) for t in kept), o.encode(), o) for o in sources if o != s]
            out += [(lang, s, "pair", o, -x, r) for r, (x, _, o) in enumerate(sorted(pairs), 1)]
            own = [(-far(share[s][t], q[t]), t.encode(), t) for t in kept if counts[lang, s][t] and share[s][t] > q[t]]
            out += [(lang, s, "term", t, -x, r) for r, (x, _, t) in enumerate(sorted(own)[:most], 1)]
    return sorted(out)


def test_audit_against_brute_force(spark):
    rng = random.Random(8)
    words = ["aa", "Bb", "été", "漢字", "x1y", "zz'q", "rare"] + [f"w{chr(97 + k)}" for k in range(20)]
    docs = [(" ".join(rng.choices(words, k=rng.randint(0, 12))), rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "ß", None])) for _ in range(90)]
    docs += [(None, "en", "no words"), ("only once here", "fr", "s1"), ("", "fr", None), ("aa " * 20_000, "en", "s1")] + [("aa bb copy", "en", "hot")] * 60
    frame = spark.createDataFrame([(*d, "c") for d in docs], "text string, lang string, source string, term string").repartition(5)
    for least, most in ((3, 200), (1, 4), (1000, 9)):
        got = divergence.audit(frame, least, most)
        assert sorted(map(tuple, got.collect())) == audited(docs, least, most)
    assert divergence.audit(frame.limit(0)).collect() == []


def test_shares_beyond_64_bits(spark):
    n = 9 * 10**15
    own = spark.createDataFrame([(n - 5, n, 7)], "c long, n long, v long")
    assert own.select(divergence.share(*map(own.__getitem__, "cnv"))).first()[0] == 1 + 10**9 * (n - 4) // (n + 7)


def test_queries_cover_all_rows(spark):
    sf = "/root/testdata/sf0.001"
    docs, items = pd.read_parquet(f"{sf}/documents.parquet"), pd.read_parquet(f"{sf}/benchmark.parquet")
    want = ranked(list(zip(docs.doc_id.tolist(), docs.text)), {i: Counter(terms(t, WORD)) for i, t in zip(items.item_id.tolist(), items.text)}, 10)
    assert sorted(map(tuple, lexsearch.op12_lexical_search(spark, sf).collect()), key=str) == want
    assert sorted(map(tuple, divergence.op13_source_divergence(spark, sf).collect())) == audited(list(zip(docs.text, docs.lang, docs.source)), 3, 200)
