"""Search in a catalogue of part names by domains, and its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.operators import expansion as E
from corpusloom.plans.likeness import scored_ctes
from corpusloom.sources.tables import table

_C = F.col
K = 3
SIGNALS = [("red", "crimson"), ("red", "large"), ("new", "modern")]
PHRASES = [("t gear", "cog"), ("d an", "iron"), ("漢字", "glyph"), ("blue", "large")]
SYNONYMS = [("large", "big"), ("large", "widget"), ("ring", "loop"), ("cog", "gear"), ("iron", "anvil")]
HINTS = [("Hot", "PROMO"), ("gizmo", "LARGE"), ("漢字", "SMALL"), ("ring", "PROMO")]
KEYWORDS = [("bolt", "MEDIUM"), ("old", "LARGE"), ("plate", "LARGE"), ("small", "STANDARD"), ("new", "MEDIUM")]
DOMAINS = ["ECONOMY", "SMALL", "MEDIUM", "PROMO", "STANDARD", "LARGE"]


def dictionaries(spark):
    own = {"signals": (SIGNALS, "word string, term string"), "phrases": (PHRASES, "phrase string, term string"), "synonyms": (SYNONYMS, "word string, term string"), "hints": (HINTS, "phrase string, domain string"), "keywords": (KEYWORDS, "phrase string, domain string"), "domains": ([(d, k) for k, d in enumerate(DOMAINS)], "domain string, pos int")}
    return {name: spark.createDataFrame(*x) for name, x in own.items()}


def asked(spark, sf):
    """Part names as queries; a third is misspelt, some have a word of another script."""
    n = _C("p_partkey")
    text = F.when(n % 3 == 1, F.translate("p_name", "aeilo", "eaoli")).when(n % 7 == 0, F.concat(F.initcap("p_name"), F.lit(" 漢字"))).otherwise(_C("p_name"))
    return table(spark, sf, "part").select(n.alias("item_id"), text.alias("text"))


def rows(spark, sf):
    """A catalogue: each part in the domain of its type."""
    return table(spark, sf, "part").select(_C("p_type").alias("domain"), _C("p_partkey").alias("row_id"), F.concat_ws(" ", "p_name", "p_brand", F.translate("p_name", "aeiou", "aaaaa")).alias("text"), _C("p_name").alias("short"))


def _d(spark):
    return dictionaries(spark)


def _expanded(spark, sf):
    d = _d(spark)
    return E.expanded_terms(asked(spark, sf), d["signals"], d["phrases"], d["synonyms"], 4).select("item_id", F.array_join("terms", " ").alias("terms"), "expanded")


def _vote(spark, sf):
    d = _d(spark)
    return E.domain_vote(asked(spark, sf), d["hints"], d["keywords"], d["domains"], "ECONOMY")


def _values(rows_: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows_)


_ASKED = "q AS (SELECT p_partkey AS item_id, CASE WHEN p_partkey % 3 = 1 THEN translate(p_name, 'aeilo', 'eaoli') WHEN p_partkey % 7 = 0 THEN upper(p_name[1]) || substr(split_part(p_name, ' ', 1), 2) || ' ' || upper(split_part(p_name, ' ', 2)[1]) || substr(split_part(p_name, ' ', 2), 2) || ' 漢字' ELSE p_name END AS text FROM part)"
_TOKENS = "list_filter(string_split({0}, ' '), lambda x: strlen(x) > 2)"
_STEMS = " ".join(f"WHEN ends_with(token, '{e}') AND length(token) > {len(e) + 2} THEN substr(token, 1, length(token) - {len(e)})" for e in X.ENDINGS)
_WIDE = f"""sig(word, term) AS (VALUES {_values(SIGNALS)}), phr(phrase, term) AS (VALUES {_values(PHRASES)}), syn(word, term) AS (VALUES {_values(SYNONYMS)}),
f AS (SELECT item_id, term FROM q JOIN sig ON list_contains(regexp_extract_all(lower(text), '[a-z0-9]+'), word) UNION SELECT item_id, term FROM q JOIN phr ON contains(text, phrase)),
tok AS (SELECT DISTINCT item_id, unnest({_TOKENS.format("lower(text)")}) AS token FROM q),
st AS (SELECT item_id, CASE WHEN strlen(token) > length(token) OR length(token) <= 4 THEN NULL {_STEMS} WHEN ends_with(token, 'es') AND length(token) > 5 THEN substr(token, 1, length(token) - 2) WHEN ends_with(token, 's') AND NOT ends_with(token, 'ss') AND length(token) > 5 THEN substr(token, 1, length(token) - 1) END AS term FROM tok),
a AS (SELECT * FROM f UNION SELECT f.item_id, syn.term FROM f JOIN syn ON f.term = word UNION SELECT item_id, syn.term FROM tok JOIN syn ON token = word UNION SELECT * FROM st WHERE term IS NOT NULL),
wide AS (SELECT item_id, text, t.terms, text || coalesce(' ' || t.terms, '') AS expanded FROM q LEFT JOIN (SELECT item_id, string_agg(term, ' ' ORDER BY term) AS terms FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY term) AS n FROM a) WHERE n <= {{most}} GROUP BY item_id) t USING (item_id))"""
_VOTE = f"""hint(phrase, domain) AS (VALUES {_values(HINTS)}), kw(phrase, domain) AS (VALUES {_values(KEYWORDS)}), dom(domain, pos) AS (VALUES {_values([(d, k) for k, d in enumerate(DOMAINS)])}),
hits AS (SELECT item_id, 0 AS tier, domain FROM q JOIN hint ON contains(lower(text), lower(phrase)) UNION ALL SELECT item_id, 1, domain FROM q JOIN kw ON contains(lower(text), phrase)),
cnt AS (SELECT item_id, tier, domain, count(*) AS n FROM hits GROUP BY ALL),
vote AS (SELECT q.item_id, coalesce(b.domain, 'ECONOMY') AS domain FROM q LEFT JOIN (SELECT item_id, domain FROM cnt JOIN dom USING (domain) QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY tier, n DESC, pos) = 1) b ON b.item_id = q.item_id)"""
_CATALOGUE = "cat AS (SELECT p_type AS domain, p_partkey AS row_id, p_name AS short, string_split(lower(p_name || ' ' || replace(p_brand, '#', ' ') || ' ' || translate(p_name, 'aeiou', 'aaaaa')), ' ') AS w FROM part), doc AS (SELECT domain, row_id, short, list_filter(w, lambda x: strlen(x) > 2) AS t FROM cat)"
_PAIRS = "SELECT {'t': text, 'p': part} AS key, text AS a, part AS b FROM (SELECT DISTINCT text, part FROM lost JOIN parts USING (domain))"
_SEARCHED = f"""{_ASKED}, {_WIDE.format(most=32)}, {_VOTE}, {_CATALOGUE},
size AS (SELECT domain, count(*) AS n, avg(len(t)) AS avgdl FROM doc GROUP BY domain),
post AS (SELECT domain, row_id, any_value(dl) AS dl, token, count(*) AS tf FROM (SELECT domain, row_id, len(t) AS dl, unnest(t) AS token FROM doc) GROUP BY domain, row_id, token),
df AS (SELECT domain, token, count(*) AS df FROM post GROUP BY ALL),
term AS (SELECT item_id, domain, token, count(*) AS times FROM (SELECT item_id, domain, unnest({_TOKENS.format("lower(expanded)")}) AS token FROM wide JOIN vote USING (item_id)) GROUP BY ALL),
sc AS (SELECT item_id, domain, row_id, round(sum(times * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM post JOIN df USING (domain, token) JOIN size USING (domain) JOIN term USING (domain, token) GROUP BY ALL),
one AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, row_id) AS rank, 'terms' AS tier FROM sc QUALIFY rank <= {K}),
lost AS (SELECT item_id, text, domain FROM q JOIN vote USING (item_id) WHERE item_id NOT IN (SELECT item_id FROM one)),
parts AS (SELECT DISTINCT domain, part FROM (SELECT domain, unnest([short] || string_split(short, ' ')) AS part FROM cat) WHERE strlen(part) > 2),
{scored_ctes(_PAIRS)},
sim AS (SELECT key.t AS text, key.p AS part, round(greatest(mixed, contained, bigrams), 6) AS sim FROM m),
own AS (SELECT DISTINCT domain, row_id, unnest([short] || string_split(short, ' ')) AS part FROM cat),
best AS (SELECT item_id, domain, row_id, max(sim) AS score FROM lost JOIN own USING (domain) JOIN sim USING (text, part) GROUP BY ALL),
near AS (SELECT *, max(score) OVER (PARTITION BY item_id) AS top FROM best),
two AS (SELECT item_id, domain, row_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, row_id) AS rank, 'similarity' AS tier FROM near WHERE top >= 0.5 AND score >= greatest(0.75 * top, 0.35) QUALIFY rank <= {K})"""

QUERIES = {
    "expanded_terms": (_expanded, f"WITH {_ASKED}, {_WIDE.format(most=4)} SELECT item_id, coalesce(terms, '') AS terms, expanded FROM wide"),
    "domain_vote": (_vote, f"WITH {_ASKED}, {_VOTE} SELECT item_id, domain FROM vote"),
    "keyword_set": (
        lambda s, d: E.keyword_set(table(s, d, "part"), ["p_name", "p_type", "p_brand"], ("new", "old")),
        "SELECT DISTINCT token FROM (SELECT unnest(string_split(lower(p_name || ' ' || p_type || ' ' || replace(p_brand, '#', ' ')), ' ')) AS token FROM part) WHERE strlen(token) > 2 AND token NOT IN ('new', 'old')",
    ),
    "domain_search": (
        lambda s, d: E.domain_search(rows(s, d), asked(s, d), _d(s), "ECONOMY", K),
        f"WITH {_SEARCHED} SELECT item_id, domain, row_id, score, rank, tier FROM one UNION ALL SELECT * FROM two",
    ),
    "fuzzy_fallback": (
        lambda s, d: E.domain_search(rows(s, d), asked(s, d), _d(s), "ECONOMY", K).where("tier = 'similarity'").drop("tier"),
        f"WITH {_SEARCHED} SELECT item_id, domain, row_id, score, rank FROM two",
    ),
}
