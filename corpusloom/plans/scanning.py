"""Scan search over documents, chains of backends, histories and repeated commands, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.operators import scanning as S
from corpusloom.plans.search import _TERMS, _asked, _files
from corpusloom.sources.tables import table

_C = F.col
ORDER = ["view", "click", "error"]


def _scan(spark, sf):
    found = S.scan_search(_files(spark, sf), _asked(spark, sf), 10)
    return found.withColumn("sha256", F.sha2("excerpt", 256)).drop("excerpt")


def _results(spark, sf):
    """Users as items, event types as backends: high values are rows found."""
    e = table(spark, sf, "events")
    return e.where("value > 12").select(_C("user_id").alias("item_id"), _C("event_type").alias("backend"), "event_id")


def _tried(spark, sf):
    pairs = table(spark, sf, "events").select(_C("user_id").alias("item_id"), _C("event_type").alias("backend")).distinct()
    return pairs.withColumn("error", F.when((_C("item_id") % 4 == 1) & (_C("backend") == "view"), "timeout").when((_C("item_id") % 6 == 5) & (_C("backend") != "purchase"), "refused"))


def _ring(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_id", "ts")
    return S.ring_append(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), ["user_id"], ["ts", "event_id"], 20).select("user_id", "event_id", "place")


def _paths(spark, sf):
    n = _C("page_id")
    return table(spark, sf, "pages").select("page_id", F.concat(F.when(n % 4 == 1, "\\\\?\\").when(n % 4 == 2, "//").when(n % 4 == 3, "//?/").otherwise(" C:\\Work/"), F.translate("url", ":?#", "\\\\\\")).alias("path"))


def _repeats(spark, sf):
    e = table(spark, sf, "events")
    return S.repeated_commands(e.select(_C("user_id").alias("session"), F.floor(_C("event_id") / 500).alias("turn"), S.command_key(_C("event_type"), F.array((_C("event_id") % 2).cast("string")), F.array(F.array(F.lit("b"), F.lit("a")))).alias("key")))


_TIERS = """e AS (SELECT DISTINCT user_id AS item_id, event_type AS backend FROM events),
t AS (SELECT item_id, backend, list_position(['view', 'click', 'error'], backend) AS tier, CASE WHEN item_id % 4 = 1 AND backend = 'view' THEN 'timeout' WHEN item_id % 6 = 5 THEN 'refused' END AS error FROM e WHERE backend IN ('view', 'click', 'error')),
r AS (SELECT user_id AS item_id, event_type AS backend, event_id FROM events WHERE value > 12),
w AS (SELECT *, coalesce(error, CASE WHEN backend <> 'error' AND NOT EXISTS (SELECT 1 FROM r WHERE r.item_id = t.item_id AND r.backend = t.backend) THEN 'no results' END) AS why FROM t),
f AS (SELECT item_id, min(tier) FILTER (why IS NULL) AS tier FROM w GROUP BY item_id),
a AS (SELECT f.item_id, w.backend, f.tier FROM f LEFT JOIN w ON w.item_id = f.item_id AND w.tier = f.tier)"""
_V1 = r"lower(replace(trim(path), '\', '/'))"
_V2 = r"lower(rtrim(regexp_replace(replace(trim(path), '\', '/'), '^(//\?/){1,3}', ''), '/'))"

QUERIES = {
    "scan_search": (
        _scan,
        f"""WITH {_TERMS}, f AS (SELECT 'docs/' || lang || '/' || doc_id || '.md' AS path, string_split(regexp_replace(text, '\\r?\\n$', ''), chr(10)) AS l FROM documents WHERE text <> ''),
g AS (SELECT path, l, list_transform(l, lambda x: lower(x)) AS low FROM f),
h AS (SELECT item_id, query, terms, path, l, list_filter(range(1, len(l) + 1), lambda n: len(list_filter(terms, lambda t: contains(low[n], t))) > 0)[1:4][1:2] AS p FROM g, (SELECT item_id, query, terms FROM asked) a),
i AS (SELECT item_id, query, terms, path, l, unnest(p) AS n FROM h),
j AS (SELECT item_id, query, terms, path, greatest(n - 3, 1) AS start_line, least(n + 3, len(l)) AS end_line, array_to_string(l[greatest(n - 3, 1):n + 3], chr(10)) AS x FROM i),
k AS (SELECT DISTINCT item_id, path, start_line, end_line, x, len(list_filter(terms, lambda t: contains(lower(x), t) OR contains(lower(path), t))) AS covered, trim(query) <> '' AND (contains(lower(x), lower(trim(query))) OR contains(lower(path), lower(trim(query)))) AS exact, len(list_filter(terms, lambda t: contains(lower(path), t))) AS path_matches FROM j)
SELECT item_id, path, start_line, end_line, covered, exact, path_matches, sha256(x) AS sha256, row_number() OVER (PARTITION BY item_id ORDER BY covered DESC, exact DESC, path_matches DESC, path, start_line, end_line) AS rank FROM k QUALIFY rank <= 10""",
    ),
    "fallback_chain": (
        lambda s, d: S.first_with_hits(_results(s, d), _tried(s, d), ORDER, "error"),
        f"WITH {_TIERS} SELECT a.item_id, a.backend, CAST(a.tier AS INT) AS tier, coalesce(string_agg(w.backend || ': ' || w.why, '; ' ORDER BY w.tier), '') AS reason FROM a LEFT JOIN w ON w.item_id = a.item_id AND w.why IS NOT NULL AND (a.tier IS NULL OR w.tier < a.tier) GROUP BY ALL",
    ),
    "fallback_answers": (lambda s, d: S.answered(_results(s, d), _tried(s, d), ORDER, "error"), f"WITH {_TIERS} SELECT item_id, backend, event_id FROM r JOIN a USING (item_id, backend)"),
    "merged_answers": (
        lambda s, d: S.answered(_results(s, d), _tried(s, d), ORDER, "error", merge=True),
        "SELECT user_id AS item_id, event_type AS backend, event_id FROM events WHERE value > 12 AND NOT (user_id % 4 = 1 AND event_type = 'view') AND NOT (user_id % 6 = 5 AND event_type <> 'purchase')",
    ),
    "ring_append": (_ring, "SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INT) AS place FROM (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 20)"),
    "older_names": (
        lambda s, d: _paths(s, d).select("page_id", S.history_path(_C("path")).alias("now"), F.array_join(S.older_names(_C("path")), ",").alias("older")),
        rf"""WITH p AS (SELECT page_id, (CASE page_id % 4 WHEN 1 THEN '\\?\' WHEN 2 THEN '//' WHEN 3 THEN '//?/' ELSE ' C:\Work/' END) || translate(url, ':?#', '\\\') AS path FROM pages),
n AS (SELECT page_id, {_V1} AS v1, {_V2} AS v2 FROM p),
x AS (SELECT page_id, v2, CASE WHEN starts_with(v2, '//') THEN '//?/unc/' || ltrim(v2, '/') ELSE '//?/' || v2 END AS long, v1 FROM n),
h AS (SELECT page_id, v2, [substr(sha256(v1), 1, 16), substr(sha256(rtrim(v1, '/')), 1, 16), substr(sha256(long), 1, 16), substr(sha256(long || '/'), 1, 16)] AS a FROM x)
SELECT page_id, v2 AS now, array_to_string(list_filter(a, lambda y, i: y <> substr(sha256(v2), 1, 16) AND list_position(a, y) = i), ',') AS older FROM h""",
    ),
    "repeated_commands": (
        _repeats,
        """WITH c AS (SELECT user_id AS session, event_id // 500 AS turn, event_type || '|' || event_id % 2 || '|a,b' AS key FROM events),
t AS (SELECT session, turn, lag(turn) OVER (PARTITION BY session ORDER BY turn) AS before FROM (SELECT DISTINCT session, turn FROM c))
SELECT session, turn, count(*) AS commands, count(*) FILTER (EXISTS (SELECT 1 FROM c o WHERE o.session = c.session AND o.turn = t.before AND o.key = c.key)) AS repeats FROM c JOIN t USING (session, turn) GROUP BY ALL""",
    ),
}
