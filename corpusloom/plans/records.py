"""Queries over records of projects, outputs, versions and replies, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import records as R
from corpusloom.functions.text import url_path
from corpusloom.sources.tables import table

_C = F.col
WORD = "the"


def projects(spark, sf):
    """Orders as projects; every seventh is stale, every ninth never succeeded."""
    k = _C("o_orderkey")
    state = F.get(F.array(*[F.lit(s) for s in R.STATES if s != "stale"]), (k % 5).cast("int"))
    return table(spark, sf, "orders").select(k, "o_orderpriority", state.alias("state"), F.when(k % 4 != 3, k % 7 == 0).alias("stale"), F.when(k % 9 != 0, _C("o_orderdate").cast("timestamp")).alias("succeeded"), F.concat(F.lit("/w/"), (k % 97).cast("string"), F.lit("/P"), k.cast("string")).alias("root"))


def _sorted(spark, sf, by):
    return projects(spark, sf).orderBy(*R.project_order(by)).limit(60).select("o_orderkey")


def outputs(spark, sf):
    """Pages as outputs of commands, some with warnings, errors or nothing in them."""
    n = _C("page_id") % 8
    text = F.when(n == 0, F.concat(F.lit("Warning: requested path missing\n"), "url")).when(n == 1, "  Hint: requested path missing, look above \n(no matches)").when(n == 2, "Error: file not found: x").when(n == 3, F.concat(F.lit(" \nError: "), "url")).when(n == 4, " (no matches)\n").when(n == 5, "\n \t").otherwise(_C("url"))
    return table(spark, sf, "pages").select("page_id", F.when(_C("page_id") % 16 != 13, text).alias("output"))


def _versions(spark, sf):
    k = _C("o_orderkey")
    part = lambda m, d: F.when(k % 13 == d, "rc").otherwise((k % m).cast("string"))
    return table(spark, sf, "orders").select(k, F.concat_ws(".", part(3, 1), part(4, 2), F.when(k % 2 == 0, part(5, 3))).alias("a"), F.concat_ws(".", part(2, 4), part(4, 2), F.when(k % 3 == 0, part(7, 5))).alias("b"))


def _stamps(spark, sf):
    k = _C("o_orderkey")
    name = F.concat(F.date_format("o_orderdate", "yyyyMMdd-HHmmss"), F.lit("-"), (k % 1500).cast("string"), F.when(k % 6 == 5, ".json").otherwise(".store.json"))
    return table(spark, sf, "orders").select(k, F.when(k % 10 == 0, F.concat(F.lit("2024"), name)).otherwise(name).alias("name"))


def _choices(spark, sf):
    """Replies that choose among the words of a part's name, its type and its brand."""
    k = _C("p_partkey")
    options = F.array(F.split_part("p_name", F.lit(" "), F.lit(1)), F.split_part("p_name", F.lit(" "), F.lit(2)), _C("p_type"), _C("p_brand"))
    choice = F.when(k % 5 == 0, " b, A，b").when(k % 5 == 1, F.concat(F.col("p_type"), F.lit(",c"))).when(k % 5 == 2, "e").when(k % 5 == 3, " , ").otherwise(F.concat(F.lit("x"), F.col("p_type")))
    return table(spark, sf, "part").select(k, F.when(k % 11 != 0, choice).alias("choice"), options.alias("options"))


_PROJECTS = f"""p AS (SELECT o_orderkey, o_orderpriority, {[s for s in R.STATES if s != 'stale']}[o_orderkey % 5 + 1] AS state, CASE WHEN o_orderkey % 4 <> 3 THEN o_orderkey % 7 = 0 ELSE false END AS stale, CASE WHEN o_orderkey % 9 <> 0 THEN epoch_us(o_orderdate) ELSE 0 END AS t, 'P' || o_orderkey AS name, '/w/' || o_orderkey % 97 || '/P' || o_orderkey AS root FROM orders),
s AS (SELECT *, list_position({list(R.STATES)}, CASE WHEN stale AND state <> 'indexing' THEN 'stale' ELSE state END) AS place FROM p)"""
_OUTPUTS = """o AS (SELECT page_id, page_id % 16 = 13 AS gone, page_id % 8 AS n FROM pages)"""
_VERSION = """v AS (SELECT o_orderkey, list_filter([CASE WHEN o_orderkey % 13 = 1 THEN 0 ELSE o_orderkey % 3 END, CASE WHEN o_orderkey % 13 = 2 THEN 0 ELSE o_orderkey % 4 END, CASE WHEN o_orderkey % 2 <> 0 THEN 0 WHEN o_orderkey % 13 = 3 THEN 0 ELSE o_orderkey % 5 END], lambda x: true) AS a,
[CASE WHEN o_orderkey % 13 = 4 THEN 0 ELSE o_orderkey % 2 END, CASE WHEN o_orderkey % 13 = 2 THEN 0 ELSE o_orderkey % 4 END, CASE WHEN o_orderkey % 3 <> 0 THEN 0 WHEN o_orderkey % 13 = 5 THEN 0 ELSE o_orderkey % 7 END] AS b FROM orders)"""

QUERIES = {
    "state_counts": (
        lambda s, d: R.state_counts(projects(s, d), ["o_orderpriority"]),
        f"WITH {_PROJECTS} SELECT o_orderpriority, count(*) AS total, count_if(state = 'indexing') AS indexing, count_if(state = 'paused') AS paused, count_if(stale AND state <> 'indexing') AS stale, count_if(state = 'synced' AND NOT stale) AS synced, count_if(state = 'failed') AS failed FROM s GROUP BY 1",
    ),
    "projects_by_state": (lambda s, d: _sorted(s, d, "state"), f"WITH {_PROJECTS} SELECT o_orderkey FROM s ORDER BY place, root LIMIT 60"),
    "projects_by_time": (lambda s, d: _sorted(s, d, "time"), f"WITH {_PROJECTS} SELECT o_orderkey FROM s ORDER BY t DESC, root LIMIT 60"),
    "projects_by_name": (lambda s, d: _sorted(s, d, "name"), f"WITH {_PROJECTS} SELECT o_orderkey FROM s ORDER BY lower(name), root LIMIT 60"),
    "output_flags": (
        lambda s, d: outputs(s, d).select("page_id", R.output_flags(_C("output")).alias("_f")).select("page_id", "_f.*"),
        f"WITH {_OUTPUTS} SELECT page_id, NOT gone AND n IN (0, 6, 7) AS useful, NOT gone AND n IN (2, 3) AS error, NOT gone AND n IN (0, 1, 2) AS missing, NOT gone AND n = 0 AS repaired FROM o",
    ),
    "backup_time": (
        lambda s, d: _stamps(s, d).select("o_orderkey", F.unix_micros(R.backup_time(_C("name"), ".store.json")).alias("micros")),
        "SELECT o_orderkey, CASE WHEN o_orderkey % 6 <> 5 AND o_orderkey % 10 <> 0 THEN epoch_us(date_trunc('second', o_orderdate)) + 1000 * (o_orderkey % 1500) END AS micros FROM orders",
    ),
    "version_order_zero": (
        lambda s, d: _versions(s, d).select("o_orderkey", R.version_order_zero(_C("a"), _C("b")).alias("sign")),
        f"WITH {_VERSION} SELECT o_orderkey, CASE WHEN a > b THEN 1 WHEN a < b THEN -1 ELSE 0 END AS sign FROM v",
    ),
    "compared_runs": (
        lambda s, d: R.compared(table(s, d, "events").select("user_id", F.when(_C("event_type") == "view", F.floor(_C("value") * 10)).alias("proxy_ms"), F.when((_C("event_type") == "click") & (_C("user_id") % 9 != 0), F.floor(_C("value") * 10)).alias("direct_ms")), ["user_id"]),
        """WITH m AS (SELECT user_id, CAST(sum(floor(value * 10)) FILTER (event_type = 'view') AS BIGINT) // count(*) FILTER (event_type = 'view') AS p, CAST(sum(floor(value * 10)) FILTER (event_type = 'click' AND user_id % 9 <> 0) AS BIGINT) // nullif(count(*) FILTER (event_type = 'click' AND user_id % 9 <> 0), 0) AS d FROM events GROUP BY 1)
SELECT user_id, CASE WHEN p IS NULL OR d IS NULL THEN 'unknown' WHEN p < d THEN 'proxy' WHEN d < p THEN 'direct' ELSE 'level' END AS verdict, CASE WHEN p <> d THEN CAST(floor(abs(d - p) / greatest(p, d) * 100) AS INT) END AS percent FROM m""",
    ),
    "distinct_rows": (
        lambda s, d: R.distinct_rows(table(s, d, "part").select("p_partkey", "p_name", "p_type", F.when(_C("p_size") > 25, _C("p_brand")).alias("brand")), ["p_partkey"]),
        "SELECT min(p_partkey) AS p_partkey, p_name, p_type, CASE WHEN p_size > 25 THEN p_brand END AS brand FROM part GROUP BY 2, 3, 4",
    ),
    "highlighted": (
        lambda s, d: table(s, d, "documents").select("doc_id", F.posexplode(R.highlighted(_C("text"), WORD)).alias("n", "_p")).groupBy("doc_id", "_p.hit").agg(F.count("*").alias("pieces"), F.sum(F.length("_p.text")).alias("chars"), F.sum(F.col("n").cast("long")).alias("places")),
        f"""WITH q AS (SELECT doc_id, text, len(regexp_extract_all(text, '(?i){WORD}')) AS k, regexp_split_to_array(text, '(?i){WORD}') AS parts FROM documents WHERE text IS NOT NULL),
z AS (SELECT doc_id, text, parts, list_reduce([{{'n': 0, 's': 0, 'c': 0, 'h': 0}}] || list_transform(parts, lambda x, i: {{'n': length(x), 's': 0, 'c': CAST(i AS INT), 'h': 0}}), lambda a, b: {{'n': a.n + CASE WHEN b.c > 1 THEN 1 ELSE 0 END + CASE WHEN b.n > 0 THEN 1 ELSE 0 END, 's': a.s + CASE WHEN b.n > 0 THEN a.n + CASE WHEN b.c > 1 THEN 1 ELSE 0 END ELSE 0 END, 'c': 0, 'h': a.h + CASE WHEN b.c > 1 THEN a.n ELSE 0 END}}) AS r FROM q WHERE text <> '')
SELECT doc_id, true AS hit, CAST(len(parts) - 1 AS BIGINT) AS pieces, CAST({len(WORD)} * (len(parts) - 1) AS BIGINT) AS chars, CAST(r.h AS BIGINT) AS places FROM z WHERE len(parts) > 1
UNION ALL SELECT doc_id, false, len(list_filter(parts, lambda x: x <> '')), length(text) - {len(WORD)} * (len(parts) - 1), r.s FROM z WHERE len(list_filter(parts, lambda x: x <> '')) > 0
UNION ALL SELECT doc_id, false, 1, 0, 0 FROM q WHERE text = ''""",
    ),
    "selected_options": (
        lambda s, d: _choices(s, d).select("p_partkey", F.array_join(R.selected_options(_C("choice"), _C("options")), "/").alias("chosen")),
        """SELECT p_partkey, CASE WHEN p_partkey % 11 = 0 OR p_partkey % 5 = 3 THEN '' WHEN p_partkey % 5 = 0 THEN string_split(p_name, ' ')[2] || '/' || string_split(p_name, ' ')[1] WHEN p_partkey % 5 = 1 THEN p_type END AS chosen FROM part""",
    ),
    "request_codes": (
        lambda s, d: table(s, d, "pages").select("page_id", R.request_code(F.substring_index(url_path(_C("url")), "/", -1), "NONE").alias("code")),
        r"SELECT page_id, CASE WHEN c = '' THEN 'NONE' ELSE upper(substr(c, 1, 6)) END AS code FROM (SELECT page_id, regexp_replace(string_split(regexp_replace(regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', ''), '/+$', ''), '/')[-1], '[^A-Za-z0-9]', '', 'g') AS c FROM pages)",
    ),
}
