"""Statuses, histories, ranks and reports over collections, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions.records import mean_change
from corpusloom.functions.text import percent_rate
from corpusloom.operators import upkeep as U
from corpusloom.sources.tables import table

_C = F.col
TERMS = ["tion", "the ", "der"]


def _wanted(spark):
    """60 keys in an order of their own, some of them unknown."""
    keys = F.transform(F.sequence(F.lit(0), F.lit(59)), lambda k: (k * 37 + 11) % 211)
    return spark.range(1).select(F.posexplode(keys).alias("pos", "p_partkey"))


def _history(spark, sf, kind):
    e = table(spark, sf, "events").where(_C("event_type") == kind)
    return e.select((_C("event_id") % 977).alias("id"), F.unix_micros(_C("ts").cast("timestamp")).alias("ts"), "event_id", _C("event_type").alias("origin"))


def _kinds(spark, sf):
    """Outputs by kind: short ones stand for no match, those with a secret for an error."""
    text = F.coalesce("text", F.lit(""))
    kind = F.when(F.trim(text) == "", "empty").when(text.contains("token ="), "error").when(F.length(text) < 60, "no_match").otherwise("useful")
    return table(spark, sf, "documents").select("source", kind.alias("kind"))


_KIND = "CASE WHEN trim(coalesce(text, '')) = '' THEN 'empty' WHEN contains(text, 'token =') THEN 'error' WHEN length(text) < 60 THEN 'no_match' ELSE 'useful' END"

QUERIES = {
    "all_parts_known": (
        lambda s, d: U.all_present(table(s, d, "lineitem").select("l_orderkey", "l_partkey"), table(s, d, "part").where("p_size > 5").select(_C("p_partkey").alias("l_partkey")), "l_orderkey", "l_partkey"),
        "SELECT l_orderkey, count(*) AS parts, bool_and(p_partkey IS NOT NULL) AS complete FROM lineitem LEFT JOIN (SELECT p_partkey FROM part WHERE p_size > 5) ON l_partkey = p_partkey GROUP BY l_orderkey",
    ),
    "ordered_lookup": (
        lambda s, d: U.ordered_lookup(table(s, d, "part").select("p_partkey", "p_name"), _wanted(s), "p_partkey").select("pos", "p_partkey", "p_name"),
        "SELECT k AS pos, p_partkey, p_name FROM (SELECT unnest(range(60)) AS k) JOIN part ON p_partkey = (k * 37 + 11) % 211",
    ),
    "status_reconcile": (
        lambda s, d: U.reconciled(
            table(s, d, "orders").select("o_orderkey", F.when(_C("o_orderstatus") == "F", "done").otherwise("running").alias("stored")),
            table(s, d, "lineitem").where("l_linenumber > 3").groupBy(_C("l_orderkey").alias("o_orderkey")).agg(F.when(F.max("l_quantity") > 45, "failed").otherwise("synced").alias("job")), "o_orderkey"),
        """SELECT o_orderkey, CASE WHEN job IS NOT NULL THEN job WHEN o_orderstatus = 'F' THEN 'done' ELSE 'failed' END AS state
FROM orders LEFT JOIN (SELECT l_orderkey, CASE WHEN max(l_quantity) > 45 THEN 'failed' ELSE 'synced' END AS job FROM lineitem WHERE l_linenumber > 3 GROUP BY 1) ON o_orderkey = l_orderkey""",
    ),
    "alias_lookup": (
        lambda s, d: table(s, d, "customer").select("c_custkey", "c_nationkey", F.substring_index("c_name", "#", -1).alias("_last"))
        .join(table(s, d, "nation").where("n_nationkey % 2 = 0").select(_C("n_nationkey").alias("c_nationkey"), F.trim("n_name").alias("_alias")), "c_nationkey", "left")
        .select("c_custkey", F.coalesce(F.nullif(_C("_alias"), F.lit("")), "_last").alias("shown")),
        "SELECT c_custkey, coalesce(nullif(trim(n_name), ''), string_split(c_name, '#')[-1]) AS shown FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_nationkey % 2 = 0) ON c_nationkey = n_nationkey",
    ),
    "history_merge": (
        lambda s, d: U.first_of_sources([_history(s, d, k) for k in ("error", "click", "view")], "id").select("id", "ts", "origin"),
        """SELECT id, ts, event_type AS origin FROM (SELECT event_id % 977 AS id, epoch_us(ts) AS ts, event_type FROM events WHERE event_type IN ('error', 'click', 'view'))
QUALIFY row_number() OVER (PARTITION BY id ORDER BY CASE event_type WHEN 'error' THEN 0 WHEN 'click' THEN 1 ELSE 2 END, ts) = 1""",
    ),
    "page_has_more": (
        lambda s, d: U.page_of(table(s, d, "customer").select("c_custkey", "c_name", "c_acctbal"), [F.desc("c_acctbal"), _C("c_custkey")], 3, 20),
        """SELECT c_custkey, c_name, c_acctbal, CAST(place AS INT) AS place, (SELECT count(*) FROM customer) > 60 AS has_more FROM (SELECT c_custkey, c_name, c_acctbal, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS place FROM customer) WHERE place > 40 AND place <= 60""",
    ),
    "command_rates": (
        lambda s, d: table(s, d, "events").groupBy("user_id").agg(F.count("*").alias("calls"), F.count_if(_C("event_type") == "error").alias("errors"), F.count_if(_C("event_type") == "click").alias("clicks"))
        .withColumns({"error_rate": percent_rate(_C("errors"), _C("calls")), "per_click": percent_rate(_C("errors"), _C("clicks"))}),
        """SELECT *, round(errors / calls * 1000) / 10 AS error_rate, CASE WHEN clicks = 0 THEN 0 ELSE round(errors / clicks * 1000) / 10 END AS per_click
FROM (SELECT user_id, count(*) AS calls, count_if(event_type = 'error') AS errors, count_if(event_type = 'click') AS clicks FROM events GROUP BY user_id)""",
    ),
    "output_classes": (lambda s, d: _kinds(s, d).groupBy("source", "kind").agg(F.count("*").alias("n")), f"SELECT source, {_KIND} AS kind, count(*) AS n FROM documents GROUP BY ALL"),
    "project_counts": (
        lambda s, d: table(s, d, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("total"), *[F.count_if(_C("o_orderstatus") == k).alias(n) for k, n in (("F", "synced"), ("O", "open"), ("P", "running"))]),
        "SELECT o_orderpriority, count(*) AS total, count_if(o_orderstatus = 'F') AS synced, count_if(o_orderstatus = 'O') AS open, count_if(o_orderstatus = 'P') AS running FROM orders GROUP BY 1",
    ),
    "compare_verdict": (
        lambda s, d: mean_change(table(s, d, "events").select("user_id", F.when(_C("event_type") == "view", _C("value")).alias("first"), F.when(_C("event_type") == "click", _C("value")).alias("second")), ["user_id"])
        .withColumn("verdict", F.when(_C("percent").isNull(), "unknown").when(_C("percent") > 5, "slower").when(_C("percent") < -5, "faster").otherwise("level")),
        """SELECT user_id, percent, CASE WHEN percent IS NULL THEN 'unknown' WHEN percent > 5 THEN 'slower' WHEN percent < -5 THEN 'faster' ELSE 'level' END AS verdict
FROM (SELECT user_id, CASE WHEN a > 0 THEN CAST((b * m - a * n) * 100 // (a * n) AS BIGINT) END AS percent FROM (SELECT user_id, sum(u) FILTER (event_type = 'view') AS a, count(u) FILTER (event_type = 'view')::HUGEINT AS m,
sum(u) FILTER (event_type = 'click') AS b, count(u) FILTER (event_type = 'click')::HUGEINT AS n FROM (SELECT user_id, event_type, CASE WHEN event_type IN ('view', 'click') THEN CAST(round(value * 10000) AS BIGINT) END AS u FROM events) GROUP BY 1))""",
    ),
    "scope_preflight": (
        lambda s, d: U.preflight(table(s, d, "documents").select(F.octet_length("text").alias("size")), 10_000_000, 200_000),
        "SELECT count(*) AS files, CAST(coalesce(sum(strlen(text)), 0) AS BIGINT) AS bytes, CASE WHEN count(*) > 10000000 THEN 'files' WHEN sum(strlen(text)) > 200000 THEN 'bytes' ELSE 'none' END AS breach FROM documents",
    ),
    "recent_files": (
        lambda s, d: table(s, d, "pages").select(F.regexp_replace("url", "[?#].*$", "").alias("path")).distinct().orderBy("path").limit(5),
        "SELECT DISTINCT regexp_replace(url, '[?#].*$', '') AS path FROM pages ORDER BY path LIMIT 5",
    ),
    "project_sort": (
        lambda s, d: table(s, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice").orderBy(F.when(_C("o_orderstatus") == "P", 0).when(_C("o_orderstatus") == "O", 1).otherwise(2), F.desc(F.coalesce("o_totalprice", F.lit(0.0))), "o_orderkey").limit(50),
        "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders ORDER BY CASE o_orderstatus WHEN 'P' THEN 0 WHEN 'O' THEN 1 ELSE 2 END, coalesce(o_totalprice, 0) DESC, o_orderkey LIMIT 50",
    ),
    "probe_ranking": (
        lambda s, d: table(s, d, "events").groupBy("user_id").agg(F.bool_and(_C("event_type") != "error").alias("ok"), F.min("value").alias("latency")).orderBy(~_C("ok"), F.col("latency").asc_nulls_last(), "user_id").limit(20),
        "SELECT user_id, bool_and(event_type <> 'error') AS ok, min(value) AS latency FROM events GROUP BY user_id ORDER BY NOT bool_and(event_type <> 'error'), latency NULLS LAST, user_id LIMIT 20",
    ),
    "max_per_file": (
        lambda s, d: U.matching_lines(table(s, d, "documents").select("doc_id", "text"), TERMS, 4).select("doc_id", "line_no", F.length("line").alias("chars")),
        f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_no FROM documents)
SELECT doc_id, CAST(line_no AS INT) AS line_no, length(line) AS chars FROM l WHERE {" OR ".join(f"contains(lower(line), '{t}')" for t in TERMS)} QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY line_no) <= 4""",
    ),
    "newest_n": (
        lambda s, d: table(s, d, "events").select("event_id", F.unix_micros(_C("ts").cast("timestamp")).alias("micros")).orderBy(F.desc("micros"), F.desc("event_id")).limit(200),
        "SELECT event_id, epoch_us(ts) AS micros FROM events ORDER BY ts DESC, event_id DESC LIMIT 200",
    ),
}
