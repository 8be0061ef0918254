"""Collection upkeep queries and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions.text import collapsed, url_path
from corpusloom.operators import upkeep as U
from corpusloom.sources.tables import table

_C = F.col
_PATH = "regexp_replace(regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', ''), '/+$', '')"
_UP = "list_transform(range(1, len(string_split({0}, '/'))), lambda k: array_to_string(string_split({0}, '/')[1:k], '/'))"


def _docs(spark, sf):
    return table(spark, sf, "documents")


def _paths(spark, sf):
    return table(spark, sf, "pages").select("page_id", url_path(_C("url")).alias("path"))


def _roots(spark, sf):
    """Every host, and every directory of two segments."""
    paths = _paths(spark, sf)
    return paths.select(F.substring_index("path", "/", 1).alias("root")).union(paths.where(F.size(F.split("path", "/")) > 2).select(F.substring_index("path", "/", 2))).distinct()


_ROOTS_SQL = f"p AS (SELECT page_id, {_PATH} AS path FROM pages), roots AS (SELECT string_split(path, '/')[1] AS root FROM p UNION SELECT array_to_string(string_split(path, '/')[1:2], '/') FROM p WHERE len(string_split(path, '/')) > 2)"


def _progress(spark, sf):
    done = table(spark, sf, "labels").select("doc_id").distinct().withColumn("_d", F.lit(1))
    rows = _docs(spark, sf).join(done, "doc_id", "left").groupBy("source").agg(F.count("*").alias("total"), F.count("_d").alias("done"))
    return rows.withColumn("percent", F.floor(F.least(F.lit(100), _C("done") * 100 / _C("total"))))


def _changes(spark, sf):
    """Documents against what is known of them: a labelled document's size and hash, of bad ones as they were when shorter."""
    known = table(spark, sf, "labels").select("doc_id", "quality")
    now = _docs(spark, sf).select("doc_id", F.octet_length("text").alias("size"), F.crc32(_C("text").cast("binary")).alias("digest"))
    old = now.join(known, "doc_id").select("doc_id", F.when(_C("quality") == 1, _C("size")).otherwise(_C("size") - 1).alias("size"), "digest")
    return U.changed(now.where("doc_id % 7 != 0"), old, "doc_id", ["size", "digest"])


def _summaries(spark, sf):
    rows = table(spark, sf, "conversations").select("conv_id", "turn", F.concat_ws(": ", "role", collapsed(_C("text"))).alias("_s"))
    said = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "_s"))).alias("_l"))
    return said.select("conv_id", F.array_join(F.transform("_l", lambda x: x["_s"]), " | ").alias("summary"))


QUERIES = {
    "exact_dedup": (
        lambda s, d: _docs(s, d).groupBy(F.sha2("text", 256).alias("hash")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")),
        "SELECT sha256(text) AS hash, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1",
    ),
    "category_stats": (
        lambda s, d: _docs(s, d).groupBy("lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars")),
        "SELECT lang, count(*) AS n, sum(n_chars) AS chars FROM documents GROUP BY lang",
    ),
    "keep_best": (
        lambda s, d: U.keep_first(_docs(s, d).select("lang", "source", "doc_id", "n_chars", F.octet_length("text").alias("n_bytes")), ["lang", "source"], [F.desc("n_chars"), F.desc("n_bytes"), _C("doc_id")]),
        "SELECT lang, source, doc_id, n_chars, strlen(text) AS n_bytes FROM documents QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY n_chars DESC, strlen(text) DESC, doc_id) = 1",
    ),
    "new_blobs_anti": (
        lambda s, d: _docs(s, d).select("doc_id").join(table(s, d, "labels"), "doc_id", "left_anti"),
        "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    ),
    "known_blobs_semi": (
        lambda s, d: _docs(s, d).select("doc_id", "source").join(table(s, d, "labels"), "doc_id", "left_semi"),
        "SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)",
    ),
    "change_detect": (
        _changes,
        """WITH n AS (SELECT doc_id FROM documents WHERE doc_id % 7 != 0), o AS (SELECT doc_id, quality FROM documents JOIN labels USING (doc_id))
SELECT coalesce(n.doc_id, o.doc_id) AS doc_id, CASE WHEN n.doc_id IS NULL THEN 'stale' WHEN o.doc_id IS NULL THEN 'new' WHEN o.quality = 1 THEN 'unchanged' ELSE 'changed' END AS state
FROM n FULL JOIN o ON n.doc_id = o.doc_id""",
    ),
    "progress_percent": (
        _progress,
        """SELECT source, count(*) AS total, count(l.doc_id) AS done, CAST(floor(least(100, count(l.doc_id) * 100 / count(*))) AS BIGINT) AS percent
FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON d.doc_id = l.doc_id GROUP BY source""",
    ),
    "batch_plan": (
        lambda s, d: U.batches(_docs(s, d).select("doc_id", F.sha2(F.concat_ws("#", "doc_id", "text"), 256).alias("hash")), "hash", 50),
        "WITH h AS (SELECT doc_id, sha256(doc_id || '#' || text) AS hash FROM documents) SELECT doc_id, hash, CAST(floor((row_number() OVER (ORDER BY hash) - 1) / 50) AS BIGINT) AS batch FROM h",
    ),
    "recent_n": (
        lambda s, d: U.recent(table(s, d, "conversations").select("conv_id", "turn", "role"), ["conv_id"], ["turn"], 3),
        "SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 3",
    ),
    "recall_summary": (
        _summaries,
        r"SELECT conv_id, string_agg(role || ': ' || trim(regexp_replace(text, '[\x20\x09-\x0D]+', ' ', 'g')), ' | ' ORDER BY turn) AS summary FROM conversations GROUP BY conv_id",
    ),
    "plan_summary": (
        lambda s, d: table(s, d, "orders").groupBy("o_custkey").agg(F.count_if(_C("o_orderstatus") == "F").alias("completed"), F.count("*").alias("total")).withColumn("all_completed", _C("completed") == _C("total")),
        "SELECT o_custkey, count_if(o_orderstatus = 'F') AS completed, count(*) AS total, count_if(o_orderstatus = 'F') = count(*) AS all_completed FROM orders GROUP BY o_custkey",
    ),
    "directory_rollup": (
        lambda s, d: U.rollup_directories(_paths(s, d).select("path", (_C("page_id") % 3 == 0).alias("indexed"))),
        f"""WITH p AS (SELECT page_id, {_PATH} AS path FROM pages), e AS (SELECT unnest({_UP.format("path")}) AS directory, page_id % 3 = 0 AS i FROM p),
g AS (SELECT directory, count(*) AS total, count_if(i) AS indexed FROM e GROUP BY directory)
SELECT *, CASE WHEN indexed = 0 THEN 'none' WHEN indexed = total THEN CAST(total AS VARCHAR) ELSE indexed || '/' || total END AS label FROM g""",
    ),
    "longest_prefix_route": (
        lambda s, d: U.route(_paths(s, d), _roots(s, d)),
        f"WITH {_ROOTS_SQL} SELECT page_id, path, max_by(root, length(root)) AS root FROM p JOIN roots ON path = root OR starts_with(path, root || '/') GROUP BY page_id, path",
    ),
    "root_collapse": (
        lambda s, d: U.outermost(_roots(s, d)),
        f"WITH {_ROOTS_SQL} SELECT root FROM roots r WHERE NOT EXISTS (SELECT 1 FROM roots o WHERE starts_with(r.root, o.root || '/'))",
    ),
    "session_quiet": (
        lambda s, d: U.quiet_sessions(table(s, d, "events").select("event_id", "ts", "user_id"), 3600),
        """WITH m AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) > 3600000000 THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
n AS (SELECT *, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS session FROM m)
SELECT user_id, session, count(*) AS n_events, min(event_id) AS least_event, max(event_id) AS greatest_event FROM n GROUP BY user_id, session""",
    ),
    "metric_average": (
        lambda s, d: table(s, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 4).alias("mean"), F.count("value").alias("known")),
        "SELECT event_type, count(*) AS n, round(avg(value), 4) AS mean, count(value) AS known FROM events GROUP BY event_type",
    ),
    "index_counts": (
        lambda s, d: _docs(s, d).agg(F.count("*").alias("files"), F.sum(F.size(F.split("text", "\n"))).alias("lines")),
        "SELECT count(*) AS files, CAST(sum(len(string_split(text, chr(10)))) AS BIGINT) AS lines FROM documents",
    ),
}
