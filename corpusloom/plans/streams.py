"""Batch forms of the streams over events, pages and conversations, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions.text import url_path
from corpusloom.sources.tables import table
from corpusloom.streaming import assembly as A
from corpusloom.streaming import requests as R

_C = F.col
QUIET, MOST = 4 * 3600, 12 * 3600


def _keyed(spark, sf):
    return table(spark, sf, "events").select(_C("user_id").cast("string").alias("key"), _C("ts").cast("timestamp").alias("ts"))


def _sessions(spark, sf):
    return R.change_sessions_batch(_keyed(spark, sf), QUIET * 1000, MOST * 1000)


def _jobs(spark, sf):
    own = table(spark, sf, "events").select(_C("user_id").cast("string").alias("project"), _C("event_id").alias("seq"), F.when(_C("event_type") == "purchase", "done").otherwise("request").alias("kind"), F.when(_C("event_type") == "signup", "full").otherwise("incremental").alias("mode"))
    return R.job_starts_batch(own)


def _flushes(spark, sf):
    """Changed pages by flushes of 20; every host's language folder is a nested project, a host's page number 8.. too."""
    path = url_path(_C("url"))
    changes = table(spark, sf, "pages").select(F.floor(_C("page_id") / 20).alias("flush"), F.concat(F.substring_index(F.substring_index(path, "/", 1), ".", 1)).alias("parent"), path.alias("path"))
    nested = table(spark, sf, "pages").select(F.when(_C("page_id") % 3 == 0, path).when(_C("page_id") % 3 == 1, F.substring_index(path, "/", 2)).otherwise(F.lit("elsewhere")).alias("root"))
    return R.affected_projects(changes, nested)


def chunks(spark, sf, size: int = 40):
    """Each conversation as a stream of server-sent events, one for a turn, cut every ``size`` bytes."""
    turns = table(spark, sf, "conversations").select(_C("conv_id").cast("string").alias("stream"), "turn", F.encode(F.concat(F.lit("event: x\r\ndata: "), F.to_json(F.struct("text")), F.lit("\r\n\r\n")), "UTF-8").alias("data"))
    cut = turns.select("stream", "turn", "data", F.explode(F.sequence(F.lit(0), F.floor((F.octet_length("data") - 1) / size))).alias("k"))
    # a turn's cuts are numbered from its place, so that seq is gapless within the stream
    n = turns.select(_C("stream").alias("_s"), _C("turn").alias("_t"), F.floor((F.octet_length("data") - 1) / size + 1).alias("_n"))
    before = cut.select("stream", "turn").distinct().join(n, (_C("stream") == _C("_s")) & (_C("_t") < _C("turn")), "left").groupBy("stream", "turn").agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("_before"))
    return cut.join(before, ["stream", "turn"]).select("stream", (_C("_before") + _C("k")).alias("seq"), F.substring("data", (_C("k") * size + 1).cast("int"), F.lit(size)).alias("data"), F.lit(False).alias("last"))


QUERIES = {
    "change_sessions": (
        _sessions,
        f"""WITH RECURSIVE e AS (SELECT CAST(user_id AS VARCHAR) AS key, epoch_us(ts) // 1000 AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
s AS (SELECT key, rn, t, t AS first_ms, 1 AS session FROM e WHERE rn = 1
UNION ALL SELECT e.key, e.rn, e.t, CASE WHEN e.t > least(s.t + {QUIET * 1000}, s.first_ms + {MOST * 1000}) THEN e.t ELSE s.first_ms END, CASE WHEN e.t > least(s.t + {QUIET * 1000}, s.first_ms + {MOST * 1000}) THEN s.session + 1 ELSE s.session END
FROM s JOIN e ON e.key = s.key AND e.rn = s.rn + 1),
g AS (SELECT key, first_ms, max(t) AS last_ms, count(*) AS n_events FROM s GROUP BY key, session, first_ms)
SELECT key, first_ms, last_ms, least(last_ms + {QUIET * 1000}, first_ms + {MOST * 1000}) AS end_ms, n_events, CASE WHEN last_ms + {QUIET * 1000} <= first_ms + {MOST * 1000} THEN 'quiet' ELSE 'max_wait' END AS reason FROM g""",
    ),
    "job_starts": (
        _jobs,
        """WITH RECURSIVE e AS (SELECT CAST(user_id AS VARCHAR) AS project, event_id AS seq, event_type = 'purchase' AS done, CASE WHEN event_type = 'signup' THEN 'full' ELSE 'incremental' END AS mode, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events),
s AS (SELECT project, CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS seq, CAST(NULL AS VARCHAR) AS held, CAST(NULL AS VARCHAR) AS mode FROM (SELECT DISTINCT project FROM e)
UNION ALL SELECT e.project, e.rn, e.seq,
CASE WHEN NOT e.done THEN CASE WHEN held IS NULL THEN 'run' WHEN held = 'full' THEN 'full' ELSE e.mode END WHEN held IS NULL OR held = 'run' THEN NULL ELSE 'run' END,
CASE WHEN NOT e.done THEN CASE WHEN held IS NULL THEN e.mode END WHEN held <> 'run' THEN held END
FROM s JOIN e ON e.project = s.project AND e.rn = s.rn + 1)
SELECT project, seq, mode FROM s WHERE mode IS NOT NULL""",
    ),
    "affected_projects": (
        _flushes,
        r"""WITH p AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', ''), '/+$', '') AS path FROM pages),
nested AS (SELECT DISTINCT CASE WHEN page_id % 3 = 0 THEN path WHEN page_id % 3 = 1 THEN array_to_string(string_split(path, '/')[1:2], '/') ELSE 'elsewhere' END AS root FROM p),
c AS (SELECT DISTINCT page_id // 20 AS flush, string_split(path, '.')[1] AS parent, path FROM p),
r AS (SELECT flush, path, parent, arg_max(root, length(root)) AS root FROM c LEFT JOIN nested ON path = root OR starts_with(path, root || '/') GROUP BY ALL)
SELECT flush, coalesce(root, parent) AS project, count(*) AS changed FROM r WHERE root IS NOT NULL OR starts_with(path, parent) GROUP BY ALL""",
    ),
    "event_texts": (
        lambda s, d: A.texts_of_chunks_batch(chunks(s, d)).select("stream", "n", F.sha2("text", 256).alias("sha256"), "progress"),
        "SELECT CAST(conv_id AS VARCHAR) AS stream, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, sha256(text) AS sha256, CAST(least(90, 2 * row_number() OVER (PARTITION BY conv_id ORDER BY turn) % 256) AS INT) AS progress FROM conversations WHERE text <> ''",
    ),
}
