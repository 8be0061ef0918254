"""Scalar text, path and time queries and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions.text import age_bucket, byte_size, cjk_share, collapsed, truncated, url_path
from corpusloom.sources.tables import table

_C = F.col


def _docs(spark, sf):
    return table(spark, sf, "documents")


def _ages(spark, sf):
    events = table(spark, sf, "events").select("event_id", "ts")
    last = events.agg(F.max("ts").alias("_last"))
    age = F.floor((F.unix_micros(_C("_last").cast("timestamp")) - F.unix_micros(_C("ts").cast("timestamp"))) / 1_000_000)
    return events.join(F.broadcast(last)).select("event_id", age_bucket(age).alias("age"))  # one row


QUERIES = {
    "blob_hash": (
        lambda s, d: _docs(s, d).select("doc_id", F.sha2(F.concat("source", "text"), 256).alias("hash"), F.substring(F.sha2("text", 256), 1, 16).alias("short_hash")),
        "SELECT doc_id, sha256(source || text) AS hash, substr(sha256(text), 1, 16) AS short_hash FROM documents",
    ),
    "truncate_ellipsis": (lambda s, d: _docs(s, d).select("doc_id", truncated(_C("text"), 80).alias("short")), "SELECT doc_id, CASE WHEN length(text) > 80 THEN substr(text, 1, 80) || '...' ELSE text END AS short FROM documents"),
    "diagnostic_summary": (
        lambda s, d: _docs(s, d).select("doc_id", F.substring(collapsed(_C("text")), 1, 320).alias("summary")),
        r"SELECT doc_id, substr(trim(regexp_replace(text, '[\x20\x09-\x0D]+', ' ', 'g')), 1, 320) AS summary FROM documents",
    ),
    "cjk_ratio": (
        lambda s, d: _docs(s, d).select("doc_id", F.round(cjk_share(_C("text")), 6).alias("ratio")),
        r"SELECT doc_id, CASE WHEN text = '' THEN 0 ELSE round(length(regexp_replace(text, '[^\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{F900}-\x{FAFF}]', '', 'g')) / length(text), 6) END AS ratio FROM documents",
    ),
    "format_bytes": (
        lambda s, d: _docs(s, d).select("doc_id", byte_size(F.octet_length("text")).alias("size")),
        """SELECT doc_id, CASE WHEN b < 1024 THEN b || ' B' WHEN b < 1048576 THEN printf('%d.%02d KB', CAST(floor(floor(b * 100 / 1024 + 0.5) / 100) AS BIGINT), CAST(floor(b * 100 / 1024 + 0.5) AS BIGINT) % 100) WHEN b < 1073741824 THEN printf('%d.%02d MB', CAST(floor(floor(b * 100 / 1048576 + 0.5) / 100) AS BIGINT), CAST(floor(b * 100 / 1048576 + 0.5) AS BIGINT) % 100) ELSE printf('%d.%02d GB', CAST(floor(floor(b * 100 / 1073741824 + 0.5) / 100) AS BIGINT), CAST(floor(b * 100 / 1073741824 + 0.5) AS BIGINT) % 100) END AS size
FROM (SELECT doc_id, strlen(text) AS b FROM documents)""",
    ),
    "path_normalize": (
        lambda s, d: table(s, d, "pages").select("page_id", url_path(_C("url")).alias("path")),
        "SELECT page_id, regexp_replace(regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', ''), '/+$', '') AS path FROM pages",
    ),
    "relative_time": (
        _ages,
        """SELECT event_id, CASE WHEN s < 60 THEN 'now' WHEN s < 3600 THEN 'minutes' WHEN s < 86400 THEN 'hours' WHEN s < 2592000 THEN 'days' WHEN s < 31536000 THEN 'months' ELSE 'years' END AS age
FROM (SELECT event_id, floor((epoch_us((SELECT max(ts) FROM events)) - epoch_us(ts)) / 1000000) AS s FROM events)""",
    ),
}
