"""Code tokens, versions, paths, chunks and log lines, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.operators import upkeep as U
from corpusloom.sources.tables import table

_C = F.col
SUFFIXES, NAMES = ("php", "html", "py", "md", "js"), ("Dockerfile", "Makefile")
GLOBS = ["*.html", "es", "d?", "f*/*"]
_PATH = "regexp_replace(regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', ''), '/+$', '')"


def _named(spark, sf):
    """Part names written as code: camel case, then the type and a class name."""
    camel = F.array_join(F.transform(F.split("p_name", " "), F.initcap), "")
    return table(spark, sf, "part").select("p_partkey", F.concat_ws("/", F.concat(F.lit("src."), camel), F.concat(F.lit("v2HTMLParser_"), "p_type"), F.lit("x ..")).alias("code"))


_CODE = "SELECT p_partkey, concat_ws('/', 'src.' || array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ''), 'v2HTMLParser_' || p_type, 'x ..') AS code FROM part"


def _lines(spark, sf):
    """Events as log lines; those of one type in a form of their own."""
    e = table(spark, sf, "events")
    line = F.concat(F.lit("2024-01-01 "), _C("event_id").cast("string"), F.lit(" ["), F.upper("event_type"), F.lit("] [mod"), (_C("user_id") % 5).cast("string"), F.lit("] value ["), F.coalesce("props", F.lit("-")), F.lit("]"))
    return e.select("event_id", F.when(_C("event_id") % 11 == 0, "garbled line").otherwise(line).alias("line"))


_LOG = """l AS (SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'garbled line' ELSE '2024-01-01 ' || event_id || ' [' || upper(event_type) || '] [mod' || user_id % 5 || '] value [' || coalesce(props, '-') || ']' END AS line FROM events),
f AS (SELECT event_id, regexp_extract(line, '^(\\S+ \\S+) \\[([A-Z]+)\\] \\[([^\\]]*)\\] (.*)$', ['ts', 'level', 'module', 'message']) AS x FROM l WHERE regexp_matches(line, '^(\\S+ \\S+) \\[([A-Z]+)\\] \\[([^\\]]*)\\] (.*)$'))"""


def _parsed(spark, sf):
    rows = _lines(spark, sf).withColumn("x", X.log_fields(_C("line")))
    return rows.where("x is not null").select("event_id", "x.*")


def _texts(spark, sf):
    """Documents with every third line end turned into a heading's."""
    return table(spark, sf, "documents").select("doc_id", F.regexp_replace("text", r"\. (T|D|L|E)", ".\n## $1").alias("text"), F.concat(F.lit("docs/"), _C("doc_id").cast("string"), F.lit(".md")).alias("path"))


_TEXTS = "t AS (SELECT doc_id, 'docs/' || doc_id || '.md' AS path, string_split(regexp_replace(text, '\\. (T|D|L|E)', E'.\\n## \\\\1', 'g'), chr(10)) AS l FROM documents WHERE text IS NOT NULL)"

QUERIES = {
    "code_tokens": (
        lambda s, d: _named(s, d).select("p_partkey", F.array_join(F.array_sort(X.code_tokens(_C("code"))), " ").alias("tokens")),
        f"""WITH c AS ({_CODE}), r AS (SELECT p_partkey, list_transform(regexp_extract_all(code, '[A-Za-z0-9_\\-./:\\\\]+'), lambda r: regexp_replace(r, '^[_\\-./:\\\\]+|[_\\-./:\\\\]+$', '', 'g')) AS runs FROM c),
s AS (SELECT p_partkey, runs, flatten(list_transform(runs, lambda r: regexp_split_to_array(r, '[_\\-./:\\\\]+'))) AS segs FROM r),
k AS (SELECT p_partkey, runs || segs || flatten(list_transform(segs, lambda x: string_split(regexp_replace(regexp_replace(x, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '([A-Z])([A-Z][a-z])', '\\1 \\2', 'g'), ' '))) AS every FROM s)
SELECT p_partkey, array_to_string(list_sort(list_distinct(list_filter(list_transform(every, lambda x: lower(x)), lambda x: x <> ''))), ' ') AS tokens FROM k""",
    ),
    "camel_split": (
        lambda s, d: _named(s, d).select("p_partkey", F.array_join(X.camel_parts(F.regexp_replace("code", "[^A-Za-z0-9]", "")), "|").alias("parts")),
        f"""SELECT p_partkey, regexp_replace(regexp_replace(regexp_replace(code, '[^A-Za-z0-9]', '', 'g'), '([a-z0-9])([A-Z])', '\\1|\\2', 'g'), '([A-Z])([A-Z][a-z])', '\\1|\\2', 'g') AS parts FROM ({_CODE})""",
    ),
    "version_compare": (
        lambda s, d: table(s, d, "part").select("p_partkey", X.version_order(F.concat(F.lit("v"), (_C("p_size") % 4).cast("string"), F.lit("."), (_C("p_partkey") % 13).cast("string"), F.lit(".beta.0")), F.lit("2.7")).alias("sign")),
        "SELECT p_partkey, CASE WHEN (p_size % 4, p_partkey % 13) = (2, 7) THEN 0 WHEN p_size % 4 > 2 OR p_size % 4 = 2 AND p_partkey % 13 > 7 THEN 1 ELSE -1 END AS sign FROM part",
    ),
    "star_format": (
        lambda s, d: table(s, d, "orders").select("o_orderkey", X.thousands(F.floor(_C("o_totalprice") / 100).cast("long")).alias("stars")),
        "SELECT o_orderkey, CASE WHEN n >= 1000 THEN ((n + 50) // 1000) || '.' || (((n + 50) // 100) % 10) || 'K' ELSE CAST(n AS VARCHAR) END AS stars FROM (SELECT o_orderkey, CAST(floor(o_totalprice / 100) AS BIGINT) AS n FROM orders)",
    ),
    "slug_names": (
        lambda s, d: table(s, d, "part").select("p_partkey", X.slug(F.concat(F.lit(" -"), _C("p_name"), F.lit(" & "), _C("p_brand"), F.lit("- ")), "entry").alias("slug")),
        "SELECT p_partkey, regexp_replace(regexp_replace(regexp_replace(lower(trim(' -' || p_name || ' & ' || p_brand || '- ')), '[ \\t\\n]+', '-', 'g'), '[^a-z0-9_-]', '', 'g'), '^-+|-+$', '', 'g') AS slug FROM part",
    ),
    "plain_path": (
        lambda s, d: table(s, d, "pages").select("page_id", X.plain_path(F.concat(F.lit("\\\\?\\C:"), F.translate(F.regexp_replace("url", "^[a-z]+:/", ""), "/", "\\"), F.lit("\\"))).alias("path")),
        "SELECT page_id, regexp_replace('C:' || regexp_replace(url, '^[a-z]+:/', ''), '/+$', '') AS path FROM pages",
    ),
    "exclude_filter": (
        lambda s, d: table(s, d, "pages").select("page_id", X.url_path(_C("url")).alias("path")).select("page_id", X.path_excluded(_C("path"), "./es/*").alias("by_folder"), X.glob_excluded(_C("path"), GLOBS).alias("by_glob")),
        f"""SELECT page_id, path = 'es' OR starts_with(path, 'es/') OR contains(path, '/es/') OR ends_with(path, '/es') AS by_folder,
len(list_filter(string_split(path, '/') || [path], lambda x: regexp_full_match(x, '[^/]*\\.html') OR x = 'es' OR regexp_full_match(x, 'd[^/]') OR regexp_full_match(x, 'f[^/]*/[^/]*'))) > 0 AS by_glob FROM (SELECT page_id, {_PATH} AS path FROM pages)""",
    ),
    "supported_files": (
        lambda s, d: table(s, d, "pages").select("page_id", F.concat(X.url_path(_C("url")), F.element_at(F.array(*map(F.lit, [".PHP", "/Dockerfile", ".txt", ""])), (_C("page_id") % 4 + 1).cast("int"))).alias("path")).where(X.file_supported(_C("path"), SUFFIXES, NAMES)),
        f"""SELECT page_id, path FROM (SELECT page_id, {_PATH} || ['.PHP', '/Dockerfile', '.txt', ''][page_id % 4 + 1] AS path FROM pages)
WHERE lower(regexp_extract(string_split(path, '/')[-1], '\\.([^.]+)$', 1)) IN {SUFFIXES} OR string_split(path, '/')[-1] IN {NAMES}""",
    ),
    "log_parse": (_parsed, f"WITH {_LOG} SELECT event_id, x.ts AS ts, x.level AS level, x.module AS module, x.message AS message FROM f"),
    "log_filter": (
        lambda s, d: _parsed(s, d).where(_C("level").isin("ERROR", "VIEW") & F.contains(F.lower("message"), F.lower(F.lit("K\": 8")))).select("event_id", "level"),
        f"WITH {_LOG} SELECT event_id, x.level AS level FROM f WHERE x.level IN ('ERROR', 'VIEW') AND contains(lower(x.message), 'k\": 8')",
    ),
    "retry_backoff": (
        lambda s, d: table(s, d, "lineitem").select("l_orderkey", "l_linenumber", X.backoff(500, _C("l_linenumber")).alias("wait_ms")),
        "SELECT l_orderkey, l_linenumber, CAST(500 * pow(2, l_linenumber - 1) AS BIGINT) AS wait_ms FROM lineitem",
    ),
    "threshold_clamp": (
        lambda s, d: table(s, d, "events").select("event_id", F.greatest(F.lit(0.5), F.least(F.lit(0.95), _C("value") / 200)).alias("threshold")),
        "SELECT event_id, greatest(0.5, least(0.95, value / 200)) AS threshold FROM events",
    ),
    "ttl_valid": (
        lambda s, d: table(s, d, "events").select("event_id", (F.unix_micros(F.lit("2024-01-15 12:00:00").cast("timestamp")) - F.unix_micros(_C("ts").cast("timestamp")) < F.lit(86_400_000_000) * (_C("event_id") % 9)).alias("valid")),
        "SELECT event_id, epoch_us(TIMESTAMP '2024-01-15 12:00:00') - epoch_us(ts) < 86400000000 * (event_id % 9) AS valid FROM events",
    ),
    "backup_stamp": (
        lambda s, d: table(s, d, "orders").select("o_orderkey", F.unix_micros(F.try_to_timestamp(F.when(_C("o_orderkey") % 10 == 0, "none").otherwise(F.date_format("o_orderdate", "yyyyMMdd-HHmmss")), F.lit("yyyyMMdd-HHmmss"))).alias("micros")),
        "SELECT o_orderkey, CASE WHEN o_orderkey % 10 <> 0 THEN epoch_us(date_trunc('second', o_orderdate)) END AS micros FROM orders",
    ),
    "enum_alias": (
        lambda s, d: table(s, d, "orders").select("o_orderkey", F.coalesce(F.try_element_at(F.create_map(*map(F.lit, ["urgent", "high", "high", "high", "medium", "normal", "low", "low"])), F.lower(F.split_part(F.trim("o_orderpriority"), F.lit("-"), F.lit(2)))), F.lit("other")).alias("kind")),
        "SELECT o_orderkey, CASE lower(string_split(trim(o_orderpriority), '-')[2]) WHEN 'urgent' THEN 'high' WHEN 'high' THEN 'high' WHEN 'medium' THEN 'normal' WHEN 'low' THEN 'low' ELSE 'other' END AS kind FROM orders",
    ),
    "tag_extract": (
        lambda s, d: table(s, d, "pages").select("page_id", F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1).alias("title")),
        "SELECT page_id, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title FROM pages",
    ),
    "truncated_result": (
        lambda s, d: table(s, d, "documents").select("doc_id", F.sha2(X.cut_output(_C("text"), 3, 40, "... (more)"), 256).alias("sha256")),
        "SELECT doc_id, sha256(array_to_string(list_transform(l[1:3], lambda x: substr(x, 1, 40)), chr(10)) || CASE WHEN len(l) > 3 THEN chr(10) || '... (more)' ELSE '' END) AS sha256 FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)",
    ),
    "chunk_headings": (
        lambda s, d: U.heading_chunks(_texts(s, d), 6, 2),
        f"""WITH {_TEXTS}, h AS (SELECT doc_id, l, list_filter(range(1, len(l) + 1), lambda k: k = 1 OR regexp_matches(l[k], '^#{{1,3}} ')) AS heads FROM t),
s AS (SELECT doc_id, l, unnest(heads) AS f, unnest(list_transform(heads[2:], lambda x: x - 1) || [len(l)]) AS e, unnest(range(len(heads))) AS section FROM h),
w AS (SELECT *, unnest(range(CAST(greatest(1, ceil((e - f + 1 - 2) / 4)) AS BIGINT))) AS chunk FROM s)
SELECT doc_id, section, chunk, f + chunk * 4 AS start_line, least(f + chunk * 4 + 5, e) AS end_line FROM w WHERE trim(regexp_replace(array_to_string(l[f + chunk * 4:least(f + chunk * 4 + 5, e)], ' '), '[\\t\\n\\r]+', ' ', 'g')) <> ''""",
    ),
    "blob_split_hash": (
        lambda s, d: U.split_blobs(_texts(s, d), 5),
        f"""WITH {_TEXTS}, k AS (SELECT doc_id, path, l, CAST(ceil(len(l) / 5) AS BIGINT) AS n, unnest(range(1, CAST(ceil(len(l) / 5) AS BIGINT) + 1)) AS k FROM t)
SELECT doc_id, CASE WHEN n = 1 THEN path ELSE path || '#chunk' || k || 'of' || n END AS name, sha256(array_to_string(l[(k - 1) * 5 + 1:k * 5], chr(10))) AS sha256 FROM k""",
    ),
    "strip_chunk": (
        lambda s, d: U.split_blobs(_texts(s, d), 5).groupBy(F.substring_index("name", "#chunk", 1).alias("path")).agg(F.count("*").alias("parts")),
        f"WITH {_TEXTS} SELECT path, CAST(ceil(len(l) / 5) AS BIGINT) AS parts FROM t",
    ),
    "command_fingerprint": (
        lambda s, d: table(s, d, "conversations").groupBy("conv_id").agg(F.sha2(F.concat_ws("|", F.lit("grep"), F.concat_ws(",", F.array_sort(F.collect_set("role")))), 256).alias("fingerprint")),
        "SELECT conv_id, sha256('grep|' || string_agg(DISTINCT role, ',' ORDER BY role)) AS fingerprint FROM conversations GROUP BY conv_id",
    ),
    "short_hashes": (
        lambda s, d: table(s, d, "pages").select("page_id", F.substring(F.sha2("url", 256), 1, 32).alias("half"), F.substring(F.sha2("url", 256), 1, 16).alias("quarter")),
        "SELECT page_id, substr(sha256(url), 1, 32) AS half, substr(sha256(url), 1, 16) AS quarter FROM pages",
    ),
}
