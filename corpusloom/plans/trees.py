"""Trees of pages as files of hosts, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions.text import url_path
from corpusloom.operators import trees as T
from corpusloom.sources.tables import table

_C = F.col
# a made-up rule file; each rule with its form for the SQL
RULES = [("# comment", None), ("", None), ("*1*", "^(.*/)?[^/]*1[^/]*$"), ("!/en/1?", "^en/1[^/]$"), ("fr/", "^(.*/)?fr$"), ("!fr/*", "^fr/[^/]*$"), ("/de/**/2*", "^de/(.*/)?2[^/]*$"), ("**/77", "^(.*/)?77$"), ("\\#x  ", "^(.*/)?#x$")]
EXCLUDES = ["*9", "es/3?"]


def entries(spark, sf):
    """Pages as entries of one project for each top-level domain; pages with a slash at the end are folders."""
    path = url_path(_C("url"))
    host = F.substring_index(path, "/", 1)
    return table(spark, sf, "pages").select("page_id", F.substring_index(host, ".", -1).alias("project"), F.substring(path, F.length(host) + 2, F.lit(1 << 30)).alias("path"), F.rlike("url", F.lit("/([?#].*)?$")).alias("folder"), F.octet_length("html").cast("long").alias("size"))


def _rules(spark, sf):
    lines = spark.createDataFrame([(k, line) for k, (line, _) in enumerate(RULES)], "pos int, line string")
    return T.ignore_rules(entries(spark, sf).select("project").distinct().where("project != 'org'").join(F.broadcast(lines)))  # the rules of a file


def _collected(spark, sf):
    found = T.collected(entries(spark, sf), _rules(spark, sf), EXCLUDES, ("md",), tuple(str(k) for k in range(0, 1000, 2)), 4000)
    return found.select("page_id", "reason")


def _host_tree(spark, sf):
    own = table(spark, sf, "pages").select(url_path(_C("url")).alias("path"))
    return T.tree_entries(own.select(F.element_at(F.split(F.substring_index("path", "/", 1), r"\."), -1).alias("project"), "path"))


def _depths(spark, sf):
    return T.fitting_depth(_host_tree(spark, sf), "/tree", 4, 3000)


def _first_breach(spark, sf, *limits):
    own = entries(spark, sf).select(F.concat_ws("/", "project", "path", _C("page_id").cast("string")).alias("path"), (_C("page_id") % 3 != 0).alias("candidate"), "size")
    return T.first_breach(own, *limits)


_BARE = r"regexp_replace(regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', ''), '/+$', '')"
_ENTRIES = rf"""p AS (SELECT page_id, url, {_BARE} AS u, html FROM pages),
e AS (SELECT page_id, split_part(split_part(u, '/', 1), '.', -1) AS project, substr(u, length(split_part(u, '/', 1)) + 2) AS path, regexp_matches(url, '/([?#].*)?$') AS folder, strlen(html) AS size FROM p)"""
_FORMS = ", ".join(f"({k}, '{form}', {str(line.startswith('!')).lower()}, {str(line.endswith('/')).lower()})" for k, (line, form) in enumerate(RULES) if form)
_NAMES = "list_transform(range(0, 1000, 2), lambda x: CAST(x AS VARCHAR))"
_COLLECTED = rf"""WITH {_ENTRIES}, r(pos, form, keeps, folders) AS (VALUES {_FORMS}),
s AS (SELECT page_id, path, folder, project, unnest(range(1, len(string_split(path, '/')) + 1)) AS d FROM e),
st AS (SELECT page_id, project, array_to_string(string_split(path, '/')[1:d], '/') AS step, d < len(string_split(path, '/')) OR folder AS folder FROM s),
m AS (SELECT page_id, step, arg_max(NOT keeps, pos) AS ign FROM st JOIN r ON regexp_matches(step, form) AND (st.folder OR NOT folders) WHERE project <> 'org' GROUP BY ALL),
i AS (SELECT page_id, bool_or(ign) AS ign FROM m GROUP BY page_id)
SELECT page_id, CASE WHEN coalesce(ign, false) THEN 'ignored' WHEN regexp_matches(path, '^[^/]*9$') OR len(list_filter(string_split(path, '/'), lambda x: regexp_matches(x, '^[^/]*9$'))) > 0 OR regexp_matches(path, '^es/3[^/]$') THEN 'excluded'
WHEN folder THEN 'folder' WHEN NOT (ends_with(path, '.md') OR list_contains({_NAMES}, string_split(path, '/')[-1])) THEN 'type' WHEN size > 4000 THEN 'size' END AS reason FROM e LEFT JOIN i USING (page_id)"""
_TREE = rf"""f AS (SELECT DISTINCT split_part(split_part({_BARE}, '/', 1), '.', -1) AS project, {_BARE} AS path FROM pages),
a AS (SELECT DISTINCT project, array_to_string(string_split(path, '/')[1:d], '/') AS path, true AS folder FROM (SELECT *, unnest(range(1, len(string_split(path, '/')))) AS d FROM f)),
t AS (SELECT * FROM a UNION ALL SELECT project, path, false FROM f WHERE (project, path) NOT IN (SELECT project, path FROM a)),
c AS (SELECT project, array_to_string(string_split(path, '/')[1:-2], '/') AS path, count(*) AS children FROM t WHERE contains(path, '/') GROUP BY ALL),
x AS (SELECT t.project, t.path, len(string_split(t.path, '/')) AS depth, t.folder, coalesce(children, 0) AS children, string_split(t.path, '/')[-1] || CASE WHEN NOT t.folder THEN '' WHEN coalesce(children, 0) > 0 THEN '/ (' || children || ' entries)' ELSE '/' END AS shown FROM t LEFT JOIN c USING (project, path))"""
_DEPTH = f"""{_TREE}, d AS (SELECT project, d AS depth, 5 + coalesce((SELECT sum(strlen(shown) + 3 * (depth - 1) + 5) FROM x WHERE x.project = g.project AND x.depth <= d), 0) AS bytes FROM (SELECT DISTINCT project FROM x) g, (SELECT unnest([1, 2, 3, 4]) AS d)),
dep AS (SELECT project, coalesce(max(depth) FILTER (bytes <= 3000), 0) AS depth, max(bytes) FILTER (bytes <= 3000)::BIGINT AS bytes FROM d GROUP BY project)"""
_SORT = "array_to_string(list_transform(string_split(path, '/'), lambda s: lower(s) || chr(0) || s), chr(1))"


def _breach_sql(entries_: int, files: int, bytes_: int) -> str:
    return f"""WITH {_ENTRIES}, o AS (SELECT project || '/' || path || '/' || page_id AS path, page_id % 3 <> 0 AS c, size FROM e),
w AS (SELECT path, c, size, count(*) OVER x AS n, count(*) FILTER (c) OVER x AS f, coalesce(sum(size) FILTER (c) OVER x, 0)::BIGINT AS b FROM o WINDOW x AS (ORDER BY path ROWS UNBOUNDED PRECEDING)),
h AS (SELECT * FROM (SELECT *, CASE WHEN n >= {entries_} THEN 'entries' WHEN f >= {files} THEN 'files' WHEN b >= {bytes_} THEN 'bytes' END AS breach FROM w) WHERE breach IS NOT NULL ORDER BY path LIMIT 1),
one AS (SELECT n AS entries, CASE WHEN breach = 'entries' AND c THEN f - 1 ELSE f END AS files, CASE WHEN breach = 'entries' AND c THEN b - size ELSE b END AS bytes, path, breach FROM h)
SELECT * FROM one UNION ALL SELECT count(*), count(*) FILTER (c), coalesce(sum(size) FILTER (c), 0)::BIGINT, NULL, 'none' FROM o HAVING (SELECT count(*) FROM one) = 0"""


QUERIES = {
    "collected_files": (_collected, _COLLECTED),
    "tree_entries": (_host_tree, f"WITH {_TREE} SELECT project, path, CAST(depth AS INT) AS depth, folder, children FROM x"),
    "depth_tree": (_depths, f"WITH {_DEPTH} SELECT project, CAST(depth AS INT) AS depth, bytes, depth < 4 AS fell_back FROM dep"),
    "tree_lines": (
        lambda s, d: T.tree_lines(_host_tree(s, d), _depths(s, d)).withColumn("place", F.sha2("place", 256)),
        f"""WITH {_DEPTH}, y AS (SELECT x.*, array_to_string(string_split(path, '/')[1:-2], '/') AS up, string_split(path, '/')[-1] AS name FROM x JOIN dep USING (project) WHERE x.depth <= dep.depth),
z AS (SELECT *, row_number() OVER (PARTITION BY project, up ORDER BY lower(name) DESC, name DESC) = 1 AS last FROM y),
b AS (SELECT z.project, z.path, coalesce(string_agg(CASE WHEN u.last THEN '   ' WHEN u.path IS NOT NULL THEN '|  ' END, '' ORDER BY u.depth), '') AS bars FROM z LEFT JOIN z u ON u.project = z.project AND starts_with(z.path, u.path || '/') GROUP BY ALL)
SELECT project, sha256({_SORT}) AS place, bars || CASE WHEN last THEN '`-- ' ELSE '|-- ' END || shown AS line FROM z JOIN b USING (project, path)""",
    ),
    "preflight_entries": (lambda s, d: _first_breach(s, d, 150, 120, 1 << 40), _breach_sql(150, 120, 1 << 40)),
    "preflight_files": (lambda s, d: _first_breach(s, d, 1 << 40, 71, 1 << 40), _breach_sql(1 << 40, 71, 1 << 40)),
    "preflight_bytes": (lambda s, d: _first_breach(s, d, 1 << 40, 1 << 40, 99_999), _breach_sql(1 << 40, 1 << 40, 99_999)),
    "preflight_none": (lambda s, d: _first_breach(s, d, 1 << 40, 1 << 40, 1 << 40), _breach_sql(1 << 40, 1 << 40, 1 << 40)),
}
