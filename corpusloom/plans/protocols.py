"""Plan logs from events, answers and JSON heads from documents, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import protocol as P
from corpusloom.operators import planlog as L
from corpusloom.sources.tables import table

_C = F.col


def operations(spark, sf):
    """A log of plan operations: signups set plans, purchases read or clear them, other events move an item on; some are faulty."""
    e, n = table(spark, sf, "events"), _C("event_id")
    letter = lambda x: F.get(F.array(*[F.lit(c) for c in "abcdefgh"]), x.cast("int"))
    status = lambda k: F.when((n % 6 == 0) & (k == 0), "in_progress").otherwise("pending")
    item = lambda k: F.struct(F.concat(F.lit(" "), F.when(n % 11 == 0, "a").otherwise(letter(k))).alias("id"), F.concat(F.lit("step "), k.cast("string")).alias("text"), status(k).alias("status"))
    items = F.when(n % 13 == 0, F.array().cast(L.ITEMS)).otherwise(F.transform(F.sequence(F.lit(0), F.lit(1) + n % 4), item))
    action = F.when(_C("event_type") == "signup", "set").when((_C("event_type") == "purchase") & (n % 3 == 0), "clear").when(_C("event_type") == "purchase", "get").otherwise("update")
    step = F.get(F.array(*map(F.lit, L.STATUSES)), (F.floor(n / 4) % 3).cast("int"))
    return e.select(
        _C("user_id").cast("string").alias("workspace"), n.alias("seq"), action.alias("action"), F.when(action == "set", items).alias("items"),
        F.when((action == "update") | ((action == "get") & (n % 10 == 1)), letter(n % 4)).alias("item"), F.when((action == "update") & (n % 17 != 0), step).alias("status"),
    )


_IDS = "['a', 'b', 'c', 'd', 'e', 'f', 'g', 'h']"
_FOLD = f"""op AS (SELECT CAST(user_id AS VARCHAR) AS workspace, event_id AS seq, event_id AS n, CASE WHEN event_type = 'signup' THEN 'set' WHEN event_type = 'purchase' AND event_id % 3 = 0 THEN 'clear' WHEN event_type = 'purchase' THEN 'get' ELSE 'update' END AS action FROM events),
o2 AS (SELECT workspace, seq, action, row_number() OVER (PARTITION BY workspace ORDER BY seq) AS rn,
CASE WHEN action <> 'set' THEN NULL WHEN n % 13 = 0 THEN [] ELSE list_transform(range(0, 2 + n % 4), lambda k: {{'id': CASE WHEN n % 11 = 0 THEN 'a' ELSE {_IDS}[k + 1] END, 'text': 'step ' || k, 'status': CASE WHEN n % 6 = 0 AND k = 0 THEN 'in_progress' ELSE 'pending' END}}) END AS items,
CASE WHEN action = 'update' OR action = 'get' AND n % 10 = 1 THEN {_IDS}[n % 4 + 1] END AS item,
CASE WHEN action = 'update' AND n % 17 <> 0 THEN ['pending', 'in_progress', 'completed'][(n // 4) % 3 + 1] END AS status FROM op),
o AS (SELECT *, CASE WHEN action = 'set' AND len(items) = 0 THEN 'set needs items' WHEN action = 'set' AND len(list_distinct(list_transform(items, lambda x: x.id))) < len(items) THEN 'repeated id'
WHEN action = 'update' AND status IS NULL THEN 'update needs a status' WHEN action IN ('get', 'clear') AND item IS NOT NULL THEN 'takes the workspace only' END AS fault FROM o2),
s AS (SELECT DISTINCT workspace, CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS seq, '' AS action, false AS held, CAST([] AS STRUCT(id VARCHAR, text VARCHAR, status VARCHAR)[]) AS items, CAST(NULL AS VARCHAR) AS fault, CAST(NULL AS VARCHAR) AS conflict, false AS changed FROM o
UNION ALL
SELECT workspace, rn, seq, action, CASE WHEN fault IS NOT NULL THEN held WHEN action = 'set' THEN true WHEN action = 'clear' THEN false ELSE held END,
CASE WHEN fault IS NOT NULL OR conflict IS NOT NULL THEN items WHEN action = 'set' THEN new WHEN action = 'clear' THEN [] WHEN action = 'update' THEN list_transform(items, lambda x: {{'id': x.id, 'text': x.text, 'status': CASE WHEN x.id = item THEN status ELSE x.status END}}) ELSE items END,
fault, conflict,
fault IS NULL AND conflict IS NULL AND CASE action WHEN 'set' THEN NOT held OR new <> items WHEN 'clear' THEN held WHEN 'update' THEN now <> status ELSE false END
FROM (SELECT *, CASE WHEN action = 'update' AND fault IS NULL THEN CASE WHEN NOT held THEN 'no plan' WHEN now IS NULL THEN 'no such item' WHEN now = status THEN NULL
  WHEN NOT (now = 'pending' AND status = 'in_progress' OR now = 'in_progress' AND status = 'completed') THEN 'no such step'
  WHEN status = 'in_progress' AND len(list_filter(items, lambda x: x.status = 'in_progress' AND x.id <> item)) > 0 THEN 'another item in progress' END END AS conflict
 FROM (SELECT o.workspace, o.rn, o.seq, o.action, o.item, o.status, o.fault, o.items AS new, s.held, s.items, list_filter(s.items, lambda x: x.id = o.item)[1].status AS now FROM s JOIN o ON o.workspace = s.workspace AND o.rn = s.rn + 1)))"""


def answers(spark, sf):
    """Texts with some sentence starts turned into the lines of an answer."""
    text = _C("text")
    for form, line in ((r"\. T", "\nPath: docs/t.md (L3-L9)\nt"), (r"\. D", "\n### remote backend: dd \nd"), (r"\. L", "\nPath: l/x \nLines: L4-L7\n...\n"), (r"\. E", "\n[index metadata] e\n \n"), (r"\. A", "\r\nPath: a b(1).rs\nPath: q\n")):
        text = F.regexp_replace(text, form, line)
    return table(spark, sf, "documents").select("doc_id", text.alias("text"))


def braces(spark, sf):
    """Texts in which some letters stand for braces, quotes and backslashes."""
    return table(spark, sf, "documents").select("doc_id", F.translate("text", "kaoIpi.", '{{}"\\\\"').alias("text"))


_ANSWERS = r"""t0 AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\. T', E'\nPath: docs/t.md (L3-L9)\nt', 'g'), '\. D', E'\n### remote backend: dd \nd', 'g'), '\. L', E'\nPath: l/x \nLines: L4-L7\n...\n', 'g'), '\. E', E'\n[index metadata] e\n \n', 'g'), '\. A', E'\r\nPath: a b(1).rs\nPath: q\n', 'g') AS text FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM t0),
m AS (SELECT doc_id, k, rtrim(raw, chr(13)) AS line, starts_with(raw, 'Path: ') AS p, regexp_matches(raw, '^### [a-z]+ backend: ') AS b FROM l),
g AS (SELECT *, sum(CASE WHEN p OR b THEN 1 ELSE 0 END) OVER w AS sec, last_value(CASE WHEN b THEN trim(substr(line, 21)) END IGNORE NULLS) OVER w AS named FROM m WINDOW w AS (PARTITION BY doc_id ORDER BY k ROWS UNBOUNDED PRECEDING)),
s AS (SELECT doc_id, sec, any_value(coalesce(named, 'local')) AS backend, max(CASE WHEN p THEN trim(substr(line, 7)) END) AS path, string_agg(CASE WHEN starts_with(line, 'Lines: L') THEN ':' || replace(trim(substr(line, 9)), '-L', '-') END, '' ORDER BY k) AS ranges,
string_agg(CASE WHEN NOT p AND NOT b AND NOT starts_with(line, 'Lines: L') AND NOT starts_with(line, '[index metadata]') AND trim(line) NOT IN ('', '...') THEN rtrim(line) END, chr(10) ORDER BY k) AS excerpt FROM g GROUP BY doc_id, sec)"""

QUERIES = {
    "plan_states": (
        lambda s, d: L.plan_outcomes(operations(s, d)),
        f"""WITH RECURSIVE {_FOLD} SELECT workspace, seq, action, CASE WHEN fault IS NOT NULL THEN 'invalid' WHEN conflict IS NOT NULL THEN 'conflict' ELSE 'ok' END AS outcome, coalesce(fault, conflict) AS error, changed,
CAST(len(list_filter(items, lambda x: x.status = 'completed')) AS INT) AS completed, CAST(len(items) AS INT) AS total FROM s WHERE rn > 0""",
    ),
    "plan_items": (
        lambda s, d: L.plan_items(operations(s, d)),
        f"WITH RECURSIVE {_FOLD}, z AS (SELECT workspace, unnest(items) AS i, generate_subscripts(items, 1) - 1 AS pos FROM (SELECT workspace, arg_max(items, rn) AS items FROM s GROUP BY workspace)) SELECT workspace, CAST(pos AS INT) AS pos, i.id AS id, i.text AS text, i.status AS status FROM z",
    ),
    "result_sections": (
        lambda s, d: answers(s, d).select("doc_id", F.posexplode(P.sections(_C("text"), "local")).alias("n", "_s")).select("doc_id", "n", "_s.backend", "_s.location", F.sha2("_s.excerpt", 256).alias("sha256")),
        f"""WITH {_ANSWERS} SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY sec) - 1 AS INT) AS n, backend, CASE WHEN path = 'docs/t.md (L3-L9)' THEN 'docs/t.md:3-9' ELSE path END || coalesce(ranges, '') AS location, sha256(excerpt) AS sha256
FROM s WHERE path IS NOT NULL AND excerpt IS NOT NULL""",
    ),
    "json_prefix": (
        lambda s, d: braces(s, d).select("doc_id", P.object_end(_C("text")).alias("end_at"), F.length(P.json_head(_C("text"))).alias("head_length")),
        r"""WITH t AS (SELECT doc_id, translate(text, 'kaoIpi.', '{{}"\\"') AS x FROM documents),
u AS (SELECT doc_id, x, CASE WHEN instr(x, '{') > 0 THEN substr(x, instr(x, '{')) END AS y FROM t),
f AS (SELECT doc_id, list_reduce([{'d': 0, 'n': 0, 'e': -1, 's': ''}] || list_transform(regexp_extract_all(x, '"(?:[^"\\]|\\[\s\S])*"?|[{}]|[^"{}]+'), lambda p: {'d': 0, 'n': CAST(length(p) AS INT), 'e': -1, 's': p}),
 lambda a, b: {'d': CASE b.s WHEN '{' THEN a.d + 1 WHEN '}' THEN greatest(a.d - 1, 0) ELSE a.d END, 'n': a.n + b.n, 'e': CASE WHEN a.e >= 0 THEN a.e WHEN b.s = '}' AND a.d <= 1 THEN a.n + b.n ELSE -1 END, 's': ''}).e AS e FROM t WHERE x IS NOT NULL),
h AS (SELECT doc_id, list_reduce([{'d': 0, 'n': 0, 'e': -1, 's': ''}] || list_transform(regexp_extract_all(y, '"(?:[^"\\]|\\[\s\S])*"?|[{}]|[^"{}]+'), lambda p: {'d': 0, 'n': CAST(length(p) AS INT), 'e': -1, 's': p}),
 lambda a, b: {'d': CASE b.s WHEN '{' THEN a.d + 1 WHEN '}' THEN greatest(a.d - 1, 0) ELSE a.d END, 'n': a.n + b.n, 'e': CASE WHEN a.e >= 0 THEN a.e WHEN b.s = '}' AND a.d <= 1 THEN a.n + b.n ELSE -1 END, 's': ''}).e AS e FROM u WHERE y IS NOT NULL)
SELECT doc_id, nullif(f.e, -1) AS end_at, nullif(h.e, -1) AS head_length FROM t LEFT JOIN f USING (doc_id) LEFT JOIN h USING (doc_id)""",
    ),
}
