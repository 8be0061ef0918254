"""Similar entries among the part names, a catalogue of fixed vocabulary, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.operators import nearness as N
from corpusloom.plans.likeness import scored_ctes
from corpusloom.sources.tables import table

TAU, UPSERT = 0.62, 0.7


def _entries(spark, sf):
    names = table(spark, sf, "part").groupBy(F.col("p_name").alias("text")).agg(F.min("p_partkey").alias("id"))
    return names.select("id", F.substring_index("text", " ", -1).alias("category"), "text")


def _queries(spark, sf):
    """Each name with its first word turned round, as texts that come in."""
    rows = _entries(spark, sf)
    return rows.select(F.col("id").alias("query_id"), "category", F.when(F.col("id") % 3 == 0, F.upper("text")).otherwise(F.concat(F.reverse(F.substring_index("text", " ", 1)), F.lit(" "), F.col("category"))).alias("text"))


_ENTRIES = "entries AS (SELECT min(p_partkey) AS id, string_split(p_name, ' ')[-1] AS category, p_name AS text FROM part GROUP BY p_name)"
_PAIRS = f"""{_ENTRIES}, {scored_ctes("SELECT {'a': o.id, 'b': t.id} AS key, o.text AS a, t.text AS b FROM entries o JOIN entries t ON o.category = t.category AND o.id < t.id")},
pairs AS (SELECT key.a AS a, key.b AS b, greatest(mixed, contained, bigrams) AS score FROM m WHERE greatest(mixed, contained, bigrams) >= {TAU})"""
_GROUPS = """edges AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs), reach AS (SELECT a AS id, b AS other FROM edges UNION SELECT r.id, e.b FROM reach r JOIN edges e ON r.other = e.a),
member AS (SELECT id, least(id, min(other)) AS "group" FROM reach GROUP BY id)"""
_NEAREST = f"""{_ENTRIES}, queries AS (SELECT id AS query_id, category, CASE WHEN id % 3 = 0 THEN upper(text) ELSE reverse(string_split(text, ' ')[1]) || ' ' || category END AS text FROM entries),
{scored_ctes("SELECT {'q': query_id, 'id': id} AS key, q.text AS a, e.text AS b FROM queries q JOIN entries e ON q.category = e.category")},
best AS (SELECT key.q AS query_id, key.id AS id, greatest(mixed, contained, bigrams) AS score FROM m QUALIFY row_number() OVER (PARTITION BY key.q ORDER BY greatest(mixed, contained, bigrams) DESC, key.id) = 1)"""

def _dated(spark, sf):
    """Entries with the day of their last change; many share one."""
    return _entries(spark, sf).withColumn("updated", F.timestamp_seconds(F.col("id") % 3 * 86400))


def _preview(spark, sf, **more):
    found = N.cleanup_preview(_dated(spark, sf), TAU, **more)
    return found.withColumn("group_score", F.round("group_score", 6))


def _plan(spark, sf):
    """What the preview proposes, as a plan."""
    found = N.cleanup_preview(_dated(spark, sf), TAU)
    keep = found.where("keep").select("group", F.col("id").alias("keep_id"))
    return found.select("group", F.col("id").alias("delete_id")).join(keep, "group")


def _apply(spark, sf):
    stay, removed = N.apply_plan(_dated(spark, sf), _plan(spark, sf))
    return stay.select("id", F.lit(None).cast("long").alias("group")).union(removed.select("id", "group"))


def _faults(spark, sf):
    """Faults of the plan once some entries have got other ids."""
    moved = _dated(spark, sf).withColumn("id", F.when(F.col("id") % 4 == 1, F.col("id") + 100000).otherwise(F.col("id")))
    return N.plan_faults(moved, _plan(spark, sf))


_PREVIEW = """best AS (SELECT "group", max(score) AS group_score FROM pairs JOIN member ON pairs.a = member.id GROUP BY 1),
ranked AS (SELECT *, row_number() OVER (ORDER BY group_score DESC, "group") AS group_rank FROM best),
rows_ AS (SELECT member.id, member."group", {category} AS category, id % 3 AS day, strlen(text) AS n FROM member JOIN entries USING (id)),
kept AS (SELECT *, row_number() OVER (PARTITION BY "group" ORDER BY day DESC, n DESC, id) = 1 AS keep FROM rows_),
preview AS (SELECT "group", CAST(group_rank AS INT) AS group_rank, round(group_score, 6) AS group_score, category, CAST(row_number() OVER (PARTITION BY "group" ORDER BY keep DESC, id) AS INT) AS place, id, keep FROM kept JOIN ranked USING ("group"))"""
_OWN = f"{_PAIRS}, {_GROUPS}, {_PREVIEW.format(category='category')}"
_PLAN = f'{_OWN}, plan AS (SELECT "group", id AS delete_id, max(CASE WHEN keep THEN id END) OVER (PARTITION BY "group") AS keep_id FROM preview)'
_SOME = _OWN.replace("ON o.category = t.category AND o.id < t.id", "ON o.category = t.category AND o.id < t.id WHERE o.category IN ('gear', 'bolt')")
_ALL = f"{_PAIRS}, {_GROUPS}, {_PREVIEW.format(category=chr(39) + 'mixed' + chr(39))}".replace("ON o.category = t.category AND o.id < t.id", "ON o.id < t.id").replace(f">= {TAU}", ">= 0.9")

QUERIES = {
    "pairs_above_tau": (lambda s, d: N.pairs_above(_entries(s, d), TAU).withColumn("score", F.round("score", 6)), f"WITH {_PAIRS} SELECT a, b, round(score, 6) AS score FROM pairs"),
    "clusters_keep_best": (
        lambda s, d: N.cleanup(_entries(s, d), TAU).withColumn("group_score", F.round("group_score", 6)),
        f"""WITH RECURSIVE {_PAIRS}, {_GROUPS}, best AS (SELECT "group", max(score) AS group_score FROM pairs JOIN member ON pairs.a = member.id GROUP BY 1)
SELECT member.id, member."group", round(group_score, 6) AS group_score, row_number() OVER (PARTITION BY member."group" ORDER BY length(text) DESC, member.id) = 1 AS keep
FROM member JOIN entries ON member.id = entries.id JOIN best ON best."group" = member."group" """,
    ),
    "cleanup_totals": (
        lambda s, d: N.cleanup(_entries(s, d), TAU).agg(F.count_distinct("group").alias("groups"), F.count_if(~F.col("keep")).alias("deletes")),
        f'WITH RECURSIVE {_PAIRS}, {_GROUPS} SELECT count(DISTINCT "group") AS groups, count(*) - count(DISTINCT "group") AS deletes FROM member',
    ),
    "greedy_dedup": (
        lambda s, d: N.greedy(_entries(s, d), TAU),
        f"""WITH RECURSIVE {_PAIRS}, e AS (SELECT entries.id, row_number() OVER (ORDER BY entries.id) AS k, coalesce(near, []) AS near FROM entries LEFT JOIN (SELECT b AS id, list(a) AS near FROM pairs GROUP BY b) USING (id)),
g AS (SELECT CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS kept UNION ALL SELECT e.k, CASE WHEN len(list_intersect(g.kept, e.near)) = 0 THEN list_append(g.kept, e.id) ELSE g.kept END FROM g JOIN e ON e.k = g.k + 1)
SELECT id, list_contains((SELECT kept FROM g ORDER BY k DESC LIMIT 1), id) AS kept FROM e""",
    ),
    "exists_duplicate": (
        lambda s, d: _entries(s, d).join(N.pairs_above(_entries(s, d), TAU).select(F.col("b").alias("id")), "id", "left_semi").select("id", "text"),
        f"WITH {_PAIRS} SELECT id, text FROM entries WHERE id IN (SELECT b FROM pairs)",
    ),
    "nearest_match": (lambda s, d: N.nearest(_queries(s, d), _entries(s, d), UPSERT).withColumn("score", F.round("score", 6)), f"WITH {_NEAREST} SELECT query_id, round(score, 6) AS score, CASE WHEN score >= {UPSERT} THEN id END AS id FROM best"),
    "upsert_outcome": (
        lambda s, d: N.upsert_outcome(_queries(s, d), _entries(s, d), UPSERT),
        f"WITH {_NEAREST} SELECT query_id, CASE WHEN score >= 1 THEN 'ignored' WHEN score >= {UPSERT} THEN 'updated' ELSE 'added' END AS outcome, CASE WHEN score >= {UPSERT} THEN id END AS id FROM best",
    ),
    "cleanup_preview": (_preview, f"WITH RECURSIVE {_OWN} SELECT * FROM preview"),
    "cleanup_of_categories": (lambda s, d: _preview(s, d, categories=("gear", "bolt")), f"WITH RECURSIVE {_SOME} SELECT * FROM preview"),
    "cleanup_across": (
        lambda s, d: N.cleanup_preview(_dated(s, d), 0.9, across=True).withColumn("group_score", F.round("group_score", 6)),
        f"WITH RECURSIVE {_ALL} SELECT * FROM preview",
    ),
    "cleanup_apply": (_apply, f'WITH RECURSIVE {_PLAN} SELECT id, CASE WHEN id IN (SELECT delete_id FROM plan WHERE delete_id <> keep_id) THEN "group" END AS "group" FROM entries LEFT JOIN (SELECT delete_id AS id, "group" FROM plan) USING (id)'),
    "plan_faults": (
        _faults,
        f"""WITH RECURSIVE {_PLAN} SELECT DISTINCT "group", keep_id AS id, 'keep' AS role FROM plan WHERE keep_id % 4 = 1 UNION ALL SELECT "group", delete_id, 'delete' FROM plan WHERE delete_id <> keep_id AND delete_id % 4 = 1""",
    ),
    "dedup_stats": (
        lambda s, d: N.dedup_stats(N.greedy(_entries(s, d), TAU)),
        f"""WITH RECURSIVE {_PAIRS}, e AS (SELECT entries.id, row_number() OVER (ORDER BY entries.id) AS k, coalesce(near, []) AS near FROM entries LEFT JOIN (SELECT b AS id, list(a) AS near FROM pairs GROUP BY b) USING (id)),
g AS (SELECT CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS kept UNION ALL SELECT e.k, CASE WHEN len(list_intersect(g.kept, e.near)) = 0 THEN list_append(g.kept, e.id) ELSE g.kept END FROM g JOIN e ON e.k = g.k + 1)
SELECT (SELECT count(*) FROM e) AS original, (SELECT count(*) FROM e) - len(kept) AS removed, len(kept) AS remaining FROM g ORDER BY k DESC LIMIT 1""",
    ),
}
