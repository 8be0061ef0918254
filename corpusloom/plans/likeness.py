"""Similarity scores of a part's name and its type with the name's last word, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import similarity as S
from corpusloom.sources.tables import table


def _scores(spark, sf):
    """p_partkey, scores. Names repeat, so each distinct pair is scored once and joined back."""
    rows = table(spark, sf, "part").select("p_partkey", F.col("p_name").alias("one"), F.concat(F.substring_index("p_name", " ", -1), F.lit(", "), F.col("p_type")).alias("two"))
    pairs = rows.select("one", "two").distinct()
    a, b = F.col("one"), F.col("two")
    x, y = S.normalized(a), S.normalized(b)
    scores = {
        "edit": S.edit_similarity(x, y), "phrase": S.phrase_similarity(x, y), "chars": S.set_similarity(x, y),
        "bigrams": S.bigram_similarity(a, b), "contained": S.contained_similarity(a, b), "mixed": S.mixed_similarity(a, b), "best": S.best_similarity(a, b),
    }
    scored = pairs.select("one", "two", *[F.round(v, 6).alias(k) for k, v in scores.items()])
    return rows.join(scored, ["one", "two"]).select("p_partkey", *scores)


def _near(a: str, b: str) -> str:
    return f"list_sum(list_transform({a}, lambda c, i: (len({b}) - least(coalesce(list_min(list_transform({b}, lambda d, j: CASE WHEN c = d THEN abs(i - j) END)), len({b})), len({b}))) / len({b}))) / len({a})"


def scored_ctes(pairs: str) -> str:
    """CTEs down to ``m`` (key, edit, phrase, chars, bigrams, contained, mixed) from a query of key, a and b."""
    return f"""p AS ({pairs}),
n AS (SELECT key, lower(trim(regexp_replace(translate(a, '.,!?;:"()[]{{}}', ''), '\\s+', ' ', 'g'))) AS x, lower(trim(regexp_replace(translate(b, '.,!?;:"()[]{{}}', ''), '\\s+', ' ', 'g'))) AS y FROM p),
c AS (SELECT *, string_split(x, '') AS cx, string_split(y, '') AS cy, list_transform(range(1, length(x)), lambda i: substr(x, i, 2)) AS bx, list_transform(range(1, length(y)), lambda i: substr(y, i, 2)) AS by_ FROM n),
s AS (SELECT key, x, y, 1 - levenshtein(x, y) / greatest(length(x), length(y)) AS edit, ({_near("cx", "cy")} + {_near("cy", "cx")}) / 2 AS phrase,
len(list_intersect(cx, cy)) / len(list_distinct(cx || cy)) AS chars, len(list_intersect(bx, by_)) / len(list_distinct(bx || by_)) AS bigrams,
CASE WHEN contains(y, x) AND length(x) <= length(y) OR contains(x, y) THEN least(1, 0.8 + 0.2 * least(length(x), length(y)) / greatest(length(x), length(y))) ELSE 0 END::DOUBLE AS contained FROM c),
m AS (SELECT *, CASE WHEN x = y THEN 1 ELSE 0.4 * edit + 0.4 * phrase + 0.2 * chars END AS mixed FROM s)"""


_SQL = f"""WITH {scored_ctes("SELECT p_partkey AS key, p_name AS a, string_split(p_name, ' ')[-1] || ', ' || p_type AS b FROM part")}
SELECT key AS p_partkey, round(edit, 6) AS edit, round(phrase, 6) AS phrase, round(chars, 6) AS chars, round(bigrams, 6) AS bigrams, round(contained, 6) AS contained, round(mixed, 6) AS mixed, round(greatest(mixed, contained, bigrams), 6) AS best FROM m"""

QUERIES = {"similarity_scores": (_scores, _SQL)}
