"""Queries over stored indexes that have followed three snapshots of their files, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions.text import bm25_tokens
from corpusloom.operators import retrieval as R
from corpusloom.operators import search as Q
from corpusloom.operators.postings import PostingStore, whole_files
from corpusloom.plans.retrieval import _POSTINGS, _bm25_sql
from corpusloom.plans.search import _SEARCH
from corpusloom.sources.tables import fresh_path, table

_C = F.col
ROUNDS = (1, 2, 3)


def snapshot(spark, sf, k: int):
    """path, modified, size, text of the documents as files in round k; in the last round they are as the table has them.

    Before the last round every fifth file lies in another folder, and in the second every third one has a line more.
    """
    docs = table(spark, sf, "documents").select("doc_id", "lang", "text")
    moved, longer = (_C("doc_id") % 5 == 0) & F.lit(k == 1), (_C("doc_id") % 3 == 0) & F.lit(k == 2)
    path = F.concat_ws("/", F.when(moved, "drafts"), F.lit("docs"), "lang", F.concat(_C("doc_id").cast("string"), F.lit(".md")))
    text = F.when(longer, F.concat("text", F.lit("\none more line of revised words"))).otherwise(_C("text"))
    since = F.when(_C("doc_id") % 3 == 0, k).otherwise(1)
    return docs.select(path.alias("path"), since.cast("long").alias("modified"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("size"), text.alias("text"))


def synced(spark, sf, units, tokens):
    """A store after all rounds, and the states of each round."""
    store, states = PostingStore(spark, fresh_path(spark, "posting-store"), units, tokens), []
    for k in ROUNDS:
        states.append(store.sync(snapshot(spark, sf, k)).withColumn("round", F.lit(k)))
    return store, states


def _docs_store(spark, sf):
    return synced(spark, sf, whole_files, lambda: bm25_tokens(_C("content")))


def _chunk_store(spark, sf):
    return synced(spark, sf, Q.code_chunks, Q.search_text)


def _states(spark, sf):
    _, states = _docs_store(spark, sf)
    union = states[0].union(states[1]).union(states[2])
    return union.groupBy("round", "state").agg(F.count("*").alias("files"))


def _bm25(spark, sf):
    store, _ = _docs_store(spark, sf)
    found = R.bm25_stored(store, table(spark, sf, "benchmark").select("item_id", "text"), 10)
    return found.select("item_id", "rank", "path", "score")


def _code(spark, sf):
    store, _ = _chunk_store(spark, sf)
    return Q.code_search_stored(store, table(spark, sf, "benchmark").select("item_id", "text"), 10)


def _by_path(sql: str) -> str:
    """The SQL of whole documents with their paths, by which ties go here."""
    return sql.replace("FROM documents)", "FROM (SELECT 'docs/' || lang || '/' || doc_id || '.md' AS doc_id, text FROM documents))").replace("SELECT item_id, doc_id, score, rank FROM ranked", "SELECT item_id, doc_id AS path, score, rank FROM ranked")


QUERIES = {
    "index_sync": (lambda s, d: _docs_store(s, d)[0].term_counts().withColumnRenamed("term", "token"), f"WITH {_POSTINGS} SELECT token, count(*) AS df, sum(tf)::BIGINT AS occurrences FROM post GROUP BY token"),
    "index_sync_states": (
        _states,
        """WITH r AS (SELECT unnest([1, 2, 3]) AS round), f AS (SELECT doc_id % 5 = 0 AS moved, doc_id % 3 = 0 AS edited FROM documents),
s AS (SELECT round, CASE WHEN round = 1 OR round = 2 AND moved THEN 'new' WHEN edited THEN 'changed' ELSE 'unchanged' END AS state FROM f, r
UNION ALL SELECT 2, 'stale' FROM f WHERE moved)
SELECT round::INT AS round, state, count(*) AS files FROM s GROUP BY ALL""",
    ),
    "bm25_stored": (_bm25, _by_path(_bm25_sql("", 10))),
    "code_search_stored": (_code, _SEARCH),
}
