"""Ranked lexical search over term-bucketed postings, with integer scores.

The index is a table of postings (bucket, term, doc_id, row, tf, n) in folders by a hash of the term. A search joins its
terms to the buckets that hold them, scores each match with integers, sums by item and document, and keeps the k best
by a window. Postings of a common term are spread over tasks by document, both in the index and in a search, so no task
holds a term and no scored match is shuffled: postings are dealt by document before they meet the items.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.llm.session import small
from corpusloom.llm.terms import WORDS, scanned
from corpusloom.sources.tables import fresh_path, materialize, table

BUCKETS = 64
#: Distinct terms that an index for known items may send to every task (some 20 MB); beyond it all terms are indexed.
KNOWN_TERMS = 1_000_000
#: Rows of item and term that a search joins at a time (some 20 MB); more go in blocks of items.
ITEM_ROWS = 200_000

POSTINGS = "term string, doc_id long, row long, tf long, n long"
RESULT = "item_id long, rank int, doc_id long, score long"


def bucket(term: str, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int").alias("bucket")


@dataclass(frozen=True)
class Index:
    """postings: the table. documents: those with a term. length: all their terms with repeats."""

    postings: DataFrame
    documents: int
    length: int


def _posted(rows: DataFrame, known: pa.Array | None) -> DataFrame:
    """A posting for each row and distinct term, and for each batch a row without term that holds its documents (tf) and terms (n).

    With ``known`` only its terms have postings.
    """
    sent = None if known is None else rows.sparkSession.sparkContext.broadcast(known)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(parts):
            with_terms = all_terms = 0
            for i, j, terms, row in scanned(batch.column("text"), WORDS):
                sizes = np.bincount(row, minlength=j)
                with_terms, all_terms = with_terms + int((sizes > 0).sum()), all_terms + len(terms)
                if sent is None:
                    coded = terms.dictionary_encode()
                    names, code = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
                else:
                    names, found = sent.value, pc.index_in(terms, value_set=sent.value)
                    own = found.is_valid().to_numpy(zero_copy_only=False)
                    code, row = found.fill_null(0).to_numpy(zero_copy_only=False)[own].astype(np.int64), row[own]
                if not len(code):
                    continue
                key, tf = np.unique(row * len(names) + code, return_counts=True)
                at, of = key // len(names), key % len(names)
                yield pa.RecordBatch.from_pydict({
                    "term": names.take(pa.array(of)), "doc_id": batch.column("doc_id").take(pa.array(at)), "row": batch.column("row").take(pa.array(at)),
                    "tf": pa.array(tf.astype(np.int64)), "n": pa.array(sizes[at].astype(np.int64)),
                })
            yield pa.RecordBatch.from_pydict({"term": pa.array([None], pa.string()), "doc_id": pa.array([None], pa.int64()), "row": pa.array([None], pa.int64()), "tf": [with_terms], "n": [all_terms]})

    return rows.mapInArrow(run, POSTINGS)


def item_terms(items: DataFrame) -> DataFrame:
    """item_id, term, times of all ``items`` (item_id, text); rows of one item_id are one item. Null texts have no term."""
    rows = items.select(F.col("item_id").cast("long").alias("doc_id"), "text", F.monotonically_increasing_id().alias("row"))
    own = _posted(rows, None).where("term is not null")
    return own.groupBy(F.col("doc_id").alias("item_id"), "term").agg(F.sum("tf").alias("times"))


def build_index(docs: DataFrame, asked: DataFrame | None = None, buckets: int = BUCKETS) -> Index:
    """The index of all ``docs`` (doc_id, text), written to the shared folder.

    With ``asked`` (item_id, term, times) only its terms are indexed, if they are at most ``KNOWN_TERMS``; counts are of
    all terms always. Every row is a document of its own, also repeated ids and null ids; a null text has no term.
    Other columns are ignored. An empty table gives an index without postings.
    """
    spark, known = docs.sparkSession, None
    if asked is not None:
        terms = asked.select("term").distinct()
        if terms.limit(KNOWN_TERMS + 1).count() <= KNOWN_TERMS:
            known = pa.array(sorted(r.term for r in terms.collect()), pa.string())
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.monotonically_increasing_id().alias("row"))
    # rows of a term go to a task by its bucket and the document's eighth part, so a common term is not one task's
    dealt = _posted(rows, known).select("*", bucket("term", buckets)).repartition("bucket", F.pmod(F.xxhash64("row"), F.lit(8)))
    path = fresh_path(spark, "postings")
    dealt.write.partitionBy("bucket").parquet(path)
    postings = spark.read.schema(f"{POSTINGS}, bucket int").parquet(path)
    totals = postings.where("term is null").agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("d"), F.coalesce(F.sum("n"), F.lit(0)).alias("l")).first()
    return Index(postings.where("term is not null"), totals.d, totals.l)


def term_weight(df: Column, documents: int) -> Column:
    """floor(1000 ln((2 N + 2) / (2 df + 1)))."""
    return F.floor(F.lit(1000.0) * F.log(F.lit(2.0 * documents + 2.0) / (F.lit(2.0) * df + F.lit(1.0)))).cast("long")


def match_score(weight: Column, tf: Column, n: Column, index: Index) -> Column:
    """Weight times 10**9 tf div (1000 tf + 8 m), where m is 25 and 75 n N div L; in 64-bit integers."""
    m = F.call_function("div", F.lit(75) * n * F.lit(index.documents), F.lit(index.length)) + F.lit(25) if index.length else F.lit(25)
    return weight * F.call_function("div", F.lit(1_000_000_000) * tf, F.lit(1000) * tf + F.lit(8) * m)


def _scored(index: Index, asked: DataFrame) -> DataFrame:
    """item_id, doc_id, row, score: the sum over matches, of terms that fit in one broadcast."""
    df = index.postings.groupBy("bucket", "term").agg(F.count("*").alias("df"))
    weighed = asked.select("*", bucket("term")).join(df, ["bucket", "term"]).select("term", "item_id", (F.col("times") * term_weight(F.col("df"), index.documents)).alias("_w")).where("_w > 0")
    by_document = index.postings.select("term", "doc_id", "row", "tf", "n").repartition("row")
    matches = by_document.join(F.broadcast(weighed), "term")  # at most ITEM_ROWS rows
    return matches.groupBy("row", "item_id", "doc_id").agg(F.sum(match_score(F.col("_w"), F.col("tf"), F.col("n"), index)).alias("score"))


def search(index: Index, asked: DataFrame, k: int) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of each item of ``asked`` (item_id, term, times), scores above 0.

    Equal scores go by doc_id, null last; rows that share an id take places of their own. Beyond ``ITEM_ROWS`` rows of
    items and terms, items are searched in blocks, each a pass over the postings.
    """
    blocks = -(-asked.count() // ITEM_ROWS) or 1
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "row")
    found = None
    for block in range(blocks):
        own = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block)
        best = _scored(index, own).where("score > 0").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        found = best if found is None else found.union(best)
    return found.select("item_id", "rank", "doc_id", "score")


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best of all documents for each benchmark item."""
    asked = materialize(item_terms(table(spark, sf_dir, "benchmark").select("item_id", "text")), "search-items")
    index = build_index(table(spark, sf_dir, "documents").select("doc_id", "text"), asked)
    return search(index, asked, 10)


ORACLE = r"""
with told as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as t from documents
), sums as (
  select count(*)::bigint as big_n, sum(len(t))::bigint as big_l from told where len(t) > 0
), posted as (
  select doc_id, n, term, count(*) as tf from (select doc_id, len(t) as n, unnest(t) as term from told) group by all
), weights as (
  select term, floor(1000 * ln((2.0::double * big_n + 2) / (2.0::double * df + 1)))::bigint as w
  from (select term, count(*) as df from posted group by term), sums
), asked as (
  select item_id, term, count(*) as times from (
    select item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from benchmark
  ) group by all
), scored as (
  select item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * big_n) // big_l))))::bigint as score
  from asked join posted using (term) join weights using (term), sums group by item_id, doc_id
)
select item_id, rank::int as rank, doc_id, score from (
  select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from scored where score > 0
) where rank <= 10
"""
