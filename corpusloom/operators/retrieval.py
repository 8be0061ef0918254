"""Ranked retrieval as joins: postings, corpus statistics, BM25 and term coverage.

Query terms are few and joined to the postings by hash, so Spark picks a broadcast by its own size
threshold; postings are aggregated before they meet anything.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.functions.text import bm25_tokens, lines
from corpusloom.operators.postings import PostingStore

K1, B = 1.5, 0.75


def postings(docs: DataFrame) -> DataFrame:
    """doc_id, token, tf, dl. Null texts have no postings."""
    tokens = docs.select("doc_id", bm25_tokens(F.col("text")).alias("_t"))
    return tokens.select("doc_id", F.size("_t").alias("dl"), F.explode("_t").alias("token")).groupBy("doc_id", "token", "dl").agg(F.count("*").alias("tf"))


def corpus_size(docs: DataFrame) -> DataFrame:
    """One row: n documents and avgdl, their mean number of tokens."""
    return docs.select(F.coalesce(F.size(bm25_tokens(F.coalesce("text", F.lit("")))), F.lit(0)).alias("_n")).agg(F.count("*").alias("n"), F.avg("_n").alias("avgdl"))


def idf(df: str, n: str):
    return F.log((F.col(n) - F.col(df) + 0.5) / (F.col(df) + 0.5) + 1)


def token_stats(docs: DataFrame) -> DataFrame:
    """token, df and idf over all documents."""
    df = postings(docs).groupBy("token").agg(F.count("*").alias("df"))
    return df.join(F.broadcast(corpus_size(docs))).select("token", "df", F.round(idf("df", "n"), 6).alias("idf"))  # one row


def bm25(docs: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of each query (item_id, text); repeated query words count again."""
    terms = queries.select("item_id", F.explode(bm25_tokens(F.col("text"))).alias("token")).groupBy("item_id", "token").agg(F.count("*").alias("times"))
    hits = postings(docs).join(terms.select("token").distinct(), "token", "left_semi")
    return _ranked(hits, terms, corpus_size(docs), k)


def _ranked(hits: DataFrame, terms: DataFrame, size: DataFrame, k: int) -> DataFrame:
    """The k best by BM25 from all postings of the query terms (doc_id, token, tf, dl) and the corpus's one row of size."""
    df = hits.groupBy("token").agg(F.count("*").alias("df"))
    scored = hits.join(df, "token").join(terms, "token").join(F.broadcast(size))
    part = F.col("times") * idf("df", "n") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    total = scored.groupBy("item_id", "doc_id").agg(F.round(F.sum(part), 6).alias("score")).where("score > 0")
    w = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    return total.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def bm25_stored(store: PostingStore, queries: DataFrame, k: int) -> DataFrame:
    """``bm25`` over the files of a stored index of ``bm25_tokens``, with their path: only the queries are tokenised."""
    terms = queries.select("item_id", F.explode(bm25_tokens(F.col("text"))).alias("token")).groupBy("item_id", "token").agg(F.count("*").alias("times"))
    hits = store.postings(terms.select(F.col("token").alias("term"))).select(F.col("path").alias("doc_id"), F.col("term").alias("token"), "tf", "dl")
    return _ranked(hits, terms, store.size(), k).withColumnRenamed("doc_id", "path")


def coverage(docs: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """item_id, rank, doc_id, covered: documents by how many distinct query tokens they have."""
    terms = queries.select("item_id", F.explode(F.array_distinct(bm25_tokens(F.col("text")))).alias("token"))
    hits = postings(docs).join(terms, "token").groupBy("item_id", "doc_id").agg(F.count("*").alias("covered"))
    w = Window.partitionBy("item_id").orderBy(F.desc("covered"), "doc_id")
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def grep(docs: DataFrame, pattern: str) -> DataFrame:
    """doc_id, line_no (from 1) and line of all lines that match."""
    found = docs.where(F.col("text").rlike(pattern))
    return found.select("doc_id", F.posexplode(lines(F.col("text"))).alias("_k", "line")).where(F.col("line").rlike(pattern)).select("doc_id", (F.col("_k") + 1).alias("line_no"), "line")


def line_windows(docs: DataFrame, size: int, overlap: int) -> DataFrame:
    """doc_id, chunk, start_line, end_line, sha256: windows of lines; the last one ends with the text."""
    own = docs.where("text is not null and text != ''").select("doc_id", lines(F.col("text")).alias("_l"))
    step = size - overlap
    n = F.greatest(F.lit(1), F.ceil((F.size("_l") - overlap) / step)).cast("int")
    rows = own.select("doc_id", "_l", F.explode(F.sequence(F.lit(0), n - 1)).alias("chunk"))
    first = F.col("chunk") * step
    return rows.select("doc_id", "chunk", (first + 1).alias("start_line"), F.least(first + size, F.size("_l")).alias("end_line"), F.sha2(F.array_join(F.slice("_l", first + 1, F.lit(size)), "\n"), 256).alias("sha256"))
