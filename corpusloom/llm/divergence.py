"""Source divergence audit: how far the term shares of each source lie from those of the other sources of its language.

A group is a (lang, source). Over the V kept terms of a language, a pair of groups sums f(p, q) = (p - q)**2 div q. Most terms
are absent from one of the two or from both, and there f depends on one count or on none. By inclusion and exclusion over
the two supports,

    sum = f(z, z') (V - n - n') + sum over the one support f(p, z') + sum over the other f(z, p')
          + sum over both supports (f(p, p') - f(p, z') - f(z, p') + f(z, z'))

with z, z' the shares of a count of 0 and n, n' the sizes of the supports. The one-sided sums are priced from a histogram of
shares for each group; only the last sum joins postings, and only where two groups share a term.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.llm.session import small
from corpusloom.llm.terms import LETTERS, scanned
from corpusloom.sources.tables import materialize, table

UNIT = 1_000_000_000
COUNTS = "lang string, source string, term string, count long, df long"


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, count and df of all ``docs`` (text, lang, source); nulls are empty strings.

    Each group also has a row without term. Counts are summed in each task before they are shuffled.
    """

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(parts):
            groups = pa.StructArray.from_arrays([batch.column("lang"), batch.column("source")], ["lang", "source"])
            keys: dict[tuple[str, str], int] = {}
            group = np.array([keys.setdefault((g["lang"], g["source"]), len(keys)) for g in groups.to_pylist()], np.int64)
            lang, source = (pa.array([key[x] for key in keys], pa.string()) for x in (0, 1))
            none = pa.array(np.zeros(len(keys), np.int64))
            yield pa.RecordBatch.from_arrays([lang, source, pa.nulls(len(keys), pa.string()), none, none], ["lang", "source", "term", "count", "df"])
            for _, _, terms, row in scanned(batch.column("text"), LETTERS):
                if not len(terms):
                    continue
                coded = terms.dictionary_encode()
                names, code = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
                once, tf = np.unique(row * len(names) + code, return_counts=True)  # a row for each document and term
                cell, at = np.unique(group[once // len(names)] * len(names) + once % len(names), return_inverse=True)
                of = pa.array(cell // len(names))
                count, df = np.bincount(at, weights=tf, minlength=len(cell)).astype(np.int64), np.bincount(at, minlength=len(cell)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([lang.take(of), source.take(of), names.take(pa.array(cell % len(names))), pa.array(count), pa.array(df)], ["lang", "source", "term", "count", "df"])

    told = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")])
    return told.mapInArrow(run, COUNTS).groupBy("lang", "source", "term").agg(F.sum("count").alias("count"), F.sum("df").alias("df"))


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + 10**9 (count + 1) div (total + terms); decimals, as the product may pass 64 bits."""
    product = (count + 1).cast("decimal(20,0)") * F.lit(UNIT).cast("decimal(10,0)")
    return F.call_function("div", product, (total + terms).cast("decimal(20,0)")) + 1


def gap(p: Column, q: Column) -> Column:
    """(p - q)**2 div q; shares are at most 10**9 + 1, so the square stays in 64 bits."""
    return F.call_function("div", (p - q) * (p - q), q)


def _kept(counts: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """(postings of kept terms: lang, source, term, count, p, z, of, q; groups: lang, source, terms, total, held, z).

    A term is kept where its language has it in ``least`` documents. p and q are the shares in the group and in the language,
    z the group's share of a count of 0, terms the language's V, total the group's N and held the terms it has.
    """
    by_term = Window.partitionBy("lang", "term")  # a row for each source at most
    own = counts.where("term is not null").withColumns({"_df": F.sum("df").over(by_term), "_all": F.sum("count").over(by_term), "_first": F.row_number().over(by_term.orderBy("source"))})
    kept = materialize(own.where(F.col("_df") >= least).select("lang", "source", "term", "count", "_all", "_first"), "divergence-kept")
    held = kept.groupBy("lang", "source").agg(F.sum("count").alias("total"), F.count("*").alias("held"))
    langs = kept.groupBy("lang").agg(F.sum((F.col("_first") == 1).cast("long")).alias("terms"), F.sum("count").alias("_of_lang"))
    groups = counts.where("term is null").select("lang", "source").join(held, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0)
    empty = F.col("terms") == 0  # no kept term, no share
    groups = materialize(groups.withColumn("z", F.when(empty, F.lit(1)).otherwise(share(F.lit(0), F.col("total"), F.greatest("terms", F.lit(1))))), "divergence-groups")
    wide = kept.join(groups, ["lang", "source"])  # a row for each group
    priced = wide.select("lang", "source", "term", "count", share(F.col("count"), F.col("total"), F.col("terms")).alias("p"), "z", share(F.col("_all"), F.col("_of_lang"), F.col("terms")).alias("q"))
    return materialize(priced, "divergence-postings"), groups


def pair_sums(postings: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item, value: the sum of f over all kept terms for each group and other source of its language."""
    other = groups.select("lang", F.col("source").alias("item"), F.col("held").alias("_held"), F.col("z").alias("_z"))
    bins = postings.groupBy("lang", "source", "p").agg(F.count("*").alias("n"), F.first("z").alias("z"))  # the histograms
    priced = bins.join(other, "lang").where("source != item")
    ours = priced.groupBy("lang", "source", "item").agg(F.sum(F.col("n") * gap(F.col("p"), F.col("_z"))).alias("_ours"), F.sum(F.col("n") * gap(F.col("_z"), F.col("p"))).alias("_theirs"))
    one = ours.select("lang", "source", "item", "_ours")
    two = ours.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "_theirs")  # seen from the other group
    left, right = postings.select("lang", "term", "source", "p", "z"), postings.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("_p"), F.col("z").alias("_z"))
    both = left.join(right, ["lang", "term"]).where("source < item")
    p, z, p2, z2 = (F.col(c) for c in ("p", "z", "_p", "_z"))
    mend = lambda a, b, c, d: F.sum(gap(a, c) - gap(a, d) - gap(b, c) + gap(b, d))
    sums = materialize(both.groupBy("lang", "source", "item").agg(mend(p, z, p2, z2).alias("_there"), mend(p2, z2, p, z).alias("_back")), "divergence-overlaps")
    there = sums.select("lang", "source", "item", F.col("_there").alias("_both")).union(sums.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "_back"))
    pairs = groups.join(other, "lang").where("source != item")
    for part in (one, two, there):
        pairs = pairs.join(part, ["lang", "source", "item"], "left")
    constant = gap(F.col("z"), F.col("_z")) * (F.col("terms") - F.col("held") - F.col("_held"))
    value = constant + sum((F.coalesce(c, F.lit(0)) for c in ("_ours", "_theirs", "_both")), F.lit(0))
    return pairs.select("lang", "source", "item", F.when(F.col("terms") == 0, F.lit(0)).otherwise(value).cast("long").alias("value"))


def top_terms(postings: DataFrame, most: int) -> DataFrame:
    """lang, source, item, value, rank: the terms that a group has above its language's share, the ``most`` farthest."""
    own = postings.where("p > q").select("lang", "source", F.col("term").alias("item"), gap(F.col("p"), F.col("q")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")  # cut in each task before it is shuffled
    return own.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def audit(docs: DataFrame, least: int = 3, most: int = 200) -> DataFrame:
    """lang, source, part, item, value, rank of all ``docs`` (text, lang, source).

    Part ``pair``: each other source of the language, farthest first. Part ``term``: the group's terms above the language's share,
    the ``most`` farthest. Null text, lang and source count as empty strings; repeated rows count again; a language without
    kept terms has pairs of value 0 and no terms; ties go by item. An empty table gives no rows. Other columns are ignored.
    """
    counts = materialize(term_counts(docs), "divergence-counts")
    postings, groups = _kept(counts, least)
    pairs = pair_sums(postings, groups)
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")  # a row for each source of the language
    ranked = pairs.withColumn("rank", F.row_number().over(order))
    shape = ("lang", "source", "part", "item", "value", "rank")
    return ranked.withColumn("part", F.lit("pair")).select(*shape).union(top_terms(postings, most).withColumn("part", F.lit("term")).select(*shape))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit of all documents: terms in at least 3 documents of a language, 200 terms a group."""
    return audit(table(spark, sf_dir, "documents").select("text", "lang", "source"))


ORACLE = r"""
with told as (
  select row_number() over () as row, coalesce(lang, '') as lang, coalesce(source, '') as source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as t
  from documents
), words as (select row, lang, source, unnest(t) as term from told
), kept as (select lang, term from words group by lang, term having count(distinct row) >= 3
), counts as (select lang, source, term, count(*)::hugeint as c from words join kept using (lang, term) group by all
), groups as (select distinct lang, source from told
), v as (select lang, count(*)::hugeint as v from kept group by lang
), sums as (select lang, source, coalesce(sum(c), 0)::hugeint as n from groups left join counts using (lang, source) group by all
), shares as (
  select g.lang, g.source, k.term, coalesce(c, 0) as c, 1 + (1000000000::hugeint * (coalesce(c, 0) + 1)) // (n + v) as p
  from groups g join kept k using (lang) join v using (lang) join sums using (lang, source) left join counts using (lang, source, term)
), langs as (
  select lang, term, 1 + (1000000000::hugeint * (c + 1)) // (sum(c) over (partition by lang) + v) as q
  from (select lang, term, sum(c)::hugeint as c from counts group by all) join v using (lang)
), pairs as (
  select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // b.p) as value
  from shares a join shares b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all
), every as (
  select g.lang, g.source, 'pair' as part, h.source as item, coalesce(value, 0)::bigint as value
  from groups g join groups h on g.lang = h.lang and g.source <> h.source
  left join pairs on pairs.lang = g.lang and pairs.source = g.source and pairs.item = h.source
  union all
  select lang, source, 'term', term, ((p - q) * (p - q) // q)::bigint from shares join langs using (lang, term) where c > 0 and p > q
)
select lang, source, part, item, value, rank::int as rank from (
  select *, row_number() over (partition by lang, source, part order by value desc, item) as rank from every
) where part = 'pair' or rank <= 200
"""
