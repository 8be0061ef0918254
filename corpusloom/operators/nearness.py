"""Similar entries of a collection: pairs within a category, groups, greedy removal, nearest match and upsert.

Entries have id, category and text. No key foretells ``best_similarity``, so each pair of a category is looked at; what is cheap
is worked out first, and the whole score only where it can reach the threshold. These operators are for catalogues of short entries and
grow with the square of a category, which is dealt to ``PARTS`` tasks. Links between long documents are another task, for which
shingles give keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.functions.similarity import best_similarity, bigram_similarity, contained_similarity, edit_similarity, normalized, set_similarity
from corpusloom.sources.tables import materialize


#: Parts in which the first entries of a category's pairs are dealt; so no category is one task's work.
PARTS = 16


def similar_enough(one: Column, two: Column, tau: float) -> Column:
    """``best_similarity`` where it can reach ``tau``, else null.

    Containment, pairs of characters, edits and sets of characters are cheap beside the phrase part, which is at most 1: where the
    score with that 1 is below ``tau``, the phrase part is not worked out.
    """
    x, y = normalized(one), normalized(two)
    most = 0.4 * edit_similarity(x, y) + 0.4 + 0.2 * set_similarity(x, y)
    reach = (x == y) | (most >= tau) | (contained_similarity(one, two) >= tau) | (bigram_similarity(one, two) >= tau)
    return F.when(reach, best_similarity(one, two))


def pairs_above(entries: DataFrame, tau: float, across: bool = False) -> DataFrame:
    """a, b, score: pairs of one category, a before b, whose similarity is ``tau`` or more. Null texts pair with nothing.

    ``across`` pairs entries of all categories.
    """
    own = entries.where("text is not null").select(F.lit("").alias("category") if across else F.col("category"), "id", "text")
    one = own.select("category", F.col("id").alias("a"), F.col("text").alias("_a"), F.pmod(F.xxhash64("id"), F.lit(PARTS)).cast("int").alias("_part"))
    two = own.select("category", F.col("id").alias("b"), F.col("text").alias("_b"), F.explode(F.array(*map(F.lit, range(PARTS)))).alias("_part"))
    scored = one.join(two, ["category", "_part"]).where("a < b").withColumn("score", similar_enough(F.col("_a"), F.col("_b"), tau))
    return scored.where(F.col("score") >= tau).select("a", "b", "score")


def groups(pairs: DataFrame) -> DataFrame:
    """id and group, the least id that pairs reach, of each id in ``pairs``.

    Edges are hung in turn from the least neighbour of a node's greater neighbours and of its lesser ones (large and small star), until
    they no longer change; the rounds grow with the logarithm of the longest chain. A star's centre is an aggregate, so hubs are not gathered.
    """
    edges, mark = materialize(pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct(), "near-edges"), None
    while True:
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("_m")).select("a", F.least("a", "_m").alias("_m"))
        large = materialize(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("_m").alias("b")).distinct(), "near-groups")
        centre = large.groupBy("a").agg(F.min("b").alias("_m"))
        small = large.join(centre, "a").where("b != _m").select(F.col("b").alias("a"), F.col("_m").alias("b")).union(centre)
        edges = materialize(small.distinct(), "near-groups")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if now == mark:
            return edges.select(F.col("a").alias("id"), F.col("b").alias("group")).union(edges.select("b", "b").distinct())
        mark = now


def cleanup(entries: DataFrame, tau: float) -> DataFrame:
    """id, group, group_score and keep of every entry in a group of similar ones: the longest text stays, then the least id.

    group_score is the greatest similarity within the group.
    """
    pairs = materialize(pairs_above(entries, tau), "near-pairs")
    member = materialize(groups(pairs), "near-members")
    best = pairs.join(member.select(F.col("id").alias("a"), "group"), "a").groupBy("group").agg(F.max("score").alias("group_score"))
    rows = member.join(entries.select("id", F.length("text").alias("_n")), "id")
    stay = rows.groupBy("group").agg(F.max_by("id", F.struct("_n", -F.col("id"))).alias("_stay"))
    return rows.join(stay, "group").join(best, "group").select("id", "group", "group_score", (F.col("id") == F.col("_stay")).alias("keep"))


# The categories of entries and the words for them; any other word stands for the first.
CATEGORIES = {"rule": ("rule", "规范", "规则"), "preference": ("preference", "偏好"), "pattern": ("pattern", "模式", "最佳实践"), "context": ("context", "背景", "上下文")}


def category_named(word: Column) -> Column:
    """The category that a word stands for, in any case; the first for other words and null."""
    first, *others = CATEGORIES
    named = F.when(F.lower(word).isin(*CATEGORIES[others[0]]), others[0])
    for name in others[1:]:
        named = named.when(F.lower(word).isin(*CATEGORIES[name]), name)
    return named.otherwise(first)


def cleanup_preview(entries: DataFrame, tau: float, categories: tuple[str, ...] = (), across: bool = False) -> DataFrame:
    """group, group_rank, group_score, category, place, id, keep of every entry in a group of similar ones among ``entries`` (id, category, text, updated).

    Only entries of ``categories`` take part, if there are any. One entry of a group is to stay: the one updated last, then that of most bytes, then
    that of least id; it has place 1, the others follow by id. Groups rank by their greatest similarity, equal ones by their least id;
    ``across`` groups entries of all categories, and category is ``mixed`` then.
    """
    own = entries.where(F.col("category").isin(*categories)) if categories else entries
    pairs = materialize(pairs_above(own, min(1.0, max(0.0, tau)), across), "near-pairs")
    member = materialize(groups(pairs), "near-members")
    best = pairs.join(member.select(F.col("id").alias("a"), "group"), "a").groupBy("group").agg(F.max("score").alias("group_score"))
    order = F.row_number().over(Window.orderBy(F.desc("group_score"), "group"))  # a row for each group
    ranked = best.withColumn("group_rank", order)
    rows = member.join(own.select("id", "category", F.octet_length("text").alias("_n"), "updated"), "id")
    stay = rows.groupBy("group").agg(F.min_by("id", F.struct(-F.coalesce(F.unix_micros("updated"), F.lit(-(1 << 62))), -F.col("_n"), "id")).alias("_stay"))
    told = rows.join(stay, "group").join(ranked, "group").withColumn("keep", F.col("id") == F.col("_stay"))
    place = F.row_number().over(Window.partitionBy("group").orderBy(F.desc("keep"), "id"))
    return told.select("group", "group_rank", "group_score", F.lit("mixed").alias("category") if across else F.col("category"), place.alias("place"), "id", "keep")


def plan_faults(entries: DataFrame, plan: DataFrame) -> DataFrame:
    """group, id, role: what ``plan`` (group, keep_id, delete_id) names and ``entries`` (id) lack, as ``keep`` or ``delete``. A plan with such a row is out of date."""
    named = plan.select("group", F.col("keep_id").alias("id"), F.lit("keep").alias("role")).union(plan.where("delete_id != keep_id").select("group", "delete_id", F.lit("delete")))
    return named.where("id is not null").distinct().join(entries.select("id"), "id", "left_anti").select("group", "id", "role")


def apply_plan(entries: DataFrame, plan: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(``entries`` that stay, removed: id and group) under ``plan`` (group, keep_id, delete_id); an error if it is out of date.

    A row whose delete_id is its keep_id or null removes nothing.
    """
    fault = plan_faults(entries, plan).limit(1).collect()
    if fault:
        raise ValueError(f"the plan is out of date: there is no entry {fault[0]['id']} to {fault[0]['role']} in group {fault[0]['group']}")
    removed = plan.where("delete_id != keep_id").groupBy(F.col("delete_id").alias("id")).agg(F.min("group").alias("group"))
    return entries.join(removed, "id", "left_anti"), removed


def dedup_stats(kept: DataFrame) -> DataFrame:
    """One row: original, removed and remaining of the outcome of ``greedy``."""
    return kept.agg(F.count("*").alias("original"), F.count_if(~F.col("kept")).alias("removed"), F.count_if(F.col("kept")).alias("remaining"))


def greedy(entries: DataFrame, tau: float) -> DataFrame:
    """id and kept: in order of id an entry goes if it is similar to one that was kept before it.

    Each round decides the entries whose earlier neighbours are decided, so the longest chain of neighbours bounds the rounds.
    """
    pairs = materialize(pairs_above(entries, tau).select("a", "b"), "near-pairs")
    state = entries.select("id", F.lit("open").alias("state"))
    while True:
        earlier = pairs.join(state.where("state != 'gone'").select(F.col("id").alias("a"), "state"), "a")
        seen = earlier.groupBy(F.col("b").alias("id")).agg(F.bool_or(F.col("state") == "kept").alias("_kept"), F.bool_or(F.col("state") == "open").alias("_open"))
        new = F.when(F.col("state") != "open", F.col("state")).when(F.coalesce("_kept", F.lit(False)), "gone").when(F.coalesce("_open", F.lit(False)), "open").otherwise("kept")
        state = materialize(state.join(seen, "id", "left").select("id", new.alias("state")), "near-greedy")
        if state.where("state = 'open'").isEmpty():
            return state.select("id", (F.col("state") == "kept").alias("kept"))


def nearest(queries: DataFrame, entries: DataFrame, tau: float) -> DataFrame:
    """query_id, score and id: the most similar entry of each query's category, of equals the least id; null id below ``tau``."""
    rows = queries.select("query_id", "category", F.col("text").alias("_q")).join(entries, "category")
    scored = rows.select("query_id", "id", best_similarity(F.col("_q"), F.col("text")).alias("score")).where("score is not null")
    best = scored.groupBy("query_id").agg(F.max_by(F.struct("id", "score"), F.struct("score", -F.col("id"))).alias("_b"))
    return best.select("query_id", "_b.score", F.when(F.col("_b.score") >= tau, F.col("_b.id")).alias("id"))


def upsert_outcome(queries: DataFrame, entries: DataFrame, tau: float, same: float = 1.0) -> DataFrame:
    """query_id, outcome and id: ``ignored`` for a text that is there, ``updated`` for one similar enough, else ``added``."""
    found = queries.select("query_id").join(nearest(queries, entries, tau), "query_id", "left")
    outcome = F.when(F.col("score") >= same, "ignored").when(F.col("score") >= tau, "updated").otherwise("added")
    return found.select("query_id", outcome.alias("outcome"), "id")
