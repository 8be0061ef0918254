"""Upkeep of collections: hash differences, statuses, rollups, routing, batches and bounded histories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.functions.text import ancestors


def keep_first(rows: DataFrame, key: list[str], order: list) -> DataFrame:
    """One row per key, the first in ``order``."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")


def recent(rows: DataFrame, key: list[str], order: list[str], n: int) -> DataFrame:
    """The last n rows of each key."""
    w = Window.partitionBy(*key).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def batches(rows: DataFrame, digest: str, size: int) -> DataFrame:
    """``rows`` with batch, numbered from 0 in order of a hex digest.

    Rows are ranked within the digest's first three digits and those 4096 counts are summed up,
    so no task sorts everything.
    """
    rows = rows.withColumn("_b", F.substring(digest, 1, 3))
    counts = rows.groupBy("_b").agg(F.count("*").alias("_c"))
    before = counts.select("_b", F.coalesce(F.sum("_c").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    ranked = rows.withColumn("_n", F.row_number().over(Window.partitionBy("_b").orderBy(digest)))
    return ranked.join(F.broadcast(before), "_b").withColumn("batch", F.floor((F.col("_before") + F.col("_n") - 1) / size)).drop("_b", "_n", "_before")  # 4096 rows at most


def rollup_directories(paths: DataFrame) -> DataFrame:
    """directory, total, indexed, label from (path, indexed boolean): every directory counts all below it."""
    rows = paths.select(F.explode(ancestors(F.col("path"))).alias("directory"), F.col("indexed").cast("int").alias("_i"))
    out = rows.groupBy("directory").agg(F.count("*").alias("total"), F.coalesce(F.sum("_i"), F.lit(0)).alias("indexed"))
    label = F.when(F.col("indexed") == 0, "none").when(F.col("indexed") == F.col("total"), F.col("total").cast("string")).otherwise(F.concat_ws("/", "indexed", "total"))
    return out.withColumn("label", label)


def route(paths: DataFrame, roots: DataFrame) -> DataFrame:
    """path and root, the longest of ``roots`` (root) that is the path or a directory above it; others drop.

    Every ancestor of a path is a key, so the prefix join is an equality join.
    """
    keys = paths.select("page_id", "path", F.explode(F.array_append(ancestors(F.col("path")), F.col("path"))).alias("root"))
    return keys.join(roots, "root").groupBy("page_id", "path").agg(F.max_by("root", F.length("root")).alias("root"))


def outermost(roots: DataFrame) -> DataFrame:
    """Roots that lie below no other root."""
    above = roots.select("root", F.explode(ancestors(F.col("root"))).alias("_up"))
    inner = above.join(roots.select(F.col("root").alias("_up")), "_up").select("root").distinct()
    return roots.join(inner, "root", "left_anti")


def quiet_sessions(events: DataFrame, gap: int) -> DataFrame:
    """user_id, session, n_events, least_event, greatest_event: a session ends after ``gap`` seconds without an event."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    far = (at - F.lag(at).over(w)) > gap * 1_000_000
    marked = events.withColumn("_new", F.coalesce(far.cast("int"), F.lit(0)))
    numbered = marked.withColumn("session", F.sum("_new").over(w))
    return numbered.groupBy("user_id", "session").agg(F.count("*").alias("n_events"), F.min("event_id").alias("least_event"), F.max("event_id").alias("greatest_event"))


def changed(now: DataFrame, old: DataFrame, key: str, marks: list[str]) -> DataFrame:
    """key and state of each row of two snapshots: new, stale (gone), unchanged where all ``marks`` are equal, else changed."""
    a = now.select(key, F.struct(*marks).alias("_now"))
    both = a.join(old.select(key, F.struct(*marks).alias("_old")), key, "full_outer")
    state = F.when(F.col("_now").isNull(), "stale").when(F.col("_old").isNull(), "new").when(F.col("_now") == F.col("_old"), "unchanged").otherwise("changed")
    return both.select(key, state.alias("state"))


def all_present(parts: DataFrame, known: DataFrame, whole: str, part: str) -> DataFrame:
    """whole, parts and complete: whether every one of its parts is known."""
    found = parts.join(known.select(part).distinct().withColumn("_known", F.lit(True)), part, "left")
    return found.groupBy(whole).agg(F.count("*").alias("parts"), F.bool_and(F.coalesce("_known", F.lit(False))).alias("complete"))


def ordered_lookup(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """Rows of the wanted keys with the place (``pos``) at which each was asked for; unknown keys are left out."""
    return wanted.join(rows, key)


def reconciled(status: DataFrame, jobs: DataFrame, key: str) -> DataFrame:
    """key and state: a job's state stands for the stored one, where there is a job; a stored run without a job has failed."""
    both = status.join(jobs, key, "left")
    state = F.when(F.col("job").isNotNull(), F.col("job")).when(F.col("stored") == "running", "failed").otherwise(F.col("stored"))
    return both.select(key, state.alias("state"))


def first_of_sources(sources: list[DataFrame], key: str) -> DataFrame:
    """The union of histories; of rows with one key that of the first source stays, and its own first in ``ts``."""
    rows = [s.withColumn("_source", F.lit(k)) for k, s in enumerate(sources)]
    union = rows[0]
    for r in rows[1:]:
        union = union.unionByName(r)
    best = union.groupBy(key).agg(F.min_by(F.struct(*sources[0].columns), F.struct("_source", "ts")).alias("_one"))
    return best.select("_one.*")


def page_of(rows: DataFrame, order: list, page: int, size: int) -> DataFrame:
    """One page, from 1, of ``rows`` in a total order, and whether more follow."""
    total = rows.agg(F.count("*").alias("_total"))
    some = rows.orderBy(*order).limit(page * size)  # a page's depth bounds what is sorted together
    place = F.row_number().over(Window.orderBy(*order))
    return some.withColumn("place", place).where(F.col("place") > (page - 1) * size).join(F.broadcast(total)).withColumn("has_more", F.col("_total") > page * size).drop("_total")  # one row


def preflight(files: DataFrame, most_files: int, most_bytes: int) -> DataFrame:
    """One row: files, bytes, and the limit that is passed, if any."""
    sums = files.agg(F.count("*").alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))
    return sums.withColumn("breach", F.when(F.col("files") > most_files, "files").when(F.col("bytes") > most_bytes, "bytes").otherwise("none"))


def matching_lines(docs: DataFrame, terms: list[str], most: int) -> DataFrame:
    """doc_id, line_no and line of the first ``most`` lines of each text that hold a term in any case."""
    hit = lambda x: F.exists(F.array(*map(F.lit, terms)), lambda t: F.contains(F.lower(x), t))
    numbered = F.transform(F.split("text", "\n"), lambda line, k: F.struct((k + 1).alias("line_no"), line.alias("line")))
    return docs.select("doc_id", F.inline(F.slice(F.filter(numbered, lambda x: hit(x["line"])), 1, most)))


def heading_sections(docs: DataFrame, size: int, overlap: int, title: str = "") -> DataFrame:
    """doc_id, section, chunk, start_line, end_line, heading, content: sections begin at headings of three levels; long ones
    come in windows.

    Windows of ``size`` lines share ``overlap``; a chunk without words is left out. Lines before the first heading have
    ``title`` as theirs.
    """
    # one element binds the lines: an outer expression inside a lambda would be worked out again for each line
    heads = lambda l: F.filter(F.sequence(F.lit(1), F.size(l)), lambda k: (k == 1) | F.element_at(l, k).rlike("^#{1,3} "))
    bound = F.transform(F.array(F.split("text", "\n")), lambda l: F.struct(l.alias("l"), heads(l).alias("h")))
    starts = docs.where("text is not null").select("doc_id", F.inline(bound)).select("doc_id", F.col("l").alias("_l"), F.posexplode("h").alias("section", "_from"), F.col("h").alias("_h"))
    last = F.coalesce(F.get("_h", F.col("section") + 1) - 1, F.size("_l"))
    own = starts.withColumn("_to", last).withColumn("_n", F.greatest(F.lit(1), F.ceil((F.col("_to") - F.col("_from") + 1 - overlap) / (size - overlap))).cast("int"))
    rows = own.select("doc_id", "section", "_l", "_from", "_to", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("chunk"))
    begin = F.col("_from") + F.col("chunk") * (size - overlap)
    rows = rows.withColumns({"start_line": begin, "end_line": F.least(begin + size - 1, F.col("_to"))})
    first = F.element_at("_l", F.col("_from"))
    heading = F.when(first.rlike("^#{1,3} "), F.trim(F.regexp_replace(first, "^#{1,3} ", ""))).otherwise(title)
    content = F.array_join(F.slice("_l", F.col("start_line"), F.col("end_line") - F.col("start_line") + 1), "\n")
    rows = rows.select("doc_id", "section", "chunk", "start_line", "end_line", heading.alias("heading"), content.alias("content"))
    return rows.where(F.trim(F.regexp_replace("content", "[\t\n\r]+", " ")) != "")


def heading_chunks(docs: DataFrame, size: int, overlap: int) -> DataFrame:
    """doc_id, section, chunk, start_line, end_line of ``heading_sections``."""
    return heading_sections(docs, size, overlap).select("doc_id", "section", "chunk", "start_line", "end_line")


def split_blobs(docs: DataFrame, most: int) -> DataFrame:
    """doc_id, name and sha256 of each part of at most ``most`` lines; parts of a longer text are named path#chunkIofN."""
    own = docs.where("text is not null").select("doc_id", "path", F.split("text", "\n").alias("_l"))
    n = F.ceil(F.size("_l") / most).cast("int")
    rows = own.select("doc_id", "path", "_l", n.alias("_n"), F.explode(F.sequence(F.lit(1), n)).alias("_k"))
    name = F.when(F.col("_n") == 1, F.col("path")).otherwise(F.concat("path", F.lit("#chunk"), "_k", F.lit("of"), "_n"))
    body = F.array_join(F.slice("_l", (F.col("_k") - 1) * most + 1, F.lit(most)), "\n")
    return rows.select("doc_id", name.alias("name"), F.sha2(body, 256).alias("sha256"))
