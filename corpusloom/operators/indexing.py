"""Incremental index plans for many projects: what is known, what an unfinished job has sent, and what is left, in numbered batches.

A part is a piece of a file under a content hash. A project's plan leaves out the parts that the index already has and those
that its unfinished job has sent, so that a run that stops between batches goes on where it was. Both are void once the
signature of the project's settings changes, or when a full rebuild is asked for.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.operators.upkeep import all_present
from corpusloom.sources.tables import materialize

#: Hex digits of a hash by which a project's parts are ranked apart.
DIGITS = 3


def settings_fingerprint(base_url: Column, batch_size: Column, most_lines: Column, extensions: Column, excludes: Column) -> Column:
    """SHA-256 of the settings as JSON: address without closing slashes, lists trimmed, in lower case, sorted, once each. Null without address."""
    once = lambda values: F.array_sort(F.array_distinct(F.filter(F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda x: F.lower(F.trim(x))), lambda x: x != "")))
    own = {"base_url": F.regexp_replace(F.trim(base_url), "/+$", ""), "batch_size": F.coalesce(batch_size, F.lit(10)), "max_lines": F.coalesce(most_lines, F.lit(800)), "extensions": once(extensions), "excludes": once(excludes)}
    return F.when(base_url.isNotNull(), F.sha2(F.to_json(F.struct(*[v.alias(k) for k, v in own.items()])), 256))


def file_parts(files: DataFrame, most: int = 800) -> DataFrame:
    """project, path, name, blob_hash, content: files (project, path, text) of at most ``most`` lines whole, longer ones as path#chunkIofN.

    A line keeps its line feed, so the parts of a text put together are the text. The hash is SHA-256 of name and content.
    A null text has no part; an empty one has one.
    """
    own = files.where("text is not null").select("project", "path", "text", F.regexp_extract_all("text", F.lit("[^\n]*\n|[^\n]+"), F.lit(0)).alias("_l"))
    n = F.greatest(F.lit(1), F.ceil(F.size("_l") / most)).cast("int")
    rows = own.select("project", "path", "text", "_l", n.alias("_n"), F.explode(F.sequence(F.lit(1), n)).alias("_k"))
    name = F.when(F.col("_n") == 1, F.col("path")).otherwise(F.concat("path", F.lit("#chunk"), "_k", F.lit("of"), "_n"))
    content = F.when(F.col("_n") == 1, F.col("text")).otherwise(F.array_join(F.slice("_l", (F.col("_k") - 1) * most + 1, F.lit(most)), ""))
    named = rows.select("project", "path", name.alias("name"), content.alias("content"))
    return named.withColumn("blob_hash", F.sha2(F.concat("name", "content"), 256))


def settings_stale(current: Column, saved: Column, has_parts: Column) -> Column:
    """Whether an index was built under other settings: another signature, or none where there are parts. False while there is no current one."""
    return F.coalesce(F.when(current.isNotNull(), F.coalesce(saved != current, has_parts)), F.lit(False))


def plan_index(parts: DataFrame, known: DataFrame, projects: DataFrame, jobs: DataFrame, sent: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(a row for each project; the pending parts with their batch).

    ``parts``: project, name, blob_hash and more. ``known``: project, blob_hash of the index. ``projects``: project,
    scope_hash (now), saved_hash, mode (``full`` or ``incremental``), batch_size. ``jobs``: project, job_hash, job_mode,
    job_batches of unfinished jobs, at most one a project. ``sent``: project, blob_hash that these jobs have sent.

    A project: total, existing, resumed, pending parts, completed_batches, total_batches, progress (whole per cent, 0
    for no parts) and scope_changed. Batches go on after those of a job whose mode and signature are the same;
    within a project they follow the hash. Parts of projects that ``projects`` lacks are left out.
    """
    spread = lambda rows: rows.select("project", "blob_hash").distinct()
    has = known.select("project").distinct().withColumn("_has", F.lit(True))
    own = projects.join(has, "project", "left").join(jobs, "project", "left")
    changed = (F.col("mode") == "full") | settings_stale(F.col("scope_hash"), F.col("saved_hash"), F.coalesce("_has", F.lit(False)))
    resumes = F.coalesce((F.col("job_mode") == F.col("mode")) & (F.col("job_hash") == F.col("scope_hash")), F.lit(False))
    own = own.select("project", "batch_size", changed.alias("scope_changed"), resumes.alias("_resumes"), F.coalesce("job_batches", F.lit(0)).alias("_batches"))
    marked = parts.join(own, "project")  # a row for each project
    marked = marked.join(spread(known).withColumn("_known", F.lit(True)), ["project", "blob_hash"], "left")
    marked = marked.join(spread(sent).withColumn("_sent", F.lit(True)), ["project", "blob_hash"], "left")
    state = F.when(F.coalesce("_known", F.lit(False)) & ~F.col("scope_changed"), "existing").when(F.coalesce("_sent", F.lit(False)) & F.col("_resumes"), "resumed").otherwise("pending")
    resumed = F.coalesce("_sent", F.lit(False)) & F.col("_resumes")
    marked = materialize(marked.withColumns({"state": state, "_checked": resumed}).drop("_known", "_sent"), "index-plan")
    count = lambda x: F.sum(x.cast("long"))
    sums = marked.groupBy("project").agg(F.count("*").alias("total"), *[count(F.col("state") == s).alias(s) for s in ("existing", "resumed", "pending")], count(F.col("_checked")).alias("_checked"))
    told = own.join(sums, "project", "left").na.fill(0, ["total", "existing", "resumed", "pending", "_checked"])
    done = F.least(F.col("_batches"), F.ceil(F.col("_checked") / F.col("batch_size"))).cast("long")
    told = told.withColumn("completed_batches", done).withColumn("total_batches", done + F.ceil(F.col("pending") / F.col("batch_size")).cast("long"))
    progress = F.when(F.col("total") > 0, F.floor((F.col("existing") + F.col("resumed")) * 100 / F.col("total"))).otherwise(0).cast("int")
    summary = told.select("project", "total", "existing", "resumed", "pending", "completed_batches", "total_batches", progress.alias("progress"), "scope_changed")
    pending = marked.where("state = 'pending'").drop("state", "_checked", "_resumes", "_batches", "scope_changed")
    return summary, numbered(pending.join(summary.select("project", "completed_batches"), "project")).drop("batch_size", "completed_batches")


def numbered(parts: DataFrame) -> DataFrame:
    """``parts`` (project, blob_hash, name, batch_size, completed_batches) with batch, from completed_batches + 1, by hash within the project.

    Parts are ranked within the first digits of their hash and those counts are summed, so that no task ranks a project.
    """
    parts = parts.withColumn("_d", F.substring("blob_hash", 1, DIGITS))
    counts = parts.groupBy("project", "_d").agg(F.count("*").alias("_c"))
    earlier = Window.partitionBy("project").orderBy("_d").rowsBetween(Window.unboundedPreceding, -1)  # 4096 rows at most
    base = counts.select("project", "_d", F.coalesce(F.sum("_c").over(earlier), F.lit(0)).alias("_before"))
    ranked = parts.withColumn("_n", F.row_number().over(Window.partitionBy("project", "_d").orderBy("blob_hash", "name"))).join(base, ["project", "_d"])
    batch = F.col("completed_batches") + 1 + F.floor((F.col("_before") + F.col("_n") - 1) / F.col("batch_size"))
    return ranked.withColumn("batch", batch.cast("long")).drop("_d", "_n", "_before")


class IndexJobs:
    """Unfinished jobs in a folder: the signature under which each project's job began, and the parts that it has sent."""

    def __init__(self, spark, folder: str):
        self.spark, self.folder = spark, folder

    def _read(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}")
        except AnalysisException:  # no job yet
            return self.spark.createDataFrame([], schema)

    def sent(self) -> DataFrame:
        """project, blob_hash, batch, job_hash, job_mode of all parts sent so far."""
        return self._read("sent", "project string, blob_hash string, batch long, job_hash string, job_mode string")

    def jobs(self, projects: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(jobs, sent) for ``plan_index``: those under the present signature and mode of ``projects``; others are void."""
        now = projects.select("project", F.col("scope_hash").alias("job_hash"), F.col("mode").alias("job_mode"))
        sent = self.sent().join(now, ["project", "job_hash", "job_mode"])
        return sent.groupBy("project", "job_hash", "job_mode").agg(F.countDistinct("batch").alias("job_batches")), sent

    def run(self, pending: DataFrame, projects: DataFrame, send: Callable[[DataFrame, int], None], together: int = 100, most: int | None = None) -> int:
        """Send pending parts, ``together`` batches of every project at a time, by ``send(parts, first batch)``; returns how many rounds ran.

        A round's parts are marked as sent after ``send`` returns. So a run that stops in a round sends that round again: ``send``
        must take a part twice without harm. ``most`` ends the run after so many rounds.
        """
        ahead = materialize(pending.join(projects.select("project", F.col("scope_hash").alias("job_hash"), F.col("mode").alias("job_mode")), "project"), "index-pending")
        first, last = ahead.agg(F.min("batch"), F.max("batch")).first()
        rounds = 0
        for k in range(first, last + 1, together) if first is not None else ():
            if most is not None and rounds == most:
                break
            own = ahead.where(F.col("batch").between(k, k + together - 1))
            send(own.drop("job_hash", "job_mode"), k)
            own.select("project", "blob_hash", "batch", "job_hash", "job_mode").write.mode("append").parquet(f"{self.folder}/sent")
            rounds += 1
        return rounds


def file_statuses(files: DataFrame, parts: DataFrame, known: DataFrame) -> DataFrame:
    """project, path, status of all ``files`` (project, path): ``indexed`` where each of a file's parts is known, else ``pending``, also unread ones."""
    key = F.struct("project", "path")
    whole = all_present(parts.select(key.alias("_f"), F.struct("project", "blob_hash").alias("_p")), known.select(F.struct("project", "blob_hash").alias("_p")), "_f", "_p")
    found = files.select("project", "path").join(whole.where("complete").select("_f.project", "_f.path", "complete"), ["project", "path"], "left")
    return found.select("project", "path", F.when(F.col("complete"), "indexed").otherwise("pending").alias("status"))
