"""Column expressions over records of projects, commands, backups, versions and replies."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The states of a project in their order, and the words by which an output tells what went wrong.
STATES = ("indexing", "paused", "stale", "synced", "failed", "idle")
REPAIRED, MISSING = "Warning: requested path missing", "Hint: requested path missing"
NOT_THERE = ("path does not exist", "file not found", "dir not found", "not a directory")


def shown_state(state: Column, stale: Column) -> Column:
    """A project's state as it is shown: ``stale`` where that is marked and no indexing runs."""
    return F.when(F.coalesce(stale, F.lit(False)) & (state != "indexing"), "stale").otherwise(state)


def state_counts(projects: DataFrame, by: list[str]) -> DataFrame:
    """total, indexing, paused, stale, synced, failed of ``projects`` (state, stale) for each value of ``by``.

    Paused and failed projects count as such and as stale, if they are; synced ones only while they are not.
    """
    state, stale = F.col("state"), F.coalesce("stale", F.lit(False))
    own = {"indexing": state == "indexing", "paused": state == "paused", "stale": stale & (state != "indexing"), "synced": (state == "synced") & ~stale, "failed": state == "failed"}
    return projects.groupBy(*by).agg(F.count("*").alias("total"), *[F.count_if(c).alias(n) for n, c in own.items()])


def project_order(by: str) -> list[Column]:
    """Sort keys of projects (root, state, stale, succeeded): by ``state``, by ``time`` of the last success, newest first and none last, or by ``name``;
    ties by root."""
    shown = shown_state(F.col("state"), F.col("stale"))
    keys = {"state": F.array_position(F.array(*map(F.lit, STATES)), shown), "time": F.desc(F.coalesce(F.unix_micros("succeeded"), F.lit(0))), "name": F.lower(F.regexp_extract("root", r"([^/\\]*)$", 1))}
    return [keys[by], F.col("root")]


def output_flags(output: Column) -> Column:
    """Struct of useful, error, missing and repaired of a command's output.

    A warning or hint that a path is missing says so whatever else there is. Without such lines an output is useful unless it is
    empty, ``(no matches)`` or begins with ``Error:``; an error that names no path there counts as missing too. Null is empty.
    """
    text = F.regexp_replace(F.coalesce(output, F.lit("")), r"(?U)^\s+|\s+$", "")
    kept = F.filter(F.split(text, "\n"), lambda x: ~(F.startswith(F.ltrim(x), F.lit(REPAIRED)) | F.startswith(F.ltrim(x), F.lit(MISSING))))
    bare = F.regexp_replace(F.array_join(kept, "\n"), r"(?U)^\s+|\s+$", "")
    repaired, failed = F.contains(text, F.lit(REPAIRED)), F.startswith(bare, F.lit("Error:"))
    gone = failed & bare.rlike("|".join(map(re.escape, NOT_THERE)))
    useful = (bare != "") & ~failed & (bare != "(no matches)")
    return F.struct(useful.alias("useful"), failed.alias("error"), (repaired | F.contains(text, F.lit(MISSING)) | gone).alias("missing"), repaired.alias("repaired"))


def backup_time(name: Column, suffix: str) -> Column:
    """The time in a backup's name, ``<yyyyMMdd-HHmmss>-<milliseconds><suffix>``; null for other names and times that do not exist."""
    form = r"^(\d{8}-\d{6})-(\d{1,15})" + re.escape(suffix) + "$"
    base = F.try_to_timestamp(F.regexp_extract(name, form, 1), F.lit("yyyyMMdd-HHmmss"))
    millis = F.when(name.rlike(form), F.regexp_extract(name, form, 2).cast("long"))
    return F.timestamp_micros(F.unix_micros(base) + millis * 1000)


def version_order_zero(one: Column, two: Column) -> Column:
    """-1, 0 or 1 as version ``one`` is less than, equal to or greater than ``two``; missing parts and parts that are no number are 0."""
    parts = lambda v: F.transform(F.split(v, r"\."), lambda x: F.coalesce(F.when(F.trim(x).rlike("^[0-9]{1,18}$"), F.trim(x).cast("long")), F.lit(0)))
    a, b = parts(one), parts(two)
    signs = F.zip_with(a, b, lambda x, y: F.sign(F.coalesce(x, F.lit(0)) - F.coalesce(y, F.lit(0))).cast("int"))
    return F.aggregate(signs, F.lit(0), lambda found, x: F.when(found != 0, found).otherwise(x))


def compared(runs: DataFrame, by: list[str]) -> DataFrame:
    """verdict and percent of ``runs`` (proxy_ms, direct_ms) for each value of ``by``: whole means of the runs that have a time, compared.

    ``proxy`` or ``direct`` is faster by percent of the slower, cut to a whole number; ``level`` for equal means, ``unknown`` where one has none.
    """
    mean = lambda c: F.call_function("div", F.sum(c), F.count(c))
    means = runs.groupBy(*by).agg(mean("proxy_ms").alias("_p"), mean("direct_ms").alias("_d"))
    p, d = F.col("_p"), F.col("_d")
    verdict = F.when(p.isNull() | d.isNull(), "unknown").when(p < d, "proxy").when(d < p, "direct").otherwise("level")
    percent = F.when(p != d, F.floor(F.abs(d - p) / F.greatest(p, d) * 100).cast("int"))
    return means.select(*by, verdict.alias("verdict"), percent.alias("percent"))


def mean_change(runs: DataFrame, by: list[str]) -> DataFrame:
    """percent of ``runs`` (first, second) for each value of ``by``: by how much the mean of second differs from that of first, cut toward zero.

    Values count in ten-thousandths, halves away from zero, and the rest is whole numbers, so the order of rows plays no part. Null
    where first has no mean above 0 or second none; values that are no finite numbers are an error.
    """
    whole = lambda c: c.cast("decimal(19,0)")
    total = lambda c: whole(F.sum(F.round(F.col(c) * 10_000).cast("long")))
    sums = runs.groupBy(*by).agg(total("first").alias("_a"), total("second").alias("_b"), whole(F.count("first")).alias("_m"), whole(F.count("second")).alias("_n"))
    a, b = F.col("_a") * F.col("_n"), F.col("_b") * F.col("_m")
    percent = F.when((F.col("_a") > 0) & (F.col("_n") > 0), F.call_function("div", (b - a) * 100, a))
    return sums.select(*by, percent.alias("percent"))


def distinct_rows(rows: DataFrame, order: list[str], columns: list[str] | None = None) -> DataFrame:
    """The first in ``order`` of rows that are alike in ``columns``, all but those of ``order`` by default.

    Rows are alike if their sorted ``name=value`` pairs, without nulls, are one text.
    """
    names = sorted(columns or [c for c in rows.columns if c not in order])
    pairs = [F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{c}="), F.col(c).cast("string"))) for c in names]
    marked = rows.withColumn("_signature", F.sha2(F.concat_ws("|", *pairs), 256))
    best = marked.groupBy("_signature").agg(F.min_by(F.struct(*rows.columns), F.struct(*order)).alias("_one"))
    return best.select("_one.*")


def highlighted(text: Column, query: str) -> Column:
    """Structs of text and hit: a text cut at what equals ``query`` in any case, in order; one piece without hit for an empty query or text."""
    if not query:
        return F.array(F.struct(text.alias("text"), F.lit(False).alias("hit")))
    own = f"(?i:{re.escape(query)})"
    parts = F.regexp_extract_all(text, F.lit(rf"{own}|(?:(?!{own})[\s\S])+"), F.lit(0))
    marked = F.transform(parts, lambda x: F.struct(x.alias("text"), x.rlike(f"^{own}$").alias("hit")))
    return F.when(text == "", F.array(F.struct(text.alias("text"), F.lit(False).alias("hit")))).otherwise(marked)


def request_code(request: Column, fallback: str) -> Column:
    """The first six ASCII letters and digits of a request's id, in upper case; ``fallback`` where there are none."""
    code = F.upper(F.substring(F.regexp_replace(request, "[^A-Za-z0-9]", ""), 1, 6))
    return F.when(code == "", fallback).otherwise(code)


def selected_options(choice: Column, options: Column) -> Column:
    """The options that a choice names, in the order of naming, each once: by letter, A for the first, or by their whole text; commas part them.

    Null if a name is no option; empty for a blank or null choice.
    """
    names = F.filter(F.transform(F.split(F.coalesce(choice, F.lit("")), "[,，]"), lambda x: F.trim(x)), lambda x: x != "")
    place = lambda x: F.instr(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), F.upper(x))
    by_letter = lambda x: F.when(place(x) > 0, F.get(options, place(x) - 1))
    found = F.transform(names, lambda x: F.when(F.octet_length(x) == 1, by_letter(x)).otherwise(F.get(F.filter(options, lambda o: F.trim(o) == x), F.lit(0))))
    return F.when(F.exists(found, lambda o: o.isNull()), None).otherwise(F.array_distinct(found))

