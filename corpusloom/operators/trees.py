"""File trees as tables: ignore rules, collection, limits before a read, listings of a depth that fits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.functions.text import ancestors, file_supported, glob_excluded, glob_regex
from corpusloom.sources.tables import materialize


def effective_excludes(own: list[str], built_in: list[str]) -> list[str]:
    """The user's patterns, then the built-in ones; trimmed, none empty, each once in any case, as first written."""
    seen: dict[str, str] = {}
    for pattern in [*own, *built_in]:
        if pattern.strip():
            seen.setdefault(pattern.strip().lower(), pattern.strip())
    return list(seen.values())


def file_wanted(path: Column, include: list[str], exclude: list[str]) -> Column:
    """Whether no glob of ``exclude`` and, where there are any, one of ``include`` matches the relative path or its last segment."""
    name = F.substring_index(path, "/", -1)
    hit = lambda globs: reduce(lambda a, g: a | path.rlike(glob_regex(g)) | name.rlike(glob_regex(g)), globs, F.lit(False))
    return ~hit(exclude) & (hit(include) if include else F.lit(True))


def ignore_rules(lines: DataFrame) -> DataFrame:
    """project, rules: structs of pos, form, keeps, folders of the ignore rules in ``lines`` (project, pos, line), in order.

    A rule is a glob; blank lines and lines after ``#`` are none. ``!`` keeps what earlier rules ignore; a closing slash takes folders
    only; a slash elsewhere binds the glob to the root, else it is met at any depth. ``form`` is a regular expression of the path.
    """
    bare = F.regexp_replace(F.regexp_replace("line", "\r$", ""), r"(?<!\\) +$", "")
    rows = lines.select("project", "pos", bare.alias("_l")).where("_l != '' and not startswith(_l, '#')")
    keeps = F.startswith(F.col("_l"), F.lit("!"))
    own = F.regexp_replace(F.when(keeps, F.substring("_l", 2, 1 << 30)).otherwise(F.col("_l")), r"^\\([#!])", "$1")
    rows = rows.select("project", "pos", keeps.alias("keeps"), own.alias("_g")).where(F.regexp_replace("_g", "/", "") != "")
    folders, glob = F.endswith(F.col("_g"), F.lit("/")), F.regexp_replace("_g", "/$", "")
    bound = F.contains(glob, F.lit("/"))
    # stars become control characters, so that what is put in their place is not replaced again
    body = F.regexp_replace(F.regexp_replace(glob, "^/", ""), r"\\(.)", "$1")
    body = F.regexp_replace(body, r"([.+^$(){}|\[\]\\])", r"\\$1")
    for form, put in ((r"^\*\*/", "\x01"), (r"/\*\*/", "\x02"), (r"/\*\*$", "\x03"), (r"\*+", "[^/]*"), (r"\?", "[^/]"), ("\x01", "(.*/)?"), ("\x02", "/(.*/)?"), ("\x03", "/.+")):
        body = F.regexp_replace(body, form, put)
    form = F.concat(F.lit("^"), F.when(bound, "").otherwise("(.*/)?"), body, F.lit("$"))
    rule = F.struct("pos", form.alias("form"), "keeps", folders.alias("folders"))
    return rows.groupBy("project").agg(F.array_sort(F.collect_list(rule)).alias("rules"))  # as long as the file that states them


def ignored(path: Column, folder: Column, rules: Column) -> Column:
    """Whether a path or a folder above it is ignored: of the rules that match it the last one decides. What lies in an ignored
    folder stays ignored, as it is never looked at."""
    steps = F.concat(F.transform(ancestors(path), lambda p: F.struct(p.alias("path"), F.lit(True).alias("folder"))), F.array(F.struct(path.alias("path"), folder.alias("folder"))))

    def last(step: Column) -> Column:
        return F.aggregate(rules, F.lit(False), lambda found, r: F.when((step["folder"] | ~r["folders"]) & F.rlike(step["path"], r["form"]), ~r["keeps"]).otherwise(found))

    return F.exists(steps, last)


def collected(entries: DataFrame, rules: DataFrame, excludes: list[str], suffixes: tuple[str, ...], names: tuple[str, ...] = (), most_bytes: int | None = None) -> DataFrame:
    """``entries`` (project, path, folder, size and more) with reason: null for files to read, else why not.

    Reasons: ``ignored`` by ``rules`` (project, rules), ``excluded`` by a glob of ``excludes`` on the path or a segment, ``folder``,
    ``type`` (neither suffix nor name), ``size``. Null paths drop.
    """
    told = entries.where("path is not null").join(rules, "project", "left")
    by_rule = F.coalesce(ignored(F.col("path"), F.col("folder"), F.col("rules")), F.lit(False))
    large = F.coalesce(F.col("size") > most_bytes, F.lit(False)) if most_bytes is not None else F.lit(False)
    reason = F.when(by_rule, "ignored").when(glob_excluded(F.col("path"), excludes), "excluded").when(F.col("folder"), "folder").when(~file_supported(F.col("path"), suffixes, names), "type").when(large, "size")
    return told.withColumn("reason", reason).drop("rules")


LIMITS = ("entries", "files", "bytes")


def first_breach(entries: DataFrame, most_entries: int, most_files: int, most_bytes: int, parts: int | None = None) -> DataFrame:
    """One row: entries, files, bytes, path, breach: where, in order of path, a running count of ``entries`` (path, candidate, size) first reaches a limit.

    A candidate counts as a file with its size. Of limits that one entry reaches the first of ``LIMITS`` is named, and the counts are those with
    that entry (for ``entries``: without its file). Without a breach: the totals, a null path and ``none``. Paths are not repeated.

    Entries are dealt by ranges of paths; sums of ranges tell the one range that holds the breach, and only that is summed row by row.
    """
    one = entries.select("path", F.lit(1).alias("n"), F.col("candidate").cast("int").alias("f"), F.when(F.col("candidate"), F.coalesce("size", F.lit(0))).otherwise(0).cast("long").alias("b"))
    dealt = one.repartitionByRange(parts, "path") if parts else one.repartitionByRange("path")
    rows = materialize(dealt.withColumn("part", F.spark_partition_id()), "preflight")
    upto = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)  # a row for each range
    sums = rows.groupBy("part").agg(*[F.sum(c).alias(c) for c in ("n", "f", "b")]).select("part", *[F.col(c).alias(f"_{c}") for c in ("n", "f", "b")], *[F.sum(c).over(upto).alias(c) for c in ("n", "f", "b")])
    over = (F.col("n") >= most_entries) | (F.col("f") >= most_files) | (F.col("b") >= most_bytes)
    sums = materialize(sums, "preflight-parts")
    broken = sums.where(over).agg(F.min("part").alias("part"))
    held = sums.join(broken, "part").select("part", *[(F.col(c) - F.col(f"_{c}")).alias(f"_{c}") for c in ("n", "f", "b")])
    order = Window.partitionBy("part").orderBy("path")
    inside = rows.join(F.broadcast(held), "part")  # one row: one range's rows stay
    running = inside.select("path", F.col("f").alias("_own"), F.col("b").alias("_size"), *[(F.col(f"_{c}") + F.sum(c).over(order.rowsBetween(Window.unboundedPreceding, 0))).alias(c) for c in ("n", "f", "b")])
    which = F.when(F.col("n") >= most_entries, "entries").when(F.col("f") >= most_files, "files").when(F.col("b") >= most_bytes, "bytes")
    marked = running.withColumn("breach", which).where("breach is not null")
    before = F.col("breach") == "entries"
    hit = marked.select("path", "breach", F.col("n").alias("entries"), (F.col("f") - F.when(before, F.col("_own")).otherwise(0)).alias("files"), (F.col("b") - F.when(before, F.col("_size")).otherwise(0)).alias("bytes"))
    first = hit.orderBy("path").limit(1)
    totals = sums.agg(*[F.coalesce(F.sum(f"_{c}"), F.lit(0)).alias(name) for c, name in zip(("n", "f", "b"), LIMITS)])
    none = totals.join(F.broadcast(first.select("path")), F.lit(True), "left").where("path is null")  # at most one row
    shape = ("entries", "files", "bytes", "path", "breach")
    return first.select(*shape).union(none.withColumn("breach", F.lit("none")).select(*shape))


def tree_entries(files: DataFrame) -> DataFrame:
    """project, path, depth, folder, children of all files (project, path) and of the folders above them; children are entries directly within."""
    own = files.where("path is not null and path != ''").select("project", "path").distinct()
    folders = own.select("project", F.explode(ancestors(F.col("path"))).alias("path")).distinct().withColumn("folder", F.lit(True))
    entries = folders.unionByName(own.join(folders, ["project", "path"], "left_anti").withColumn("folder", F.lit(False)))
    entries = entries.withColumn("depth", F.size(F.split("path", "/")))
    within = entries.where("depth > 1").groupBy("project", F.expr("substr(path, 1, length(path) - length(substring_index(path, '/', -1)) - 1)").alias("path")).agg(F.count("*").alias("children"))
    return entries.join(within, ["project", "path"], "left").select("project", "path", "depth", "folder", F.coalesce("children", F.lit(0)).alias("children"))


def shown_name() -> Column:
    """How an entry of ``tree_entries`` is listed: folders with a slash and their number of entries."""
    name = F.substring_index("path", "/", -1)
    return F.when(F.col("folder") & (F.col("children") > 0), F.concat(name, F.lit("/ ("), F.col("children"), F.lit(" entries)"))).when(F.col("folder"), F.concat(name, F.lit("/"))).otherwise(name)


def fitting_depth(entries: DataFrame, root: str, most_depth: int, most_bytes: int) -> DataFrame:
    """project, depth, bytes, fell_back: the deepest listing of ``tree_entries``, of ``most_depth`` at most, whose text has at most ``most_bytes``.

    A line of depth d takes 3 (d - 1) + 4 bytes before the name, and a line feed before that; the first line is ``root``. Where not even depth 1
    fits, depth is 0 and bytes null.
    """
    size = F.octet_length(shown_name()) + 3 * (F.col("depth") - 1) + 5
    sums = entries.where(F.col("depth") <= most_depth).groupBy("project", "depth").agg(F.sum(size).alias("_b"))
    deep = entries.select("project").distinct().withColumn("depth", F.explode(F.sequence(F.lit(1), F.lit(most_depth))))
    upto = Window.partitionBy("project").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)  # most_depth rows
    sized = deep.join(sums, ["project", "depth"], "left").withColumn("bytes", F.sum(F.coalesce("_b", F.lit(0))).over(upto) + len(root.encode()))
    fits = F.when(F.col("bytes") <= most_bytes, F.struct("depth", "bytes"))
    best = sized.groupBy("project").agg(F.max(fits).alias("_m"))
    depth = F.coalesce(F.col("_m.depth"), F.lit(0))
    return best.select("project", depth.alias("depth"), F.col("_m.bytes").alias("bytes"), (depth < most_depth).alias("fell_back"))


def tree_lines(entries: DataFrame, depths: DataFrame) -> DataFrame:
    """project, place, line: the listing of ``tree_entries`` down to each project's depth (project, depth); by ``place`` it is in order.

    Siblings go by name in lower case. The listing's first line, the root, is not among them.
    """
    own = entries.join(depths.select("project", F.col("depth").alias("_most")), "project").where(F.col("depth") <= F.col("_most")).drop("_most")
    name = F.substring_index("path", "/", -1)
    parent = F.array_join(F.slice(F.split("path", "/"), 1, F.col("depth") - 1), "/")
    key = F.struct(F.lower(name), name)
    ends = own.groupBy("project", parent.alias("_up")).agg(F.max(key).alias("_end"))  # the last of each folder
    marked = own.withColumns({"_up": parent, "_key": key}).join(ends, ["project", "_up"]).withColumn("last", F.col("_key") == F.col("_end"))
    flags = marked.select("project", F.col("path").alias("_a"), F.col("depth").alias("_d"), F.col("last").alias("_last"))
    above = own.select("project", "path", F.explode_outer(ancestors(F.col("path"))).alias("_a")).join(flags, ["project", "_a"], "left")
    lead = above.groupBy("project", "path").agg(F.array_sort(F.collect_list(F.struct("_d", "_last"))).alias("_f"))  # a flag for each folder above
    bars = F.array_join(F.transform(F.filter("_f", lambda x: x["_d"].isNotNull()), lambda x: F.when(x["_last"], "   ").otherwise("|  ")), "")
    line = F.concat(bars, F.when(F.col("last"), "`-- ").otherwise("|-- "), shown_name())
    place = F.transform(F.split("path", "/"), lambda x: F.concat(F.lower(x), F.lit("\x00"), x))
    return marked.join(lead, ["project", "path"]).select("project", F.array_join(place, "\x01").alias("place"), line.alias("line"))
