"""Parsing of text protocols as native expressions: sections of search answers, and JSON objects at the head of a text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# How the lines of an answer begin.
BACKEND, PATH, RANGE = r"^### [a-z]+ backend: ", "Path: ", "Lines: L"
NOISE = (r"^The following code sections were retrieved:", r"^\[[a-z]+(-[a-z]+)? (metadata|fallback|stats|config)\]", r"^\[[a-z]+-local\]", r"^grep keywords:")


def _strip(text: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def _place(path: Column) -> Column:
    """A path with a closing ``(L1-L2)`` as path:1-2."""
    own = _strip(path)
    at = F.length(F.substring_index(own, " (L", -1))
    ranged = F.concat(_strip(own.substr(F.lit(1), F.length(own) - at - 3)), F.lit(":"), F.replace(F.regexp_replace(F.substring_index(own, " (L", -1), r"\)+$", ""), F.lit("-L"), F.lit("-")))
    return F.when(F.contains(own, F.lit(" (L")), ranged).otherwise(own)


def sections(text: Column, backend: str) -> Column:
    """Structs of backend, location and excerpt of the sections of an answer, in order; null for null.

    A section begins at a path line and ends at the next path or backend line. Range lines within it go to its location; noise,
    blank and ``...`` lines are left out, and so are sections without other lines. Before the first backend line ``backend`` holds.
    """
    lines = F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(x, "\r$", ""))

    def cut(l: Column) -> Column:
        places = F.sequence(F.lit(1), F.size(l))
        backends = F.filter(places, lambda k: F.element_at(l, k).rlike(BACKEND))
        heads = F.filter(places, lambda k: F.startswith(F.element_at(l, k), F.lit(PATH)) | F.element_at(l, k).rlike(BACKEND))
        spans = F.zip_with(heads, F.concat(F.slice(heads, 2, 1 << 30), F.array(F.size(l) + 1)), lambda a, b: F.struct(a.alias("at"), b.alias("end")))
        own = F.filter(spans, lambda s: F.startswith(F.element_at(l, s["at"]), F.lit(PATH)) & s["end"].isNotNull())

        def section(s: Column) -> Column:
            inside = F.slice(l, s["at"] + 1, s["end"] - s["at"] - 1)
            last = F.array_max(F.filter(backends, lambda k: k < s["at"]))
            named = F.when(last.isNotNull(), _strip(F.regexp_replace(F.element_at(l, F.coalesce(last, F.lit(1))), BACKEND, ""))).otherwise(backend)
            is_range = lambda x: F.startswith(x, F.lit(RANGE))
            ranges = F.transform(F.filter(inside, is_range), lambda x: F.concat(F.lit(":"), F.replace(_strip(F.substring(x, len(RANGE) + 1, 1 << 30)), F.lit("-L"), F.lit("-"))))
            location = F.concat(_place(F.substring(F.element_at(l, s["at"]), len(PATH) + 1, 1 << 30)), F.array_join(ranges, ""))
            plain = F.filter(inside, lambda x: ~is_range(x) & ~x.rlike("|".join(NOISE)) & ~_strip(x).isin("", "..."))
            return F.struct(named.alias("backend"), location.alias("location"), F.array_join(F.transform(plain, lambda x: F.regexp_replace(x, r"(?U)\s+$", "")), "\n").alias("excerpt"))

        return F.filter(F.transform(own, section), lambda s: _strip(s["excerpt"]) != "")

    return F.when(text.isNotNull(), F.get(F.transform(F.array(lines), cut), F.lit(0)))


def object_end(text: Column) -> Column:
    """Characters up to the brace that closes the first JSON object; null where none closes.

    Braces in strings do not count, nor do escaped quotes end a string; a closing brace without an open one ends at once. The fold runs
    over strings, braces and what lies between, not over single characters.
    """
    # possessive loops run without a call for each character, so a long string can't overflow a task's stack
    parts = F.regexp_extract_all(text, F.lit(r'"[^"\\]*+(?:\\[\s\S][^"\\]*+)*+"?|[{}]|[^"{}]++'), F.lit(0))
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("length"), F.lit(None).cast("int").alias("end"))

    def step(s: Column, part: Column) -> Column:
        depth = F.when(part == "{", s["depth"] + 1).when(part == "}", F.greatest(s["depth"] - 1, F.lit(0))).otherwise(s["depth"])
        length = s["length"] + F.length(part)
        end = F.coalesce(s["end"], F.when((part == "}") & (depth == 0), length))
        return F.struct(depth.alias("depth"), length.alias("length"), end.alias("end"))

    return F.aggregate(parts, start, step, lambda s: s["end"])


def json_head(text: Column) -> Column:
    """The first JSON object of a text, from its first opening brace; null where none closes."""
    own = F.when(F.instr(text, "{") > 0, F.substring(text, F.instr(text, "{"), F.length(text)))
    return F.substring(own, F.lit(1), object_end(own))


def loose_field(text: Column, name: str) -> Column:
    """A field of the first JSON object in a text, as text; null where there is no whole object, no such field or a null."""
    return F.get_json_object(json_head(text), f"$.{name}")
