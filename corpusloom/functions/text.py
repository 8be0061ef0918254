"""Column expressions over text; all native, none runs Python."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def bm25_tokens(text: Column) -> Column:
    """Lower-case words of more than two bytes; anything but letters, marks, digits, underscore and space parts words."""
    words = F.split(F.regexp_replace(F.lower(text), r"(?U)[^\w\s]", " "), r"(?U)\s+")
    return F.filter(words, lambda w: F.octet_length(w) > 2)


def collapsed(text: Column) -> Column:
    """Runs of white space as one space, trimmed."""
    return F.trim(F.regexp_replace(text, r"[\x20\x09-\x0D]+", " "))


def truncated(text: Column, n: int) -> Column:
    """At most n characters, then three dots."""
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)


def byte_size(n: Column) -> Column:
    """Binary units with two decimals, halves rounded up; null for null."""
    scaled = lambda k: F.format_string("%d.%02d", F.floor((n * 100 / 1024**k + 0.5) / 100), F.floor(n * 100 / 1024**k + 0.5) % 100)
    return (
        F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B")))
        .when(n < 1024**2, F.concat(scaled(1), F.lit(" KB")))
        .when(n < 1024**3, F.concat(scaled(2), F.lit(" MB")))
        .when(n.isNotNull(), F.concat(scaled(3), F.lit(" GB")))
    )


def lines(text: Column) -> Column:
    return F.split(text, "\n")


def ancestors(path: Column) -> Column:
    """All directories above a path, outermost first: a/b/c gives a and a/b."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, 1, k), "/"))).otherwise(F.array().cast("array<string>"))


def url_path(url: Column) -> Column:
    """Host and path of a URL: no scheme, query, fragment or closing slash."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(url, r"^[a-z]+://", ""), r"[?#].*$", ""), r"/+$", "")


def age_bucket(seconds: Column) -> Column:
    """Age in words: now, minutes, hours, days, months, years."""
    return (
        F.when(seconds < 60, "now").when(seconds < 3600, "minutes").when(seconds < 86400, "hours")
        .when(seconds < 30 * 86400, "days").when(seconds < 365 * 86400, "months").otherwise("years")
    )


def cjk_share(text: Column) -> Column:
    """Part of a text's characters in the three CJK ideograph ranges; 0 for an empty text, null for null."""
    cjk = F.length(F.regexp_replace(text, r"[^\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{F900}-\x{FAFF}]", ""))
    return F.when(F.length(text) == 0, 0.0).otherwise(cjk / F.length(text))


def camel_parts(word: Column) -> Column:
    """Pieces of a word, cut before a capital after a small letter or digit, and before the last of several capitals."""
    return F.split(word, r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])")


def grams(text: Column, n: int) -> Column:
    """All runs of n characters, in order; none where the text is shorter, null for null."""
    chars = F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))
    if n == 1:
        return chars

    def runs(c: Column) -> Column:
        return F.when(F.size(c) >= n, F.transform(F.sequence(F.lit(1), F.size(c) - (n - 1)), lambda i: F.array_join(F.slice(c, i, F.lit(n)), ""))).otherwise(F.array().cast("array<string>"))

    # one element binds the characters: an outer expression inside a lambda would be worked out again for each run
    return F.when(text.isNotNull(), F.get(F.transform(F.array(chars), runs), F.lit(0)))


def code_tokens(text: Column) -> Column:
    """Distinct lower-case tokens in order of appearance. Null for null.

    A run of letters, digits and path signs gives itself, then each segment between signs followed by the segment's
    camel-case parts. A run of CJK ideographs gives itself, its pairs and its triples.
    """
    runs = F.regexp_extract_all(text, F.lit(r"[A-Za-z0-9_\-./:\\]+|[\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}]+"), F.lit(0))
    bare = F.transform(runs, lambda r: F.regexp_replace(r, r"^[_\-./:\\]+|[_\-./:\\]+$", ""))
    segments = lambda r: F.flatten(F.transform(F.split(r, r"[_\-./:\\]+"), lambda x: F.concat(F.array(x), camel_parts(x))))
    each = F.transform(bare, lambda r: F.concat(F.array(r), F.when(r.rlike("^[\\x00-\\x7F]*$"), segments(r)).otherwise(F.concat(grams(r, 2), grams(r, 3)))))
    return F.array_distinct(F.transform(F.filter(F.flatten(each), lambda t: t != ""), F.lower))


# The forms of runs, segments and camel-case parts in a whole text; possessive loops need no call for each character.
CJK = r"\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}"
RUN_FORM = r"[A-Za-z0-9]++(?:[_\-./:\\]++[A-Za-z0-9]++)++"
CAMEL_FORM = r"[A-Z]+(?=[A-Z][a-z])|[A-Z]*[a-z0-9]+|[A-Z]+"


def code_token_set(text: Column) -> Column:
    """The tokens of ``code_tokens`` in another order, cut from the whole text at once. Null for null."""
    found = lambda form: F.regexp_extract_all(text, F.lit(form), F.lit(0))
    none = F.array().cast("array<string>")
    camel = F.when(text.rlike("[a-z0-9][A-Z]|[A-Z][A-Z][a-z]"), found(CAMEL_FORM)).otherwise(none)
    pieces = lambda r: F.concat(F.array(r), grams(r, 2), grams(r, 3))
    cjk = F.when(text.rlike(f"[{CJK}]"), F.flatten(F.transform(F.array_distinct(found(f"[{CJK}]+")), pieces))).otherwise(none)
    # tokens are ASCII or ideographs, so one call can lower them all
    low = F.split(F.lower(F.array_join(F.concat(found("[A-Za-z0-9]+"), found(RUN_FORM), camel), " ")), " ")
    return F.when(text.isNotNull(), F.array_distinct(F.concat(F.array_remove(low, ""), cjk)))


# Words that are no query terms.
STOP_WORDS = ("the", "and", "for", "from", "with", "this", "that", "what", "where", "when", "代码", "项目", "搜索", "相关", "实现", "如何", "怎么", "什么", "是否")


def query_terms(text: Column, most: int = 24) -> Column:
    """Code tokens of two bytes and more without stop words: ASCII first, then those of two or three characters, then the rest."""
    found = F.filter(code_tokens(text), lambda t: (F.octet_length(t) >= 2) & ~t.isin(*STOP_WORDS))
    plain = lambda t: F.octet_length(t) == F.length(t)
    short = lambda t: ~plain(t) & F.length(t).between(2, 3)
    return F.slice(F.concat(F.filter(found, plain), F.filter(found, short), F.filter(found, lambda t: ~plain(t) & ~short(t))), 1, most)


def markdown_tokens(text: Column) -> Column:
    """Distinct lower-case runs of two and more ASCII letters and digits, and pairs of the basic CJK block, in order of appearance."""
    runs = F.regexp_extract_all(text, F.lit(r"[A-Za-z0-9]{2,}|[\x{4E00}-\x{9FFF}]{2,}"), F.lit(0))
    return F.array_distinct(F.flatten(F.transform(runs, lambda r: F.when(r.rlike("^[A-Za-z0-9]"), F.array(F.lower(r))).otherwise(grams(r, 2)))))


def fnv1a64(data: Column) -> Column:
    """The 64-bit FNV-1a hash of a text's UTF-8 bytes, as 16 hex digits. Null for null.

    The product by the prime 2**40 + 435 is taken in two 32-bit halves, so no step leaves the long range.
    """
    hexes = F.hex(F.encode(data, "UTF-8"))
    codes = F.when(F.length(hexes) > 0, F.transform(F.sequence(F.lit(1), F.length(hexes), F.lit(2)), lambda k: F.conv(hexes.substr(k, F.lit(2)), 16, 10).cast("long"))).when(data.isNotNull(), F.array().cast("array<bigint>"))
    mask = F.lit(0xFFFFFFFF)

    def step(state: Column, byte: Column) -> Column:
        low = state.low.bitwiseXOR(byte)
        product = low * 435
        high = (state.high * 435 + F.shiftright(product, 32) + low * 256).bitwiseAND(mask)
        return F.struct(high.alias("high"), product.bitwiseAND(mask).alias("low"))

    start = F.struct(F.lit(0xCBF29CE4).cast("long").alias("high"), F.lit(0x84222325).cast("long").alias("low"))
    word = lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")
    return F.aggregate(codes, start, step, lambda s: F.concat(word(s.high), word(s.low)))


# Endings that the stemmer cuts, tried in this order.
ENDINGS = ("ness", "ment", "tion", "sion", "able", "ible", "ingly", "edly", "ing", "ed", "ly", "ity")


def stem(token: Column) -> Column:
    """The token without its first fitting ending, where more than two bytes stay; else without a plural's es or s.

    Null for null, for tokens of four bytes or fewer, for tokens beyond ASCII, and where nothing is cut.
    """
    n = F.length(token)
    rules = [(end, n > len(end) + 2) for end in ENDINGS] + [("es", n > 5), ("s", (n > 5) & ~token.endswith("ss"))]
    cut = F.coalesce(*[F.when(token.endswith(end) & long, F.substring(token, F.lit(1), n - len(end))) for end, long in rules])
    return F.when(token.rlike("^[\\x00-\\x7F]{5,}$"), cut)


# The form of an answer's file elements and their ranges.
FILE_FORM, RANGE_FORM = r"(?s)<file\s+path=[\"']([^\"']+)[\"']>(.*?)</file>", r"<range>([0-9]{1,9})-([0-9]{1,9})</range>"


def answer_files(text: Column) -> Column:
    """Structs of path and line ranges from the file elements of an answer, in order; null for null.

    The leading /codebase of a path is dropped; other absolute paths and paths with a parent step are left out. A range
    starts at 1 at least and ends at the greater of both its numbers, so 0-0 gives 1 to 0.
    """
    form = F.lit(FILE_FORM)
    inside = lambda p: F.regexp_replace(F.translate(F.trim(p), "\\", "/"), "^(/codebase)+/*", "")
    part = lambda body, k: F.regexp_extract_all(body, F.lit(RANGE_FORM), F.lit(k))

    def ranges(body: Column) -> Column:
        return F.zip_with(part(body, 1), part(body, 2), lambda a, b: F.struct(F.greatest(a.cast("int"), F.lit(1)).alias("start"), F.greatest(b.cast("int"), a.cast("int")).alias("end")))

    files = F.zip_with(F.regexp_extract_all(text, form, F.lit(1)), F.regexp_extract_all(text, form, F.lit(2)), lambda p, body: F.struct(inside(p).alias("path"), ranges(body).alias("ranges")))
    return F.filter(files, lambda f: ~f.path.startswith("/") & ~f.path.rlike(r"(^|/)\.\.(/|$)"))


def version_parts(version: Column) -> Column:
    """The numeric parts of a dotted version; parts that are no number are left out."""
    return F.transform(F.filter(F.split(F.regexp_replace(version, "^v", ""), r"\."), lambda x: x.rlike("^[0-9]{1,18}$")), lambda x: x.cast("long"))


def version_order(one: Column, two: Column) -> Column:
    """-1, 0 or 1 as version ``one`` is less than, equal to or greater than ``two``; missing parts are 0."""
    a, b = version_parts(one), version_parts(two)
    n = F.greatest(F.size(a), F.size(b))
    part = lambda x, k: F.coalesce(F.get(x, k), F.lit(0))
    signs = F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda k: F.sign(part(a, k) - part(b, k)).cast("int"))
    return F.aggregate(signs, F.lit(0), lambda found, x: F.when(found != 0, found).otherwise(x))


def thousands(n: Column) -> Column:
    """1000 and more as thousands with one decimal, halves rounded up, and K."""
    tenths = F.floor((n + 50) / 100)
    return F.when(n >= 1000, F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit("K"))).otherwise(n.cast("string"))


def slug(text: Column, fallback: str) -> Column:
    """Lower-case letters, digits, hyphens and underscores; white space as a hyphen; ``fallback`` where nothing is left."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), r"[ \t\n]+", "-"), "[^a-z0-9_-]", "")
    trimmed = F.regexp_replace(bare, "^-+|-+$", "")
    return F.when(trimmed == "", fallback).otherwise(F.coalesce(trimmed, F.lit(fallback)))


def plain_path(path: Column) -> Column:
    """Forward slashes, without the long-path prefix and closing slashes."""
    return F.regexp_replace(F.regexp_replace(F.translate(path, "\\", "/"), r"^//\?/", ""), "/+$", "")


def path_excluded(path: Column, pattern: str) -> Column:
    """Whether a relative path is the pattern or lies in such a folder; outer dots, slashes and stars of the pattern do not count."""
    bare = pattern.removeprefix("./").strip("/*")
    return (path == bare) | path.startswith(bare + "/") | path.contains(f"/{bare}/") | path.endswith(f"/{bare}")


def glob_regex(glob: str) -> str:
    """A glob of ``*``, ``**`` and ``?`` as a regular expression over a whole path."""
    signs = {"**": ".*", "*": "[^/]*", "?": "[^/]"}
    return "^" + "".join(signs.get(x) or re.escape(x) for x in re.findall(r"\*\*|.", glob)) + "$"


def glob_excluded(path: Column, globs: list[str]) -> Column:
    """Whether a glob matches the whole path or one of its segments; no glob excludes nothing."""
    hit = lambda x: reduce(lambda a, g: a | x.rlike(glob_regex(g)), globs, F.lit(False))
    return hit(path) | F.exists(F.split(path, "/"), hit)


def file_supported(path: Column, suffixes: tuple[str, ...], names: tuple[str, ...]) -> Column:
    """Whether the last segment has one of the suffixes, in any case, or is one of the names."""
    name = F.substring_index(path, "/", -1)
    return F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1)).isin(*suffixes) | name.isin(*names)


# The form of a log line.
LINE_FORM = r"^(\S+ \S+) \[([A-Z]+)\] \[([^\]]*)\] (.*)$"


def log_fields(line: Column) -> Column:
    """Struct of ts, level, module and message of a line ``<time> [LEVEL] [module] message``; null where a line has another form."""
    form = LINE_FORM
    own = F.struct(*[F.regexp_extract(line, form, k).alias(n) for k, n in enumerate(("ts", "level", "module", "message"), 1)])
    return F.when(line.rlike(form), own)


def backoff(base_ms: int, attempt: Column) -> Column:
    """Milliseconds to wait before the given attempt, from 1: doubled each time."""
    return (F.lit(base_ms) * F.pow(F.lit(2), attempt - 1)).cast("long")


def percent_rate(part: Column, whole: Column) -> Column:
    """Per cent with one decimal; 0 where the whole is 0."""
    return F.when(whole == 0, 0.0).otherwise(F.round(part / whole * 1000) / 10)


def cut_output(text: Column, lines_: int, chars: int, mark: str) -> Column:
    """At most so many lines of at most so many characters, and a mark where lines were left out."""
    own = F.split(text, "\n")
    some = F.array_join(F.transform(F.slice(own, 1, lines_), lambda x: F.substring(x, 1, chars)), "\n")
    return F.when(F.size(own) > lines_, F.concat(some, F.lit("\n" + mark))).otherwise(some)
