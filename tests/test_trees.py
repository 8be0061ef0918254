"""Ignore rules against git's own, limits at every row, listings against a plain walk."""

import random
import shutil
import subprocess

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import trees as T

RULES = ["# none", "", "*.log", "!keep.log", "build/", "/top.txt", "docs/*.md", "!docs/README.md", "a/**/z", "**/deep", "sub/**", "!sub/x", "t?mp", "\\!odd", "\\#odd", "trail  ", "b.d/*", "!b.d/q/", "x+y(1)"]
PATHS = ["a.log", "keep.log", "x/keep.log", "build/o.txt", "x/build/o.txt", "x/build", "top.txt", "x/top.txt", "docs/a.md", "docs/README.md", "docs/s/a.md", "a/z", "a/b/c/z", "a/b/z/k", "q/a/z", "deep", "p/deep/r", "sub/x", "sub/y/w", "tamp", "tmp", "!odd", "#odd", "odd", "trail", "b.d/f", "b.d/q/f", "bxd/f", "x+y(1)", "xxy1", "plain/é.rs"]


def verdicts(spark, rules, paths):
    lines = spark.createDataFrame([("p", k, r) for k, r in enumerate(rules)], "project string, pos int, line string")
    entries = spark.createDataFrame([("p", p, False, 1) for p in paths], "project string, path string, folder boolean, size long")
    return {r.path for r in T.collected(entries, T.ignore_rules(lines), [], (), tuple(paths)).where("reason = 'ignored'").collect()}


def test_rules_as_the_plain_reading_has_them(spark):
    want = {"a.log", "build/o.txt", "x/build/o.txt", "top.txt", "docs/a.md", "a/z", "a/b/c/z", "a/b/z/k", "deep", "p/deep/r", "sub/y/w", "tamp", "!odd", "#odd", "trail", "b.d/f", "x+y(1)"}
    assert verdicts(spark, RULES, PATHS) == want


@pytest.mark.skipif(shutil.which("git") is None, reason="git is not there")
def test_rules_against_git(spark, tmp_path):
    rng = random.Random(6)
    names = ["a", "b", "c.x", "d"]
    paths = sorted({"/".join(rng.choices(names, k=rng.randint(1, 4))) for _ in range(120)})
    paths = [p for p in paths if not any(q != p and q.startswith(p + "/") for q in paths)]
    for _ in range(3):
        rules = [("!" if rng.random() < 0.3 else "") + rng.choice(["a", "b/", "/a", "*.x", "a/*", "**/b", "a/**", "c*/d", "d/**/a", "?", "/b/*/a"]) for _ in range(4)]
        root = tmp_path / str(_)
        subprocess.run(["git", "init", "-q", root], check=True)
        (root / ".gitignore").write_text("\n".join(rules))
        for p in paths:
            (root / p).parent.mkdir(parents=True, exist_ok=True)
            (root / p).write_text("")
        told = subprocess.run(["git", "-C", root, "check-ignore", "--stdin"], input="\n".join(paths), capture_output=True, text=True).stdout.split()
        assert verdicts(spark, rules, paths) == set(told), rules


def test_excludes_and_wanted_files(spark):
    assert T.effective_excludes([" Dist ", "", "*.log"], ["dist", "node_modules", "*.LOG"]) == ["Dist", "*.log", "node_modules"]
    own = lambda p, i, e: spark.createDataFrame([(p,)], "p string").select(T.file_wanted(F.col("p"), i, e).alias("x")).first().x
    assert own("src/a.rs", [], []) and own("src/a.rs", ["*.rs"], ["x"]) and not own("src/a.rs", ["*.md"], []) and not own("src/a.rs", ["*.rs"], ["src/*"])
    entries = spark.createDataFrame([("p", None, False, 1), ("q", "a.MD", False, None), ("q", "d", True, None), ("q", "b.md", False, 99), ("q", "n", False, 1)], "project string, path string, folder boolean, size long")
    rules = T.ignore_rules(spark.createDataFrame([], "project string, pos int, line string"))
    got = {r.path: r.reason for r in T.collected(entries, rules, [], ("md",), (), 50).collect()}
    assert got == {"a.MD": None, "d": "folder", "b.md": "size", "n": "type"}


def test_first_breach_at_every_place(spark):
    rng = random.Random(4)
    rows = [(f"p{k:03d}", rng.random() < 0.6, rng.choice([None, 0, 5, 40])) for k in range(60)]
    frame = spark.createDataFrame(rows, "path string, candidate boolean, size long").repartition(4)
    for most in ((25, 999, 9999), (999, 11, 9999), (999, 999, 200), (25, 14, 300), (999, 999, 9999), (1, 1, 1), (60, 99, 9999)):
        n = f = b = 0
        want = None
        for path, c, size in rows:
            n += 1
            if n >= most[0]:
                want = (n, f, b, path, "entries")
                break
            f, b = f + c, b + (size or 0) * c
            if f >= most[1] or b >= most[2]:
                want = (n, f, b, path, "files" if f >= most[1] else "bytes")
                break
        assert [tuple(r) for r in T.first_breach(frame, *most, parts=7).collect()] == [want or (n, f, b, None, "none")]
    assert [tuple(r) for r in T.first_breach(frame.limit(0), 1, 1, 1).collect()] == [(0, 0, 0, None, "none")]


def listing(paths, most):
    """Lines of a tree, by a plain walk."""
    tree = {}
    for p in paths:
        at = tree
        for part in p.split("/"):
            at = at.setdefault(part, {})
    out = []

    def walk(at, lead, depth):
        for k, name in enumerate(sorted(at, key=lambda n: (n.lower(), n)) if depth <= most else []):
            last = k == len(at) - 1
            shown = name if not at[name] else f"{name}/ ({len(at[name])} entries)"
            out.append(f"{lead}{'`-- ' if last else '|-- '}{shown}")
            walk(at[name], lead + ("   " if last else "|  "), depth + 1)

    walk(tree, "", 1)
    return out


def test_listings_and_depths(spark):
    rng = random.Random(9)
    names = ["a", "B", "é", "lib", "x y"]
    paths = ["/".join(rng.choices(names, k=rng.randint(1, 5))) + f".{k}" for k in range(70)]
    entries = T.tree_entries(spark.createDataFrame([("p", p) for p in [*paths, paths[0], None, ""]], "project string, path string"))
    sizes = {d: len("\n".join(["/root", *listing(paths, d)]).encode()) for d in range(1, 7)}
    for most in (0, sizes[1], sizes[2] - 1, sizes[3] + 3, 10**6):
        (got,) = T.fitting_depth(entries, "/root", 6, most).collect()
        depth = max((d for d, n in sizes.items() if n <= most), default=0)
        assert tuple(got) == ("p", depth, sizes.get(depth), depth < 6)
    for depth in (1, 3, 9):
        lines = T.tree_lines(entries, spark.createDataFrame([("p", depth)], "project string, depth int")).orderBy("place").collect()
        assert [r.line for r in lines] == listing(paths, depth)
