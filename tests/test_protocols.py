"""Plan logs, sections and JSON heads against plain Python, on random and odd input."""

import random

from pyspark.sql import functions as F

from corpusloom.functions import protocol as P
from corpusloom.operators import planlog as L

OPS = f"workspace string, seq long, action string, items {L.ITEMS}, item string, status string"


def outcomes(ops):
    held, items, out = False, [], []
    for seq, action, new, item, status in ops:
        kind, changed, step = "ok", False, {("pending", "in_progress"), ("in_progress", "completed")}
        if action == "set":
            own = [(i.strip(), t.strip(), s) for i, t, s in new or []]
            good = own and item is None and status is None and all(i and t and s in L.STATUSES for i, t, s in own) and len({i for i, _, _ in own}) == len(own) and sum(s == "in_progress" for *_, s in own) <= 1
            if good:
                changed, held, items = not held or own != items, True, own
            else:
                kind = "invalid"
        elif action == "update":
            now = next((s for i, _, s in items if i == (item or "").strip()), None)
            if new is not None or not (item or "").strip() or status not in L.STATUSES:
                kind = "invalid"
            elif not held or now is None or (now != status and ((now, status) not in step or (status == "in_progress" and any(s == "in_progress" for _, _, s in items)))):
                kind = "conflict"
            else:
                changed = now != status
                items = [(i, t, status if i == item.strip() else s) for i, t, s in items]
        elif action in ("get", "clear"):
            if new is not None or item is not None or status is not None:
                kind = "invalid"
            elif action == "clear":
                changed, held, items = held, False, []
        else:
            kind = "invalid"
        out.append((seq, kind, changed, sum(s == "completed" for *_, s in items), len(items)))
    return out, items


def test_plans_against_a_plain_fold(spark):
    rng, rows, want, left = random.Random(1), [], [], []
    for w in range(6):
        ops = []
        for seq in range(120):
            action = rng.choice(["set", "update", "update", "update", "update", "get", "clear", "drop"]) if rng.random() < 0.9 else "update"
            new = [(rng.choice(["a", " b", "c ", "d", ""] if rng.random() < 0.1 else [chr(97 + k)]), rng.choice(["t"] * 9 + [" "]), rng.choice(["pending"] * 6 + ["in_progress", "completed", "other"])) for k in range(rng.randint(0, 4))] if action == "set" or rng.random() < 0.03 else None
            item = rng.choice([" a", "b", "c", "z", " ", None] if rng.random() < 0.3 else ["a", "b"]) if action == "update" or rng.random() < 0.05 else None
            status = rng.choice(["in_progress", "completed", "in_progress", "pending", "wrong", None]) if action == "update" else None
            ops.append((seq, action, new, item, status))
        told, items = outcomes(ops)
        want += [(f"w{w}", *t) for t in told]
        left += [(f"w{w}", k, *i) for k, i in enumerate(items)]
        rows += [(f"w{w}", *op) for op in ops]
    log = spark.createDataFrame(rows + [(None, 0, "get", None, None, None)], OPS).repartition(5)
    got = L.plan_outcomes(log)
    assert sorted((r.workspace, r.seq, r.outcome, r.changed, r.completed, r.total) for r in got.collect()) == sorted(want)
    assert {r.outcome for r in got.select("outcome").distinct().collect()} == {"ok", "invalid", "conflict"}
    assert sorted(map(tuple, L.plan_items(log).collect())) == sorted(left)
    assert L.plan_outcomes(log.limit(0)).collect() == [] and L.plan_items(log.limit(0)).collect() == []


def found(text, backend):
    out, place, lines = [], None, []

    def flush():
        nonlocal place, lines
        kept = [x for x in lines if x.strip() not in ("", "...")]
        if place is not None and kept:
            out.append((backend, place, "\n".join(kept)))
        place, lines = None, []

    for line in (text.split("\n") if text is not None else []):
        line = line.removesuffix("\r")
        if line.startswith("### remote backend: "):
            flush()
            backend = line[20:].strip()
        elif line.startswith("Path: "):
            flush()
            own = line[6:].strip()
            a, sep, b = own.rpartition(" (L")
            place = f"{a.strip(' ')}:{b.rstrip(')').replace('-L', '-')}" if sep else own
        elif line.startswith("Lines: L"):
            place = place and f"{place}:{line[8:].strip(' ').replace('-L', '-')}"
        elif line.startswith(("The following code sections were retrieved:", "[index metadata]", "[index-local]", "[fast-context stats]", "grep keywords:")):
            pass
        elif place is not None:
            lines.append(line.rstrip())
    flush()
    return out


def test_sections_against_a_plain_parser(spark):
    rng = random.Random(3)
    forms = ["### remote backend: north ", "### remote backend: x", "Path: a/b.rs", "Path: c d.md (L3-L9)", "Path: e (1) (L2)", "Lines: L4-L7", "Lines: L1", "[index metadata] q", "[fast-context stats] 3", "[index-local] none", "grep keywords: a", "The following code sections were retrieved: 2", "", "  ", "...", " ... ", "code line  ", "  indented", "\ttab\t", "plain\r", "[not noise]"]
    texts = ["\n".join(rng.choice(forms) for _ in range(rng.randint(0, 25))) for _ in range(300)] + [None, "", "Path: x", "Path: x\ny"]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string").select("k", P.sections(F.col("t"), "local").alias("s"))
    for r in rows.collect():
        want = found(texts[r.k], "local")
        assert [tuple(x) for x in r.s or []] == want, texts[r.k]
        assert (r.s is None) == (texts[r.k] is None)


def end(text):
    depth, inside, escaped = 0, False, False
    for k, c in enumerate(text):
        if inside:
            if escaped:
                escaped = False
            elif c == "\\":
                escaped = True
            elif c == '"':
                inside = False
        elif c == '"':
            inside = True
        elif c == "{":
            depth += 1
        elif c == "}":
            depth = max(depth - 1, 0)
            if depth == 0:
                return k + 1
    return None


def test_object_ends_against_a_plain_scanner(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice('{{}"\\ax\n漢') for _ in range(rng.randint(0, 40))) for _ in range(1500)] + ["", "}", "{", '{"a": "}\\""} tail', '{"open', "\\{}", '"']
    for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", P.object_end(F.col("t")).alias("e")).collect():
        assert r.e == end(r.t), r.t
    one = lambda t, f: spark.createDataFrame([(t,)], "t string").select(f(F.col("t")).alias("x")).first().x
    assert one(None, P.object_end) is None and one(None, P.json_head) is None and one("none", P.json_head) is None
    assert one('noise {"a": {"b": "x}"}, "n": 1} {"a": 2}', P.json_head) == '{"a": {"b": "x}"}, "n": 1}'
    assert one('answer: {"n": 12, "s": "q"} and more', lambda t: P.loose_field(t, "n")) == "12" and one('{"n": 12', lambda t: P.loose_field(t, "n")) is None
    deep = "{" * 3000 + '"}"' + "}" * 3000
    assert one(deep + "}}", P.object_end) == len(deep)


def test_a_long_string_in_an_object(spark):
    inside = '{"k": "' + 'a\\"}' * 100_000 + '"}'
    got = spark.createDataFrame([(inside + " tail",), ('"' + "\\\\" * 100_000,)], "t string").select(P.object_end(F.col("t")).alias("e"), P.json_head(F.col("t")).alias("h")).collect()
    assert [r.e for r in got] == [len(inside), None] and [r.h for r in got] == [inside, None]
