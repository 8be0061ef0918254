"""Index plans that stop and go on, changed settings, and parts of files."""

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import indexing as I

FILES = [("a", f"f{k}.md", "".join(f"line {k} {j}\n" for j in range(k % 7 + 1))) for k in range(23)] + [("b", "one.md", "x"), ("b", "empty.md", ""), ("b", "null.md", None), ("c", "nothing.md", None)]
PROJECT = "project string, scope_hash string, saved_hash string, mode string, batch_size int"


@pytest.fixture(scope="module")
def parts(spark):
    return I.file_parts(spark.createDataFrame(FILES, "project string, path string, text string"), 3).cache()


def none(spark, shape):
    return spark.createDataFrame([], shape)


def plan(spark, jobs, parts, projects, known=None):
    known = known if known is not None else none(spark, "project string, blob_hash string")
    return I.plan_index(parts, known, projects, *jobs.jobs(projects))


def test_parts_put_together_are_the_text(spark, parts):
    got = {}
    for r in sorted(parts.collect(), key=lambda r: int(r.name.split("#chunk")[1].split("of")[0]) if "#" in r.name else 0):
        got[r.project, r.path] = got.get((r.project, r.path), "") + r.content
    assert got == {(p, f): t for p, f, t in FILES if t is not None}
    assert {r.name for r in parts.where("path = 'f6.md'").collect()} == {"f6.md#chunk1of3", "f6.md#chunk2of3", "f6.md#chunk3of3"}


def test_a_run_that_stops_goes_on(spark, parts, tmp_path):
    projects = spark.createDataFrame([("a", "s1", None, "incremental", 4), ("b", "s1", "s1", "incremental", 4)], PROJECT)
    jobs, got, stops = I.IndexJobs(spark, f"file://{tmp_path}"), [], iter([False, True])

    def send(rows, first):
        if next(stops, False):
            raise RuntimeError("stopped")
        got.extend((r.project, r.blob_hash, r.batch) for r in rows.collect())

    first, pending = plan(spark, jobs, parts, projects)
    total = {r.project: r.total_batches for r in first.collect()}
    want = {(r.project, r.blob_hash, r.batch) for r in pending.collect()}
    with pytest.raises(RuntimeError):
        jobs.run(pending, projects, send, together=2)
    assert {b for _, _, b in got} == {1, 2}
    again, rest = plan(spark, jobs, parts, projects)
    for r in again.collect():
        assert r.total_batches == total[r.project] and r.completed_batches == min(2, total[r.project]) and r.resumed + r.pending == r.total
    assert jobs.run(rest, projects, send, together=2, most=1) == 1
    rest = plan(spark, jobs, parts, projects)[1]
    jobs.run(rest, projects, send, together=100)
    assert len(got) == len(set(got)) and set(got) == want  # each part once, in the batch it was planned for
    summary, rest = plan(spark, jobs, parts, projects)
    assert rest.collect() == [] and {r.progress for r in summary.collect()} == {100}
    assert jobs.run(rest, projects, send) == 0


def test_changed_settings_and_full_rebuilds(spark, parts, tmp_path):
    jobs = I.IndexJobs(spark, f"file://{tmp_path}")
    old = spark.createDataFrame([("a", "s1", None, "incremental", 4)], PROJECT)
    jobs.run(plan(spark, jobs, parts, old)[1], old, lambda rows, first: None, together=3, most=1)
    known = parts.select("project", "blob_hash")
    for scope, saved, mode, resumed, changed, known_too in (("s1", None, "incremental", True, False, False), ("s2", None, "incremental", False, False, False), ("s1", "s1", "full", False, True, True), ("s2", "s1", "incremental", False, True, True), ("s1", "s1", "incremental", False, False, True), ("s1", None, "incremental", True, True, True)):
        now = spark.createDataFrame([("a", scope, saved, mode, 4)], PROJECT)
        (r,) = plan(spark, jobs, parts, now, known if known_too else None)[0].collect()
        assert (r.resumed > 0, r.scope_changed) == (resumed, changed), (scope, saved, mode)
        assert r.existing + r.resumed + r.pending == r.total and (r.existing == r.total) == (known_too and not changed)


def test_statuses_and_projects_without_parts(spark, parts):
    files = spark.createDataFrame(FILES, "project string, path string, text string")
    known = parts.where("name not like '%chunk2%'").select("project", "blob_hash")
    got = {(r.project, r.path): r.status for r in I.file_statuses(files, parts, known).collect()}
    assert got == {(p, f): "pending" if t is None or t.count("\n") > 3 else "indexed" for p, f, t in FILES}
    (r,) = I.plan_index(parts, known, spark.createDataFrame([("c", "s", None, "incremental", 4)], PROJECT), none(spark, "project string, job_hash string, job_mode string, job_batches long"), none(spark, "project string, blob_hash string"))[0].collect()
    assert (r.total, r.total_batches, r.progress, r.scope_changed) == (0, 0, 0, False)


def test_fingerprint_ignores_order_case_and_closing_slashes(spark):
    one = lambda base, exts, n=10: spark.range(1).select(I.settings_fingerprint(F.lit(base), F.lit(n), F.lit(None).cast("int"), F.array(*map(F.lit, exts)), F.lit(None).cast("array<string>")).alias("h")).first().h
    assert one("https://x/", [".RS", " .md "]) == one("https://x", [".md", ".rs", ".md", ""]) != one("https://x", [".md"])
    assert one("https://x", [".md"], 11) != one("https://x", [".md"]) and one(None, [".md"]) is None
