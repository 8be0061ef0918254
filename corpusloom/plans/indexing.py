"""Index plans over documents as the files of projects, one for each source, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.operators import indexing as I
from corpusloom.sources.tables import table

_C = F.col
MOST, BATCH = 12, 10


def files(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang", "source", "text")
    return docs.select("doc_id", _C("source").alias("project"), F.concat_ws("/", "lang", F.concat(_C("doc_id").cast("string"), F.lit(".md"))).alias("path"), "text")


def _hash_of(number, base: str = "https://host/"):
    lists = (F.array(F.lit(".MD"), F.lit(" .txt "), F.lit(".md")), F.array(F.lit("dist"), F.lit("")))
    return I.settings_fingerprint(F.concat(F.lit(base), number.cast("string"), F.lit("//")), F.lit(BATCH), F.lit(MOST), *lists)


def inputs(spark, sf):
    """(parts, known, projects, jobs, sent). A project's number decides its state: index of old settings, full rebuild, resumable job.

    A third of the parts is known under its hash, the others under another; half of the parts are sent.
    """
    parts = I.file_parts(files(spark, sf), MOST)
    number = F.regexp_extract("project", "[0-9]+", 0).cast("int")
    digit = F.conv(F.substring("blob_hash", 1, 1), 16, 10).cast("int")
    other = F.reverse("blob_hash")
    known = parts.select("project", F.when(digit % 3 == 0, _C("blob_hash")).otherwise(other).alias("blob_hash"))
    sent = parts.select("project", F.when(digit % 2 == 0, _C("blob_hash")).otherwise(other).alias("blob_hash"))
    names = parts.select("project").distinct()
    saved = F.when(number % 4 == 1, _hash_of(number + 100)).when(number % 4 != 2, _hash_of(number))
    projects = names.select("project", _hash_of(number).alias("scope_hash"), saved.alias("saved_hash"), F.when(number % 5 == 4, "full").otherwise("incremental").alias("mode"), F.lit(BATCH).alias("batch_size"))
    jobs = names.select("project", F.when(number % 3 == 0, _hash_of(number + 7)).otherwise(_hash_of(number)).alias("job_hash"), F.lit("incremental").alias("job_mode"), (number + 2).cast("long").alias("job_batches"))
    return parts, known, projects, jobs, sent


def _plan(spark, sf):
    return I.plan_index(*inputs(spark, sf))


_JSON = """sha256('{"base_url":"https://host/' || %s || '","batch_size":10,"max_lines":12,"extensions":[".md",".txt"],"excludes":["dist"]}')"""
_PARTS = r"""f AS (SELECT source AS project, lang || '/' || doc_id || '.md' AS path, text, regexp_extract_all(text, '[^\n]*\n|[^\n]+') AS l FROM documents WHERE text IS NOT NULL),
n AS (SELECT *, greatest(1, CAST(ceil(len(l) / 12.0) AS INT)) AS n FROM f),
c AS (SELECT *, unnest(range(1, n + 1)) AS k FROM n),
m AS (SELECT project, path, CASE WHEN n = 1 THEN path ELSE path || '#chunk' || k || 'of' || n END AS name, CASE WHEN n = 1 THEN text ELSE array_to_string(l[(k - 1) * 12 + 1 : k * 12], '') END AS content FROM c),
parts AS (SELECT project, path, name, sha256(name || content) AS blob_hash, CAST('0x' || substr(sha256(name || content), 1, 1) AS INT) AS d FROM m)"""
_PLAN = f"""{_PARTS},
p AS (SELECT project, CAST(regexp_extract(project, '[0-9]+') AS INT) AS no FROM (SELECT DISTINCT project FROM parts)),
own AS (SELECT project, no % 5 = 4 OR no % 4 = 1 OR no % 4 = 2 AS scope_changed, no % 3 <> 0 AND no % 5 <> 4 AS resumes, no + 2 AS batches FROM p),
marked AS (SELECT *, d % 3 = 0 AND NOT scope_changed AS existing, d % 2 = 0 AND resumes AS checked FROM parts JOIN own USING (project)),
sums AS (SELECT project, scope_changed, batches, count(*) AS total, count(*) FILTER (existing) AS existing, count(*) FILTER (checked AND NOT existing) AS resumed, count(*) FILTER (NOT checked AND NOT existing) AS pending, count(*) FILTER (checked) AS checked FROM marked GROUP BY ALL),
plan AS (SELECT project, total, existing, resumed, pending, CAST(least(batches, ceil(checked / 10.0)) AS BIGINT) AS completed_batches, scope_changed FROM sums)"""

QUERIES = {
    "index_plan": (
        lambda s, d: _plan(s, d)[0],
        f"WITH {_PLAN} SELECT project, total, existing, resumed, pending, completed_batches, completed_batches + CAST(ceil(pending / 10.0) AS BIGINT) AS total_batches, CAST((existing + resumed) * 100 // total AS INT) AS progress, scope_changed FROM plan",
    ),
    "index_batches": (
        lambda s, d: _plan(s, d)[1].select("project", "name", "blob_hash", "batch"),
        f"""WITH {_PLAN} SELECT project, name, blob_hash, completed_batches + 1 + (row_number() OVER (PARTITION BY project ORDER BY blob_hash) - 1) // 10 AS batch
FROM marked JOIN plan USING (project) WHERE NOT marked.existing AND NOT checked""",
    ),
    "file_statuses": (
        lambda s, d: I.file_statuses(files(s, d), inputs(s, d)[0], inputs(s, d)[1]),
        f"""WITH {_PARTS}, w AS (SELECT project, path, bool_and(d % 3 = 0) AS ok FROM parts GROUP BY ALL)
SELECT source AS project, lang || '/' || doc_id || '.md' AS path, CASE WHEN ok THEN 'indexed' ELSE 'pending' END AS status FROM documents LEFT JOIN w ON project = source AND path = lang || '/' || doc_id || '.md'""",
    ),
    "settings_fingerprint": (
        lambda s, d: inputs(s, d)[2].select("project", "scope_hash"),
        f"SELECT DISTINCT source AS project, {_JSON % 'CAST(regexp_extract(source, chr(91) || chr(48) || chr(45) || chr(57) || chr(93) || chr(43)) AS INT)'} AS scope_hash FROM documents WHERE text IS NOT NULL",
    ),
}
