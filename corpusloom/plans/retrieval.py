"""Retrieval queries and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions.text import bm25_tokens, lines
from corpusloom.operators import retrieval as R
from corpusloom.sources.tables import table

_TOKENS = r"list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^\p{L}\p{M}\p{N}_\s]', ' ', 'g'), '\s+'), lambda x: strlen(x) > 2)"
_POSTINGS = f"""toks AS (SELECT doc_id, {_TOKENS} AS t FROM documents),
post AS (SELECT doc_id, token, any_value(dl) AS dl, count(*) AS tf FROM (SELECT doc_id, len(t) AS dl, unnest(t) AS token FROM toks) GROUP BY doc_id, token),
size AS (SELECT count(*) AS n, avg(coalesce(len(t), 0)) AS avgdl FROM toks),
df AS (SELECT token, count(*) AS df FROM post GROUP BY token)"""


def _bm25_sql(items: str, k: int) -> str:
    return f"""WITH {_POSTINGS},
terms AS (SELECT item_id, token, count(*) AS times FROM (SELECT item_id, unnest({_TOKENS}) AS token FROM benchmark {items}) GROUP BY item_id, token),
total AS (SELECT item_id, doc_id, round(sum(times * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
  FROM post JOIN df USING (token) JOIN terms USING (token), size GROUP BY item_id, doc_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM total WHERE score > 0)
SELECT item_id, doc_id, score, rank FROM ranked WHERE rank <= {k}"""


def _docs(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "text")


def _bench(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", "text")


def _first(spark, sf):
    bench = _bench(spark, sf)
    return bench.join(F.broadcast(bench.agg(F.min("item_id").alias("item_id"))), "item_id")  # one row


QUERIES = {
    "bm25_stats": (lambda s, d: R.token_stats(_docs(s, d)), f"WITH {_POSTINGS} SELECT token, df, round(ln((n - df + 0.5) / (df + 0.5) + 1), 6) AS idf FROM df, size"),
    "bm25_topk": (lambda s, d: R.bm25(_docs(s, d), _first(s, d), 10), _bm25_sql("WHERE item_id = (SELECT min(item_id) FROM benchmark)", 10)),
    "bm25_batch": (lambda s, d: R.bm25(_docs(s, d), _bench(s, d), 10), _bm25_sql("", 10)),
    "coverage_rerank": (
        lambda s, d: R.coverage(_docs(s, d), _bench(s, d), 10),
        f"""WITH {_POSTINGS}, terms AS (SELECT item_id, unnest(list_distinct({_TOKENS})) AS token FROM benchmark),
hits AS (SELECT item_id, doc_id, count(*) AS covered FROM post JOIN terms USING (token) GROUP BY item_id, doc_id)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY covered DESC, doc_id) AS rank FROM hits) WHERE rank <= 10""",
    ),
    "token_counts": (lambda s, d: _docs(s, d).select("doc_id", F.size(bm25_tokens(F.col("text"))).alias("n_tokens")), f"SELECT doc_id, len({_TOKENS}) AS n_tokens FROM documents"),
    "grep_lines": (
        lambda s, d: R.grep(_docs(s, d), r"[0-9]{3}-[0-9]{4}"),
        """WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), e AS (SELECT doc_id, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS line_no FROM l)
SELECT doc_id, line_no, line FROM e WHERE regexp_matches(line, '[0-9]{3}-[0-9]{4}')""",
    ),
    "line_range": (
        lambda s, d: _docs(s, d).select("doc_id", F.array_join(F.slice(lines(F.col("text")), 2, 3), "\n").alias("part")),
        "SELECT doc_id, array_to_string(string_split(text, chr(10))[2:4], chr(10)) AS part FROM documents",
    ),
    "chunk_lines": (
        lambda s, d: R.line_windows(_docs(s, d), 80, 20),
        """WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text <> ''),
c AS (SELECT doc_id, ls, unnest(range(0, greatest(1, CAST(ceil((len(ls) - 20) / 60.0) AS INT)))) AS chunk FROM l)
SELECT doc_id, chunk, chunk * 60 + 1 AS start_line, least(chunk * 60 + 80, len(ls)) AS end_line, sha256(array_to_string(ls[chunk * 60 + 1 : chunk * 60 + 80], chr(10))) AS sha256 FROM c""",
    ),
}
