"""A corpus pipeline over ``documents``: judge quality, drop near duplicates, mask personal data, mix sources, encode.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet to the
shared folder and read again as the next stage's input.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import bytebpe, jaccard, mixing, pii, quality
from corpusloom.sources.tables import materialize, table

#: The stages learn models and draw at random from seeds; SQL can't express that.
ORACLE_SQL = None


#: Rows of an Arrow batch in this pipeline's session: its texts are long and its workers run stage after stage.
BATCH = 1000
KNOWN = ("doc_id", "text", "lang", "source", "n_chars")


def _own_names(stage: Callable) -> Callable:
    """The stage with all columns but the known ones under neutral names, so that no column of ``docs`` can clash."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH)
        plain = [c if c in KNOWN else f"extra_{k}" for k, c in enumerate(docs.columns)]
        return stage(spark, docs.toDF(*plain), sf_dir).toDF(*docs.columns)

    return run


def _as(docs: DataFrame, out: DataFrame) -> DataFrame:
    """``out`` with the columns of ``docs`` in their order; n_chars, where there is one, follows the text."""
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


@_own_names
def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject, with all their columns."""
    meta = ("n_chars",) if "n_chars" in docs.columns else ()
    machine = quality.learn(docs, table(spark, sf_dir, "labels"), metadata=meta)
    return quality.score(docs, machine, metadata=meta, keep=tuple(docs.columns)).where("predicted = 1").select(*docs.columns)


@_own_names
def keep_one_of_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: that of least id, nulls last; then a hash of the row decides.

    Rows are told apart, not ids: repeated rows, rows without id and rows that share an id are judged each by its text.
    Rows without words stay.
    """
    rows = docs.withColumns({"_order": F.xxhash64("text", *docs.columns), "_row": F.monotonically_increasing_id()})
    rows = materialize(rows, "pipeline-rows")  # so that a row has one number in all that follows
    gone = materialize(jaccard.groups(rows, keep=("_order", "_row")).where("not leads").select("_row"), "pipeline-gone")  # its size is then known
    return rows.join(gone, "_row", "left_anti").select(*docs.columns)


@_own_names
def mask_personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind; n_chars follows the text."""
    return _as(docs, pii.redacted(docs, pii.learn(docs)))


@_own_names
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources: a row for each slice of a document in a drawn block, as a document of its own."""
    other = tuple(c for c in docs.columns if c not in ("doc_id", "text", "source", "n_chars"))
    return _as(docs, mixing.mixed(docs, keep=other))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of ids and of decoded bytes for each row."""
    return bytebpe.encode_documents(docs, *bytebpe.public_file())


STAGES = [
    ("quality", keep_good),
    ("near_duplicates", keep_one_of_near),
    ("personal_data", mask_personal),
    ("mix", mix),
    ("byte_bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
