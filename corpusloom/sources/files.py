"""Reading files of text collections: headed CSV, JSON lines with a fallback, and text of unknown encoding."""

from __future__ import annotations

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes in which a NUL marks a file as binary.
SNIFF = 8192


def csv_table(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file with a header; every column is a string, rows may be short."""
    return spark.read.csv(path, header=True, inferSchema=False, multiLine=True, escape='"', mode="PERMISSIVE")


def json_or_backup(spark: SparkSession, path: str, backup: str, schema: str, default: bool = False) -> DataFrame:
    """JSON lines at ``path``; where that is missing or holds a line of another form, the good lines at ``backup``.

    Where there is no backup, or no good line in it: with ``default`` a table without rows, else an error. Nulls, missing fields and empty
    lines are no fault. The first file is read once more to look for broken lines.
    """

    def read(where: str) -> tuple[DataFrame, bool, bool] | None:
        """Rows, and whether there are good lines and broken ones; None for a missing path."""
        try:
            rows = spark.read.schema(f"{schema}, _broken string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_broken").json(where)
        except AnalysisException:
            return None
        some = lambda what: bool(rows.where(what).limit(1).collect())
        return rows.where("_broken is null").drop("_broken"), some("_broken is null"), some("_broken is not null")

    first = read(path)
    if first and not first[2]:
        return first[0]
    second = read(backup)
    if second and (second[1] or not second[2]):
        return second[0]
    if default:
        return spark.createDataFrame([], schema)
    raise ValueError(f"neither {path} nor {backup} can be read")


def is_binary(content: Column) -> Column:
    """Whether a NUL stands among the first bytes."""
    return F.hex(F.substring(content, 1, SNIFF)).rlike("^(..)*00")


@F.arrow_udf(T.StringType())
def decoded(content: pa.Array) -> pa.Array:
    """Bytes as UTF-8 where they are that, else as GBK, else as Windows-1252, which Spark's ``decode`` does not offer."""

    def text(data: bytes | None) -> str | None:
        for charset in ("utf-8", "gbk", "cp1252") if data is not None else ():
            try:
                return data.decode(charset)
            except UnicodeDecodeError:
                pass
        return None if data is None else data.decode("utf-8", "replace")

    return pa.array([text(x) for x in content.to_pylist()], pa.string())


def text_files(spark: SparkSession, folder: str, most_bytes: int = 1 << 20) -> DataFrame:
    """path and text of the text files below ``folder``, of at most ``most_bytes`` each; binary ones and empty ones are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).where(F.col("length") <= most_bytes)
    return files.where(~is_binary(F.col("content"))).select("path", decoded("content").alias("text"))


def front_matter(text: Column) -> Column:
    """Map of the ``key: value`` lines between two lines of three dashes at the beginning; empty where there are none."""
    block = F.regexp_extract(text, r"(?s)\A---\r?\n(.*?)\r?\n---", 1)
    pairs = F.filter(F.split(block, r"\r?\n"), lambda x: x.rlike(r"^[\w-]+:"))
    entry = F.transform(pairs, lambda x: F.struct(F.regexp_extract(x, r"^([\w-]+):", 1).alias("key"), F.trim(F.regexp_replace(x, r"^[\w-]+:", ""), F.lit(" \"'")).alias("value")))
    return F.map_from_entries(F.filter(entry, lambda x: x["key"] != ""))
