"""Similarity of short texts: known cases and the empty and null ones."""

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import similarity as S

CASES = [
    ("使用 KISS 原则", "使用 KISS 原则", 1.0, 1.0), ("使用 KISS 原则", "使用KISS原则", 0.8, 1.0), ("使用 KISS 原则", "遵循 KISS 原则", 0.7, 1.0),
    ("KISS", "使用 KISS 原则", 0.8, 1.0), ("使用 KISS 原则", "配置数据库连接", 0.0, 0.5), ("", "", 1.0, 1.0), ("", "a", 0.0, 0.0), ("a", "A!", 1.0, 1.0),
]


def test_best_similarity(spark):
    rows = spark.createDataFrame([(a, b) for a, b, _, _ in CASES], "a string, b string")
    got = [r[0] for r in rows.coalesce(1).select(S.best_similarity(F.col("a"), F.col("b"))).collect()]
    assert all(low <= x <= high for x, (_, _, low, high) in zip(got, CASES)), got


@pytest.mark.parametrize("name", ["edit", "phrase", "set", "bigram", "contained", "mixed", "best"])
def test_null_gives_null(spark, name):
    rows = spark.createDataFrame([("a b", None)], "a string, b string")
    assert rows.select(getattr(S, f"{name}_similarity")(F.col("a"), F.col("b"))).first()[0] is None
