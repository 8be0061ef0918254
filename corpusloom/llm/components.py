"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.sources.tables import materialize

EDGE = "a long, b long"


def _contract(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replace the edges of one partition by an edge from each node to the least node it reaches there."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (p := up.get(top, top)) != top:
            top = p
        while x != top:
            up[x], x = top, up.get(x, x)
        return top

    for batch in parts:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            x, y = root(a), root(b)
            if x != y:
                up[max(x, y)] = min(x, y)
            up.setdefault(a, root(a))
            up.setdefault(b, root(b))
    nodes = [n for n in up if root(n) != n]
    for i in range(0, len(nodes), 50_000):
        some = nodes[i : i + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array([root(n) for n in some], pa.int64())], ["a", "b"])


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").union(edges.select("b", "a"))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): root is the least node it is connected with.

    Loops and repeated edges are allowed; an empty table gives no rows. Each round is written to the
    shared folder, so lineage stays short and a lost executor costs one round.
    """
    now = materialize(edges.where("a != b").mapInArrow(_contract, EDGE), "components")
    before = None
    for _ in range(rounds):
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == before or not state[0]:
            break
        before = state
        now = materialize(_small_star(_large_star(now)), "components")
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select("b", "b").distinct())
