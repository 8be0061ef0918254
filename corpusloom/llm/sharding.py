"""Sharding by fixed virtual slots.

Every record hashes into one of ``SLOTS`` virtual slots. Bytes and rows are summed per slot
(a table of fixed size), and a versioned slot-to-shard map sends slots to shards. Rebalancing
edits the map: it moves as few slots as bring the shards' bytes together and stores the result
as the next version, so records never need to be hashed anew.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.sources.tables import fresh_path, materialize, table

SLOTS = 8192


@dataclass(frozen=True)
class SlotMap:
    """A version of the map: ``shards[v]`` is the shard of virtual slot v."""

    version: int
    shards: tuple[int, ...]

    @staticmethod
    def initial(n_shards: int, slots: int = SLOTS) -> SlotMap:
        return SlotMap(0, tuple(v % n_shards for v in range(slots)))

    def store(self, spark: SparkSession, folder: str) -> None:
        """Write this version below ``folder``; earlier versions stay."""
        rows = [(self.version, v, s) for v, s in enumerate(self.shards)]
        spark.createDataFrame(rows, "version int, virtual_slot int, shard int").coalesce(1).write.mode("overwrite").parquet(f"{folder}/version={self.version}")

    @staticmethod
    def load(spark: SparkSession, folder: str, version: int) -> SlotMap:
        rows = spark.read.parquet(f"{folder}/version={version}").select("virtual_slot", "shard").collect()
        return SlotMap(version, tuple(s for _, s in sorted(map(tuple, rows))))


def rebalance(current: SlotMap, slot_bytes: dict[int, int], n_shards: int, tolerance: float = 1e-4) -> SlotMap:
    """The next version: slots move from the heaviest to the lightest shard while that narrows their gap.

    ``slot_bytes`` has one entry per non-empty slot. ``n_shards`` may exceed the current count;
    shards that are new start empty. Stops when the gap is within ``tolerance`` of the mean or no
    single slot's move narrows it.
    """
    shards = list(current.shards)
    load = [0] * n_shards
    held: list[list[tuple[int, int]]] = [[] for _ in range(n_shards)]
    for v, s in enumerate(shards):
        if size := slot_bytes.get(v, 0):
            load[s] += size
            insort(held[s], (size, v))
    mean = sum(load) / n_shards
    while True:
        heavy, light = max(range(n_shards), key=load.__getitem__), min(range(n_shards), key=load.__getitem__)
        gap = load[heavy] - load[light]
        if gap <= tolerance * mean:
            break
        at = bisect_right(held[heavy], (gap // 2, len(shards)))
        near = [held[heavy][k] for k in (at - 1, at) if 0 <= k < len(held[heavy]) and held[heavy][k][0] < gap]
        if not near:
            break
        size, v = min(near, key=lambda x: abs(2 * x[0] - gap))
        held[heavy].remove((size, v))
        insort(held[light], (size, v))
        load[heavy] -= size
        load[light] += size
        shards[v] = light
    return SlotMap(current.version + 1, tuple(shards))


def digest(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """doc_id, size (UTF-8 bytes plus 8), text_crc32 and virtual slot of each row, without the text.

    A null text counts as no bytes. Id and text decide the slot, so neither rows of one id nor copies of one text
    fill a slot; only rows alike in both do.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    spread = F.xxhash64("doc_id", text)
    return docs.select(
        "doc_id",
        (F.octet_length(text).cast("long") + 8).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.pmod(spread, F.lit(slots)).cast("int").alias("virtual_slot"),
    )


def assign(docs: DataFrame, n_shards: int, slots: int = SLOTS, folder: str | None = None) -> DataFrame:
    """Put all rows of ``docs`` (doc_id, text) into shards of near equal bytes.

    Returns doc_id, size, text_crc32, virtual_slot, map_version, shard and slot, the row's place
    in its shard: gapless from 0, by virtual slot, id, checksum. Map versions 0 and 1 are kept
    below ``folder``. Null texts have size 8, equal rows take neighbouring places, an empty table
    gives no rows, other columns are ignored.
    """
    spark = docs.sparkSession
    rows = materialize(digest(docs, slots), "shard-digest")
    # one row per virtual slot: a fixed number whatever the input
    sums = rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).collect()
    start = SlotMap.initial(n_shards, slots)
    final = rebalance(start, {r["virtual_slot"]: r["bytes"] for r in sums}, n_shards)
    folder = folder or fresh_path(spark, "slot-map")
    start.store(spark, folder)
    final.store(spark, folder)
    first, filled = {}, [0] * n_shards
    for r in sorted(sums):
        s = final.shards[r["virtual_slot"]]
        first[r["virtual_slot"]] = filled[s]
        filled[s] += r["rows"]
    places = spark.createDataFrame([(v, final.version, s, first.get(v, 0)) for v, s in enumerate(final.shards)], "virtual_slot int, map_version int, shard int, _first long")
    within = Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size")
    return (
        rows.withColumn("_rank", F.row_number().over(within))
        .join(F.broadcast(places), "virtual_slot")  # as many rows as there are virtual slots
        .withColumn("slot", F.col("_first") + F.col("_rank") - 1)
        .drop("_rank", "_first")
    )


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 23, near equal in bytes."""
    out = assign(table(spark, sf_dir, "documents").select("doc_id", "text"), 24)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "map_version")
