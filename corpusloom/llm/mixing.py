"""Mixing sources to target weights by blocks.

The words of each source form one stream, cut into blocks of fixed length. Targets come from
weights by water filling. Each output shard draws multinomial counts of blocks per source; its
slots are numbered through per-source pseudorandom permutations of the block indexes, and the
blocks are then joined to the slots by index. No text is compared, sorted or collected.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from corpusloom.llm.session import forget, release, row_key
from corpusloom.llm.wordkernel import SPACE, pieces, row_of, runs, utf8
from corpusloom.sources.tables import materialize, table

WEIGHTS = (5.0, 2.0, 1.0)


@dataclass(frozen=True)
class Mix:
    """block: words in a block. repeats: most times that a word is taken. shards: output shards.
    buckets: parts that a source's stream is laid out in, so that no source is one task's work.
    """

    block: int = 128
    repeats: int = 3
    shards: int = 64
    buckets: int = 1024
    seed: int = 11


@F.arrow_udf(T.LongType())
def n_words(text: pa.Array) -> pa.Array:
    """Number of runs of bytes other than ASCII white space; null has none."""
    forget()
    data, offsets = utf8(text)
    out = [np.zeros(0, np.int64)]
    for i, j in pieces(offsets):
        at = offsets[i : j + 1] - offsets[i]
        starts, _ = runs(~SPACE[data[offsets[i] : offsets[j]]], at)
        out.append(np.bincount(row_of(starts, at), minlength=j - i))
    return pa.array(np.concatenate(out))


def targets(sizes: list[int], weights: list[float], repeats: int) -> list[float]:
    """Water filling: each source's share of sum(sizes) by weight, at most ``repeats`` times its size,
    the excess reshared by weight among the rest until none is above."""
    total, open_, out = float(sum(sizes)), set(range(len(sizes))), [0.0] * len(sizes)
    left = total
    while open_:
        unit = left / sum(weights[i] for i in open_)
        over = [i for i in open_ if weights[i] * unit > repeats * sizes[i]]
        if not over:
            for i in open_:
                out[i] = weights[i] * unit
            break
        for i in over:
            out[i] = float(repeats * sizes[i])
            left -= out[i]
            open_.remove(i)
    return out


def draw_counts(quota: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """(shards, sources) block counts. Each shard draws a multinomial over what is left of the
    quotas; draws beyond a quota go to the sources with most left, so the sums meet the quotas."""
    rng = np.random.Generator(np.random.PCG64(seed))
    left, out = quota.astype(np.int64).copy(), np.zeros((shards, len(quota)), np.int64)
    for k in range(shards):
        n = int(left.sum()) // (shards - k)
        if n == 0:
            continue
        got = rng.multinomial(n, left / left.sum())
        while (over := np.maximum(got - left, 0)).any():
            got -= over
            room = left - got
            got += rng.multinomial(int(over.sum()), room / room.sum())
        out[k] = got
        left -= got
    return out


def _feistel(k: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Element-wise pseudorandom permutation of range(n): a four-round Feistel net, walked until inside."""
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(n, 2))).astype(np.int64) + 1) // 2).astype(np.uint64)
    low = (np.uint64(1) << half) - np.uint64(1)
    x, todo, n = k.astype(np.uint64), np.arange(len(k)), n.astype(np.uint64)
    while len(todo):
        h, m, left, right = half[todo], low[todo], x[todo] >> half[todo], x[todo] & low[todo]
        for r in range(4):
            f = (right + key[todo] + np.uint64(r * 0x9E3779B1)) * np.uint64(0xD6E8FEB86659FD93)
            f ^= f >> np.uint64(32)
            f = (f * np.uint64(0xFF51AFD7ED558CCD)) >> np.uint64(17)
            left, right = right, left ^ (f & m)
        x[todo] = (left << h) | right
        todo = todo[x[todo] >= n[todo]]
    return x.astype(np.int64)


@F.arrow_udf(T.LongType())
def permuted(draw: pa.Array, n: pa.Array, source: pa.Array, seed: pa.Array) -> pa.Array:
    """Block index of a source's draw: each run of n draws is another permutation of its n blocks."""
    d, m, of, own = (x.to_numpy(zero_copy_only=False).astype(np.int64) for x in (draw, n, source, seed))
    with np.errstate(over="ignore"):
        key = (of.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ ((d // m).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (own.astype(np.uint64) << np.uint64(7))
        return pa.array(_feistel(d % m, m, key))


def lay_out(rows: DataFrame, how: Mix) -> DataFrame:
    """``rows`` (doc_id, source, size, _tie, and _all and _id if they have them, which break ties) with their place in their source's stream, _start.

    A source's rows are spread over ``how.buckets`` buckets by hash; the stream runs through the
    buckets in order. So the running sum needs one window per bucket and one over bucket sums.
    """
    rows = rows.withColumn("_bucket", F.pmod(row_key("doc_id", "_tie"), F.lit(how.buckets)).cast("int"))
    within = Window.partitionBy("source", "_bucket").orderBy("doc_id", "size", "_tie", *[c for c in ("_all", "_id") if c in rows.columns])
    sums = rows.groupBy("source", "_bucket").agg(F.sum("size").alias("_words"))
    before = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select(F.col("source").alias("_of"), F.col("_bucket").alias("_in"), F.coalesce(F.sum("_words").over(before), F.lit(0)).alias("_base"))
    rows = rows.withColumn("_upto", F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_nth", F.row_number().over(within))
    joined = rows.join(base, F.col("source").eqNullSafe(F.col("_of")) & (F.col("_bucket") == F.col("_in")))
    return joined.withColumn("_start", F.col("_base") + F.col("_upto") - F.col("size")).drop("_of", "_in", "_base", "_upto", "_tie")


def source_plan(sized: DataFrame, weights: tuple[float, ...], how: Mix) -> tuple[DataFrame, DataFrame]:
    """(sources with source_size, target, n_blocks; counts per output shard and source).

    Only per-source sums come to the driver: a catalogue, not data.
    """
    spark = sized.sparkSession
    sums = sized.groupBy("source").agg(F.sum("size").alias("n")).collect()
    known = sorted(sums, key=lambda r: (r["source"] is None, (r["source"] or "").encode()))
    sizes = [int(r["n"] or 0) for r in known]
    goal = targets(sizes, [weights[i % len(weights)] for i in range(len(known))], how.repeats)
    blocks = np.array([-(-n // how.block) for n in sizes], np.int64)
    quota = np.array([round(g / n * b) if n else 0 for g, n, b in zip(goal, sizes, blocks)], np.int64)
    counts = draw_counts(np.minimum(quota, how.repeats * blocks), how.shards, how.seed)
    first = np.cumsum(counts, 0) - counts
    at = [(r["source"], i, sizes[i], goal[i], int(blocks[i])) for i, r in enumerate(known)]
    sources = spark.createDataFrame(at, "source string, source_no int, source_size long, target double, n_blocks long")
    drawn = [(k, i, int(blocks[i]), int(first[k, i]), int(counts[k, i])) for k in range(how.shards) for i in range(len(known)) if counts[k, i]]
    return sources, spark.createDataFrame(drawn, "out_shard int, source_no int, n_blocks long, first_draw long, n_draws long")


def slots_of(counts: DataFrame, how: Mix) -> DataFrame:
    """One row per slot of the mix: out_shard, source_no, draw, block. ``counts`` has a row per output shard and source."""
    per = 4096
    total = counts.agg(F.sum("n_draws")).first()[0] or 0
    runs = counts.withColumn("_run", F.explode(F.sequence(F.lit(0), ((F.col("n_draws") - 1) / per).cast("long")))).repartition(max(8, -(-total // (8 * per))), "out_shard", "source_no", "_run")
    ends = F.least(F.col("n_draws"), (F.col("_run") + 1) * per) - 1
    draws = runs.withColumn("_k", F.explode(F.sequence(F.col("_run") * per, ends))).withColumn("draw", F.col("_k") + F.col("first_draw"))
    return draws.select("out_shard", "source_no", "draw", permuted("draw", "n_blocks", F.col("source_no").cast("long"), F.lit(how.seed)).alias("block"))


def cut(placed: DataFrame, sources: DataFrame, how: Mix) -> DataFrame:
    """One row per document and block that it reaches into: block, from and to (words of the document).

    A document without words has one row with a null block.
    """
    first, last = F.floor(F.col("_start") / how.block), F.floor((F.col("_start") + F.col("size") - 1) / how.block)
    numbered = placed.join(F.broadcast(sources), placed["source"].eqNullSafe(sources["source"])).drop(sources["source"])
    with_blocks = numbered.withColumn("block", F.explode_outer(F.when(F.col("size") > 0, F.sequence(first, last))))
    return with_blocks.withColumns({
        "from_word": F.greatest(F.lit(0), F.col("block") * how.block - F.col("_start")),
        "to_word": F.least(F.col("size"), (F.col("block") + 1) * how.block - F.col("_start")),
    })


def take(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, how: Mix = Mix()) -> DataFrame:
    """What the mix takes of each row of ``docs`` (doc_id, text, source).

    Returns doc_id, source, size, source_size, target and taken. A null text has size 0; rows that
    are equal stay separate rows; a null source is a source of its own, last. An empty table gives
    no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    slim = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), F.xxhash64("text").alias("_tie"))
    sized = materialize(slim, "mix-sizes")
    if sized.isEmpty():
        return spark.createDataFrame([], "doc_id long, source string, size long, source_size long, target double, taken long")
    sources, counts = source_plan(sized, weights, how)
    parts = cut(lay_out(sized, how), sources, how)
    drawn = slots_of(counts, how).groupBy("source_no", "block").agg(F.count("*").alias("times"))
    words = F.coalesce(F.col("times") * (F.col("to_word") - F.col("from_word")), F.lit(0))
    key = ["source_no", "_bucket", "_nth", "doc_id", "source", "size", "source_size", "target"]
    return parts.join(drawn.hint("shuffle_hash"), ["source_no", "block"], "left").groupBy(*key).agg(F.sum(words).alias("taken")).drop("source_no", "_bucket", "_nth")


@F.arrow_udf(T.ArrayType(T.StructType([T.StructField("block", T.LongType()), T.StructField("text", T.StringType())])))
def slices(text: pa.Array, start: pa.Array, size: pa.Array, block: pa.Array) -> pa.Array:
    """The document's text cut where its words cross block borders; white space stays with the word before."""
    forget()
    data, offsets = utf8(text)
    first, n, b = (x.to_numpy(zero_copy_only=False).astype(np.int64) for x in (start, size, block))
    blocks, ends, lists = [], [], [np.zeros(1, np.int64)]
    for i, j in pieces(offsets):
        at = offsets[i : j + 1] - offsets[i]
        words, _ = runs(~SPACE[data[offsets[i] : offsets[j]]], at)
        base = np.searchsorted(words, at)[:-1]  # each text's first word
        cuts = np.where(n[i:j] > 0, (first[i:j] + n[i:j] - 1) // b[i:j] - first[i:j] // b[i:j] + 1, 0)
        row = np.repeat(np.arange(j - i), cuts)
        k = np.arange(len(row)) - np.repeat(np.cumsum(cuts) - cuts, cuts)
        own = first[i:j][row] // b[i:j][row] + k
        last = k == cuts[row] - 1
        word = base[row] + np.minimum((own + 1) * b[i:j][row] - first[i:j][row], n[i:j][row])  # the first word of the next slice
        ends.append(offsets[i] + np.where(last, at[1:][row], words[np.minimum(word, max(0, len(words) - 1))] if len(words) else 0))
        blocks.append(own)
        lists.append(lists[-1][-1] + np.cumsum(cuts))
    ends = np.concatenate([np.zeros(0, np.int64), *ends])
    # texts without words have no slice, and a text's slices leave nothing out: one text begins where the one before ends
    begins = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
    at = np.concatenate(lists)
    heads = at[:-1][np.diff(at) > 0]
    begins[heads] = offsets[:-1][np.diff(at) > 0]
    raw = data.tobytes()
    release()
    cut_ = pa.array([raw[a:z].decode() for a, z in zip(begins.tolist(), ends.tolist())], pa.string())
    return pa.ListArray.from_arrays(at.astype(np.int32), pa.StructArray.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *blocks])), cut_], ["block", "text"]))


def mixed(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, how: Mix = Mix(), keep: tuple[str, ...] = (), slot: str = "slot") -> DataFrame:
    """The mix itself: one row per drawn block and document in it, with the columns ``keep`` of the document.

    Returns doc_id, source, text (the slice of the document that lies in the block), ``keep``, and a struct named
    ``slot`` of out_shard, draw, source_no and block; a block drawn k times gives its slices k times. Documents without
    words give no row. An empty table gives no rows. Columns other than doc_id, text, source and ``keep`` are ignored;
    a kept column may have any name but these three and ``slot``.

    The stream is laid out without texts; these are then joined once to their places and once to the slots.
    """
    spark, names = docs.sparkSession, [f"_keep_{k}" for k in range(len(keep))]
    rows = docs.select("doc_id", "source", "text", *[F.col(f"`{c}`").alias(n) for c, n in zip(keep, names)])
    rows = rows.withColumn("size", n_words("text")).where("size > 0").withColumns({"_tie": F.xxhash64("text"), "_all": F.xxhash64("text", *names), "_id": F.monotonically_increasing_id()})
    rows = materialize(rows, "mix-rows")  # so that a row has one number in all that follows
    slim = rows.select("doc_id", "source", "size", "_tie", "_all", "_id")
    sources, counts = source_plan(slim, weights, how)
    kept = [F.col(n).alias(c) for c, n in zip(keep, names)]
    if not sources.take(1):
        place = F.struct(*[F.lit(None).cast(t).alias(c) for c, t in (("out_shard", "int"), ("draw", "long"), ("source_no", "int"), ("block", "long"))])
        return rows.select("doc_id", "source", "text", *kept, place.alias(slot))
    placed = lay_out(slim, how).join(F.broadcast(sources.withColumnRenamed("source", "_of")), F.col("source").eqNullSafe(F.col("_of")))  # a row per source
    told = rows.drop("size", "_tie", "_all", "doc_id", "source").join(placed.select("_id", "doc_id", "source", "size", "_start", "source_no").hint("shuffle_hash"), "_id")
    parts = told.select("doc_id", "source", "source_no", *names, F.explode(slices("text", "_start", "size", F.lit(how.block))).alias("_p")).select("doc_id", "source", "source_no", *names, "_p.block", "_p.text")
    chosen = parts.join(slots_of(counts, how).hint("shuffle_hash"), ["source_no", "block"])
    return chosen.select("doc_id", "source", "text", *kept, F.struct("out_shard", "draw", "source_no", "block").alias(slot))


def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed by source with weights 5, 2, 1, repeating."""
    return take(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source")
