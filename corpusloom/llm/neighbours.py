"""Approximate nearest neighbours: an inverted file of coarse centroids with product-quantised residuals.

Rows with equal vectors are one entry of the index, so copies take one place among the candidates.
Centroids and residual codebooks are fitted on a bounded sample of distinct vectors; each is indexed by its
nearest centroid and the codes of its residual. Queries come in blocks: each block meets the lists
that its queries probe, scores their codes through asymmetric distance tables, and keeps the best
``rerank`` vectors of each query, which are then scored exactly on the originals and give way to the rows
that hold them.

What the index found sets each query's floor, the score of its k-th row. An exact check follows: a list is ruled out where the
inner product with its centroid and the reach of its members can't come up to the floor; all vectors of the others are
multiplied with the queries, and those that come up to it join the result. So no row is missed, whatever the vectors;
queries for which the index found too few rows have no floor.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.sources.tables import materialize, table


@dataclass(frozen=True)
class IvfPq:
    """sample: vectors to fit on. lists, most_lists: centroids are ``lists`` times the root of the number of distinct
    vectors, at most ``most_lists`` (four vectors of the sample each). probed: share of lists that a query visits. codes: subspaces. rerank: distinct vectors scored exactly.
    query_block, list_block: rows that one task holds of a block of queries and of a list. cells: components of vectors, and of
    queries, that one task of the exact check holds."""

    sample: int = 16384
    lists: float = 3.0
    most_lists: int = 4096
    probed: float = 0.6
    codes: int = 16
    rerank: int = 256
    query_block: int = 64
    list_block: int = 2048
    blocks_a_task: int = 64
    cells: int = 1 << 20
    rounds: int = 8
    seed: int = 5


def usable(vector: Column) -> Column:
    """Not null, not empty, not zero, all components present and finite."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & good & F.exists(vector, lambda x: x != 0), F.lit(False))


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Index of the nearest centre by Euclidean distance."""
    out, half = np.empty(len(x), np.int64), 0.5 * (centres * centres).sum(1)
    for i in range(0, len(x), 4096):
        out[i : i + 4096] = (x[i : i + 4096] @ centres.T - half).argmax(1)
    return out


def _kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    centres = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        near = _nearest(x, centres)
        n = np.bincount(near, minlength=len(centres))
        sums = np.stack([np.bincount(near, x[:, d], len(centres)) for d in range(x.shape[1])], 1)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres).astype(np.float32)
    return centres


@dataclass(frozen=True)
class Model:
    """``centres`` have one dimension more than the vectors, see ``lifted``."""

    reach: float
    centres: np.ndarray
    books: tuple[np.ndarray, ...]
    cuts: tuple[tuple[int, int], ...]

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(list, codes) of each vector."""
        lists = _nearest(lifted(x, self.reach), self.centres)
        rest = x - self.centres[lists, :-1]
        return lists, np.stack([_nearest(rest[:, a:b], book) for (a, b), book in zip(self.cuts, self.books)], 1).astype(np.uint8)

    def probes(self, q: np.ndarray, share: float) -> np.ndarray:
        """The lists whose centroids are nearest to each query, in the space in which vectors were put into lists."""
        n = max(1, int(np.ceil(share * len(self.centres))))
        full = q * (self.reach / np.maximum(np.linalg.norm(q, axis=1), 1e-30))[:, None]
        return np.argsort(0.5 * (self.centres**2).sum(1) - full @ self.centres[:, :-1].T, 1, kind="stable")[:, :n]

    def coarse(self, q: np.ndarray) -> np.ndarray:
        """Inner products of queries and centroids."""
        return q @ self.centres[:, :-1].T

    def tables(self, q: np.ndarray) -> list[np.ndarray]:
        """Asymmetric tables: inner product of each query's part with each code's centre."""
        return [q[:, a:b] @ book.T for (a, b), book in zip(self.cuts, self.books)]


def lifted(x: np.ndarray, reach: float) -> np.ndarray:
    """Vectors with a component more that brings each to the length ``reach``: among vectors of one length the nearest to a
    query (whose own is 0 there) has the largest inner product. Longer vectors, which the sample did not have, get 0."""
    return np.concatenate([x, np.sqrt(np.maximum(0, reach**2 - (x.astype(np.float64) ** 2).sum(1)))[:, None]], 1).astype(np.float32)


def fit(x: np.ndarray, n_lists: int, how: IvfPq) -> Model:
    rng = np.random.Generator(np.random.PCG64(how.seed))
    reach = float(np.linalg.norm(x.astype(np.float64), axis=1).max())
    up = lifted(x, reach)
    centres = _kmeans(up, min(n_lists, len(x)), how.rounds, rng)
    rest = x - centres[_nearest(up, centres), :-1]
    edges = np.linspace(0, x.shape[1], min(how.codes, x.shape[1]) + 1).astype(int)
    cuts = tuple((int(a), int(b)) for a, b in zip(edges, edges[1:]))
    books = tuple(_kmeans(np.ascontiguousarray(rest[:, a:b]), min(256, len(x)), how.rounds, rng) for a, b in cuts)
    return Model(reach, centres, books, cuts)


def matrix(column: pa.ChunkedArray | pa.Array, d: int) -> np.ndarray:
    """Fixed-length list column as a matrix of doubles."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)


def shrunk(x: np.ndarray, power: int | np.ndarray) -> np.ndarray:
    """Vectors divided by a power of two, as the index keeps them: exact but for what falls below 32-bit floats."""
    return np.ldexp(x, -power).astype(np.float32)


def products(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products row by row. Where doubles can't hold the parts of one, it is worked out on shrunk vectors, so it is never undefined."""
    with np.errstate(over="ignore", invalid="ignore"):
        out = (x * q).sum(1)
        far = np.flatnonzero(~np.isfinite(out))
        if len(far):
            a, b = (np.frexp(np.abs(v[far]).max(1))[1] for v in (x, q))
            out[far] = np.ldexp((np.ldexp(x[far], -a[:, None]) * np.ldexp(q[far], -b[:, None])).sum(1), a + b)
    return out


def asked_shrunk(q: np.ndarray) -> np.ndarray:
    """Queries, each divided by its own power of two: that changes no order of its candidates."""
    return shrunk(q, np.frexp(np.abs(q).max(1))[1][:, None]) if len(q) else q.astype(np.float32)


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Column indexes of a row's k largest scores, ties to smaller ids, in that order."""
    if len(scores) > 4 * k:
        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores >= edge)
    else:
        some = np.arange(len(scores))
    return some[np.lexsort((ids[some], -scores[some]))[:k]]


#: More than what falls below the doubles in a sum of products of vectors whose components are below 1.
FAINT = 1e-290
MOST = np.finfo(float).max


def lost(d: int) -> float:
    """More than what falls below the doubles in a sum of ``d`` products."""
    return d * 2.0**-1073


def lowered(floor: np.ndarray, power: np.ndarray, d: int) -> np.ndarray:
    """The least scores that count, divided by powers of two. Scores beyond the doubles are infinite, so the largest double may be one."""
    with np.errstate(over="ignore", under="ignore"):
        return np.ldexp(np.minimum(floor, MOST) - lost(d), -power)


def within_reach(q: np.ndarray, floor: np.ndarray, centres: np.ndarray, apart: np.ndarray, power: int) -> np.ndarray:
    """Lists in which a vector may come up to the floor of one of the queries. ``apart``: how far the members of each list are
    from its centroid at most, in the units of the centroids; a power of two leads there from the vectors' own."""
    own = np.frexp(np.abs(q).max(1))[1]
    q, low, seen = np.ldexp(q, -own[:, None]), lowered(floor, own + power, q.shape[1]), np.zeros(len(centres), bool)
    wide, length = apart * (1 + 1e-9) + 1e-9 * np.linalg.norm(centres, axis=1), np.linalg.norm(q, axis=1)
    for i in range(0, len(q), 512):
        most = q[i : i + 512] @ centres.T + length[i : i + 512, None] * wide + FAINT
        seen |= (most >= low[i : i + 512, None]).any(0)
    return np.flatnonzero(seen)


def up_to_floor(x: np.ndarray, least: np.ndarray, alone: np.ndarray, q: np.ndarray, names: np.ndarray, floor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, vector, score) of all pairs whose score is the query's floor or more, but for vectors that ``k`` others precede by
    score and least id. Nothing that no row but the query's own has is paired with it.

    Products of matrices choose the pairs with room for their rounding; ``products`` decides.
    """
    common, own = int(np.frexp(np.abs(x).max())[1]), np.frexp(np.abs(q).max(1))[1]
    near, asked, low = np.ldexp(x, -common), np.ldexp(q, -own[:, None]), lowered(floor, own + common, q.shape[1])
    with np.errstate(over="ignore", under="ignore"):
        # scores this near are level in doubles, and so are all from the top on
        level, top = np.ldexp(2 * lost(q.shape[1]), -own - common), np.ldexp(MOST / 2, -own - common)
    slack = 4 * x.shape[1] * np.finfo(float).eps * np.abs(near).sum(1) + FAINT
    order = np.argsort(names)
    at = np.minimum(np.searchsorted(names[order], least), len(names) - 1)
    only = np.flatnonzero((names[order][at] == least) & alone)
    whose = order[at[only]]
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    step = max(1, (1 << 22) // len(x))
    for i in range(0, len(q), step):
        most = asked[i : i + step] @ near.T + slack
        mine = (whose >= i) & (whose < i + step)
        most[whose[mine] - i, only[mine]] = -np.inf
        may = (most >= low[i : i + step, None]) & (most > -np.inf)
        for j in np.flatnonzero(may.any(1)):
            some = np.flatnonzero(may[j])
            if len(some) > k:
                high, sure = most[j, some], most[j, some] - 2 * slack[some]
                some = some[high >= min(np.partition(sure, len(some) - k)[len(some) - k] - level[i + j], top[i + j])]
            score = products(x[some], np.broadcast_to(q[i + j], (len(some), q.shape[1])))
            some, score = some[score >= floor[i + j]], score[score >= floor[i + j]]
            other = np.flatnonzero(least[some] != names[i + j])
            # of a vector whose least id is the query's the next is not known here, so it stays
            kept = np.concatenate([other[best(score[other], least[some[other]], k)], np.flatnonzero(least[some] == names[i + j])])
            out.append((np.full(len(kept), i + j), some[kept], score[kept]))
    return tuple(np.concatenate(part) for part in zip(*out))


#: Parts in which the ids of one vector are sorted before they are put together.
ID_PARTS = 32


def _keyed(rows: DataFrame) -> DataFrame:
    """With two 64-bit hashes of the vector, key and check."""
    return rows.withColumns({"key": F.xxhash64("embedding"), "check": F.xxhash64(F.lit(1), "embedding")})


def least_ids(rows: DataFrame, k: int) -> DataFrame:
    """key, check, ids of each distinct vector: its ``k`` + 1 least ids and how many rows, up to ``k``, have each.

    So ``k`` rows are left whichever id is taken out.
    """
    counted = _keyed(rows).groupBy("key", "check", "vec_id").agg(F.least(F.count("*"), F.lit(k)).cast("int").alias("n"))
    counted = counted.withColumn("_part", F.pmod(F.xxhash64("vec_id"), F.lit(ID_PARTS)))
    within = Window.partitionBy("key", "check", "_part").orderBy("vec_id")
    some = counted.withColumn("_place", F.row_number().over(within)).where(F.col("_place") <= k + 1)
    # at most ID_PARTS x (k + 1) ids a vector
    return some.groupBy("key", "check").agg(F.slice(F.array_sort(F.collect_list(F.struct("vec_id", "n"))), 1, k + 1).alias("ids"))


def search(vectors: DataFrame, every: int, k: int, how: IvfPq = IvfPq()) -> DataFrame:
    """The ``k`` nearest rows, by inner product, of each row of ``vectors`` (vec_id, embedding) whose
    id is divisible by ``every``: query_id, rank from 1, vec_id, score.

    Vectors that are null, empty or zero, or that hold a null or a component that is not finite, take
    no part, nor do rows with a null id. Queries meet vectors of their own length; the index holds the length of most of the sample,
    others are compared exactly at once. A row is no candidate
    of a query with its id; an id that is listed twice as a query is searched once, with its least
    vector (of the index's length, if it has one); equal scores go by smaller id. Nothing usable gives no rows. Other columns are ignored.
    Components may have any finite size; a score beyond the doubles is infinite.
    """
    spark = vectors.sparkSession
    shape = "query_id long, rank int, vec_id long, score double"
    own = vectors.schema["embedding"].dataType.simpleString()
    vector = F.col("embedding") if own == "array<float>" else F.col("embedding").cast("array<double>")
    rows = vectors.select("vec_id", vector.alias("embedding")).where(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    once = rows.groupBy("embedding").agg(F.min("vec_id").alias("least"), F.max("vec_id").alias("_most"))
    # alone: no other id has the vector
    once = materialize(_keyed(once).select("key", "check", "least", (F.col("least") == F.col("_most")).alias("alone"), "embedding"), "ann-vectors")
    drawn = once.select("least", "key", "embedding").orderBy(F.xxhash64("least"), "least", "key").limit(how.sample).select("embedding").toArrow()
    if not drawn.num_rows:
        return spark.createDataFrame([], shape)
    drawn = drawn.column("embedding").to_pylist()
    d = int(np.bincount([len(v) for v in drawn]).argmax())
    every_length, once = once, once.where(F.size("embedding") == d)
    fits = F.size("embedding") == d
    n_all, total, largest = every_length.agg(F.count("*"), F.count_if(fits), F.max(F.when(fits, F.array_max(F.transform("embedding", F.abs))))).first()
    # the largest component of the index's vectors gets below 1, so no product in it leaves the range of its floats
    power = int(np.frexp(largest)[1])
    sample = shrunk(np.array([v for v in drawn if len(v) == d], np.float64), power)
    model = fit(sample, min(how.most_lists, max(1, -(-len(sample) // 4)), max(1, int(how.lists * total**0.5))), how)
    kept = spark.sparkContext.broadcast(model)  # at most most_lists centroids and codes x 256 centres

    def assign(parts):
        for b in parts:
            x = matrix(b.column("embedding"), d)
            lists, codes = kept.value.encode(shrunk(x, power))
            apart = np.linalg.norm(np.ldexp(x, -power) - kept.value.centres[lists, :-1], axis=1)
            yield pa.RecordBatch.from_pydict({"list": pa.array(lists.astype(np.int32)), "apart": pa.array(apart), "code": pa.array([c.tobytes() for c in codes], pa.binary()), **{c: b.column(c) for c in held}})

    held = ("key", "check", "least", "alone", "embedding")
    kind = once.schema["embedding"].dataType.simpleString()
    coded = materialize(once.select(*held).mapInArrow(assign, f"list int, apart double, code binary, key long, check long, least long, alone boolean, embedding {kind}"), "ann-codes")
    # long lists are cut into blocks by hash, so no list is one task's work
    sizes = coded.groupBy("list").agg(F.ceil(F.count("*") / how.list_block).alias("_blocks"), F.max("apart").alias("_apart"))  # one row per centroid
    apart, n_blocks = np.zeros(len(model.centres)), 0
    for no, n, far in sizes.collect():
        apart[no], n_blocks = far, n_blocks + n
    placed = coded.join(F.broadcast(sizes), "list").withColumn("block", F.pmod(F.xxhash64("key"), F.col("_blocks")).cast("int"))

    def pack(t: pa.Table) -> pa.Table:
        packed = {"keys": t.column("key").to_numpy().astype("<i8").tobytes(), "least": t.column("least").to_numpy().astype("<i8").tobytes(), "alone": t.column("alone").to_numpy().astype(bool).tobytes(), "codes": b"".join(t.column("code").to_pylist())}
        return pa.table({"list": t.column("list")[:1], "block": t.column("block")[:1], **{name: pa.array([data], pa.binary()) for name, data in packed.items()}})

    blocks = placed.select("list", "block", "key", "least", "alone", "code").groupBy("list", "block").applyInArrow(pack, "list int, block int, keys binary, least binary, alone binary, codes binary")
    ids = materialize(least_ids(rows, k), "ann-ids")

    def nearest(asked: DataFrame, share: float) -> DataFrame:
        """query_id, key, check, score: the nearest vectors of the queries ``asked`` (query_id, embedding) in this share of the lists."""
        n_queries = max(1, asked.count())
        groups = -(-n_queries // how.query_block)
        asked = materialize(asked.withColumn("qblock", F.pmod(F.xxhash64("query_id"), F.lit(groups)).cast("int")), "ann-queries")
        salts = max(1, -(-int(share * n_blocks) // how.blocks_a_task))

        def visit(t: pa.Table) -> pa.Table:
            q = asked_shrunk(matrix(t.column("embedding"), d))
            lists = np.unique(kept.value.probes(q, share))
            return pa.table({"qblock": pa.array(np.full(len(lists), t.column("qblock")[0].as_py(), np.int32)), "list": pa.array(lists.astype(np.int32))})

        visits = asked.groupBy("qblock").applyInArrow(visit, "qblock int, list int")
        meets = visits.join(blocks, "list").withColumn("salt", F.pmod(F.xxhash64("list", "block"), F.lit(salts)).cast("int"))
        salted = asked.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))

        def scan(left: pa.Table, right: pa.Table) -> pa.Table:
            m, parts = kept.value, []
            q, names = asked_shrunk(matrix(right.column("embedding"), d)), right.column("query_id").to_numpy()
            wanted = np.zeros((len(q), len(m.centres)), bool)
            if len(q):
                wanted[np.arange(len(q))[:, None], m.probes(q, share)] = True
            tables, coarse = m.tables(q), m.coarse(q)
            for no, keys, least, alone, codes in zip(*(left.column(c).to_pylist() for c in ("list", "keys", "least", "alone", "codes"))):
                who = np.flatnonzero(wanted[:, no])
                if not len(who):
                    continue
                code = np.frombuffer(codes, np.uint8).reshape(-1, len(m.cuts))
                score = np.repeat(coarse[who, no][:, None], len(code), 1)
                for j, t in enumerate(tables):
                    score += t[who][:, code[:, j]]
                score[(np.frombuffer(least, "<i8") == names[who][:, None]) & np.frombuffer(alone, bool)] = -np.inf
                parts.append((who, np.frombuffer(keys, "<i8"), score))
            out_q, out_keys, out_scores = [], [], []
            for i in range(len(q)):
                own = [(keys, score[np.searchsorted(who, i)]) for who, keys, score in parts if who[min(len(who) - 1, np.searchsorted(who, i))] == i]
                if own:
                    keys, score = np.concatenate([x[0] for x in own]), np.concatenate([x[1] for x in own])
                    keys, score = keys[score > -np.inf], score[score > -np.inf]
                    top = best(score, keys, how.rerank)
                    out_q.append(int(names[i]))
                    out_keys.append(keys[top])
                    out_scores.append(score[top])
            near = pa.ListArray.from_arrays(
                np.concatenate([[0], np.cumsum([len(x) for x in out_keys])]).astype(np.int32),
                pa.StructArray.from_arrays([pa.array(-np.concatenate(out_scores, dtype=np.float32) if out_scores else np.zeros(0, np.float32)), pa.array(np.concatenate(out_keys, dtype=np.int64) if out_keys else np.zeros(0, np.int64))], ["far", "key"]),
            )
            return pa.table({"query_id": pa.array(out_q, pa.int64()), "near": near})

        found = meets.groupBy("qblock", "salt").cogroup(salted.groupBy("qblock", "salt")).applyInArrow(scan, "query_id long, near array<struct<far: float, key: long>>")
        # at most salts x rerank candidates a query
        kept_of = found.groupBy("query_id").agg(F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, how.rerank).alias("near"))
        wanted = kept_of.select("query_id", F.explode(F.array_distinct(F.transform("near", lambda x: x["key"]))).alias("key"))
        originals = wanted.join(coded.select("key", "check", "embedding"), "key").withColumn("qblock", F.pmod(F.xxhash64("query_id"), F.lit(groups)).cast("int"))

        def rerank(left: pa.Table, right: pa.Table) -> pa.Table:
            names = right.column("query_id").to_numpy()
            order = np.argsort(names)
            q = matrix(right.column("embedding"), d)[order]
            own = np.searchsorted(names[order], left.column("query_id").to_numpy())
            score = products(matrix(left.column("embedding"), d), q[own])
            out = [np.zeros(0, np.int64)]
            for i in range(len(q)):
                mine = np.flatnonzero(own == i)
                # all vectors level with the k-th stay: their rows' ids decide
                out.append(mine if len(mine) <= k else mine[score[mine] >= np.partition(score[mine], len(mine) - k)[len(mine) - k]])
            top = np.concatenate(out)
            return pa.table({"query_id": pa.array(names[order][own[top]]), "key": left.column("key").take(pa.array(top)), "check": left.column("check").take(pa.array(top)), "score": pa.array(score[top])})

        return originals.select("qblock", "query_id", "key", "check", "embedding").groupBy("qblock").cogroup(asked.groupBy("qblock")).applyInArrow(rerank, "query_id long, key long, check long, score double")

    def ranked(top: DataFrame) -> DataFrame:
        # at most k + 1 ids a vector
        each = top.join(ids, ["key", "check"]).select("query_id", "score", F.inline("ids")).where("vec_id != query_id")
        each = each.select("query_id", "score", "vec_id", F.explode(F.array_repeat("vec_id", F.col("n"))).alias("_copy"))
        place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        return each.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    def above(asked: DataFrame) -> DataFrame:
        """query_id, key, check, score: the vectors that come up to the floors of the queries ``asked`` (query_id, embedding, floor)."""

        def home(parts):
            for b in parts:
                if not len(b):
                    continue
                own = kept.value.probes(asked_shrunk(matrix(b.column("embedding"), d)), 0)[:, 0]
                yield pa.RecordBatch.from_pydict({**{c: b.column(c) for c in b.schema.names}, "list": pa.array(own.astype(np.int32))})

        main = asked.where(F.size("embedding") == d).select("query_id", "embedding", "floor")
        main = materialize(main.mapInArrow(home, f"query_id long, embedding {kind}, floor double, list int"), "ann-homes")
        # queries of one list share blocks, so that each block rules out what is far from it
        room, start, blocks_of = max(1, how.cells // d), 0, []
        for no, n in sorted(main.groupBy("list").count().collect()):  # one row per centroid
            blocks_of.append((no, start // room, -(-n // room)))
            start += n
        dealt = F.broadcast(spark.createDataFrame(blocks_of, "list int, first int, parts int"))
        main = main.join(dealt, "list").withColumn("qblock", F.col("first") + F.pmod(F.xxhash64("query_id"), F.col("parts")).cast("int"))

        def visit(t: pa.Table) -> pa.Table:
            lists = within_reach(matrix(t.column("embedding"), d), t.column("floor").to_numpy(), kept.value.centres[:, :-1].astype(np.float64), apart, power)
            return pa.table({"qblock": pa.array(np.full(len(lists), t.column("qblock")[0].as_py(), np.int32)), "list": pa.array(lists.astype(np.int32))})

        meets = main.select("qblock", "embedding", "floor").groupBy("qblock").applyInArrow(visit, "qblock int, list int").groupBy("list").agg(F.collect_list("qblock").alias("qblocks"))
        salts = max(-(-total * d // how.cells), min(spark.sparkContext.defaultParallelism, -(-total // 4096)))
        spread = F.pmod(F.xxhash64("key"), F.lit(salts)).cast("int").alias("salt")
        left = coded.join(F.broadcast(meets), "list").select(F.lit(d).alias("size"), F.explode("qblocks").alias("qblock"), spread, *held)
        right = main.select(F.lit(d).alias("size"), "qblock", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), "query_id", "embedding", "floor")
        if n_all > total:
            size = F.size("embedding").alias("size")
            short = lambda n: F.greatest(F.lit(1), F.ceil(F.col(n) * F.col("size") / how.cells)).cast("int")
            others, queries = (t.where(F.size("embedding") != d).withColumn("size", size) for t in (every_length, asked))
            parts = others.groupBy("size").agg(F.count("*").alias("n")).join(queries.groupBy("size").agg(F.count("*").alias("m")), "size")
            parts = F.broadcast(parts.select("size", short("n").alias("salts"), short("m").alias("groups")))  # one row per length
            left = left.union(others.join(parts, "size").select("size", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("qblock"), F.pmod(F.xxhash64("key"), F.col("salts")).cast("int").alias("salt"), *held))
            right = right.union(queries.join(parts, "size").select("size", F.pmod(F.xxhash64("query_id"), F.col("groups")).cast("int").alias("qblock"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), "query_id", "embedding", "floor"))

        def compare(left: pa.Table, right: pa.Table) -> pa.Table:
            names, keys, checks = (t.column(c).to_numpy() for t, c in ((right, "query_id"), (left, "key"), (left, "check")))
            if not len(names) or not len(keys):
                return pa.table({"query_id": names[:0], "key": keys[:0], "check": checks[:0], "score": np.zeros(0)})
            size = right.column("size")[0].as_py()
            who, what, score = up_to_floor(matrix(left.column("embedding"), size), left.column("least").to_numpy(), left.column("alone").to_numpy(), matrix(right.column("embedding"), size), names, right.column("floor").to_numpy(), k)
            return pa.table({"query_id": names[who], "key": keys[what], "check": checks[what], "score": score})

        by = ("size", "qblock", "salt")
        return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(compare, "query_id long, key long, check long, score double")

    asked = rows.where(F.col("vec_id") % every == 0).groupBy(F.col("vec_id").alias("query_id")).agg(F.min(F.struct((F.size("embedding") != d).alias("other"), "embedding")).alias("_one"))
    asked = materialize(asked.select("query_id", "_one.embedding"), "ann-asked")
    found = materialize(nearest(asked.where(F.size("embedding") == d), how.probed), "ann-nearest")
    floors = ranked(found).where(F.col("rank") == k).select("query_id", F.col("score").alias("floor"))
    asked = asked.join(floors, "query_id", "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf"))))
    missed = materialize(above(asked), "ann-missed")
    return ranked(found.union(missed).groupBy("query_id", "key", "check").agg(F.max("score").alias("score")))


def op6_ann_ivfpq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """20 nearest rows of every embedding whose id is divisible by 20."""
    return search(table(spark, sf_dir, "embeddings"), 20, 20)
