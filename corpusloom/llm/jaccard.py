"""N-gram Jaccard self-join of documents by vertical partitioning.

A document's set holds its distinct word n-grams as hashes. Documents with equal sets form a
class. N-grams are counted in parts of the hash range; those that more than one class has are put in one
global order, rarest first, and the order is cut into fragments where the frequency doubles. A class's
set is so cut into segments, one in a fragment. Only classes whose shared n-grams reach the threshold can
have a link. Pairs meet in the lists of their rarest n-grams (prefix filter); the fragments' partial
overlaps of a pair are counted apart and summed.

Only components are asked for, so the pairs of a group are not all formed. In two rounds each set of a
list meets the list's hub only; then sets of a list that are still in different components meet. Before a
pair becomes a row, a sketch must allow its link: 512 parity bits of the n-grams. Sets that differ in few
n-grams differ in few bits, so the number of unequal bits bounds the difference of the sets from below, and
no link is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.components import components
from corpusloom.llm.session import small
from corpusloom.llm.wordkernel import BYTE_CODE, LOWER, SPACE, chain, mix, pieces, runs, span_hash, utf8
from corpusloom.sources.tables import materialize, table


@dataclass(frozen=True)
class Join:
    """words: length of an n-gram. percent: links need 100 * intersection >= percent * union.
    part: n-grams that are counted in one group, about."""

    words: int = 5
    percent: int = 80
    part: int = 1 << 20



def shingle_sets(text: pa.Array, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, hashes, m+1 offsets) for runs of m rows: each row's distinct n-grams, ascending."""
    data, offsets = utf8(text)
    for i, j in pieces(offsets):
        low = LOWER[data[offsets[i] : offsets[j]]]
        at = offsets[i : j + 1] - offsets[i]
        starts, ends = runs(~SPACE[low], at)
        words = span_hash(BYTE_CODE[low], starts, ends)
        first = np.searchsorted(starts, at)
        n = np.diff(first)
        grams = chain(words, k)
        parts = []
        for a, m in zip(first[:-1].tolist(), n.tolist()):
            if m >= k:
                own = np.sort(grams[a : a + m - k + 1])
                parts.append(own[np.concatenate([[True], own[1:] != own[:-1]])])
            else:
                parts.append(chain(words[a : a + m], m) if m else words[:0])
        yield i, np.concatenate(parts) if parts else words[:0], np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)


def fingerprints(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A 64-bit fingerprint of each row's set: two sets of a corpus of m share one with probability m**2 / 2**65."""
    upto = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(mix(hashes ^ np.uint64(0x8CB92BA72F3D8DD7)), out=upto[1:])
    return mix(upto[offsets[1:]] - upto[offsets[:-1]] + np.diff(offsets).astype(np.uint64)).view(np.int64)


def signatures(docs: DataFrame, k: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_shingles, node (fingerprint of the set; null where it is empty), and the long columns ``keep``."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(parts):
            for i, hashes, at in shingle_sets(batch.column("text"), k):
                n = np.diff(at)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(i, len(n)), pa.array(n), pa.array(fingerprints(hashes, at), mask=n == 0), *(batch.column(c).slice(i, len(n)) for c in keep)],
                    ["doc_id", "n_shingles", "node", *keep],
                )

    return docs.select("doc_id", "text", *keep).mapInArrow(run, ", ".join(["doc_id long, n_shingles long, node long", *(f"{c} long" for c in keep)]))


def _bytes6(x: np.ndarray) -> bytes:
    """The low six bytes of each 64-bit number."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _from_bytes6(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def _edges(x: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin, and the end."""
    return np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1], [True]])) if len(x) else np.zeros(1, np.int64)


def _gaps(x: np.ndarray) -> bytes:
    """Ascending small numbers as differences of one byte each, of two where one does not hold them."""
    d = np.diff(x, prepend=0)
    return d.astype(np.uint8 if d.max(initial=0) < 256 else "<u2").tobytes()


def _from_gaps(data: bytes, n: int) -> np.ndarray:
    return np.cumsum(np.frombuffer(data, np.uint8 if len(data) == n else "<u2"), dtype=np.int64)


PART = "part int, run long, gaps binary, grams binary, nodes binary, sizes binary"
_PART = pa.schema([("part", pa.int32()), ("run", pa.int64()), *((c, pa.binary()) for c in ("gaps", "grams", "nodes", "sizes"))])


def parts_of_sets(docs: DataFrame, k: int, bits: int, run_of: int = 1 << 19) -> DataFrame:
    """Sets cut by hash into 2**bits parts: one row for each part and run of documents of about ``run_of`` n-grams.

    A run lists each distinct set once. A set is named by its place in the run; one more row of the run holds
    the sets' fingerprints and sizes. Of a hash, the ``bits`` of its part and 48 more are kept. A task that is
    run again must meet its documents in the same order, as a scan of files does.
    """
    cut = np.uint64(64 - bits)

    def flush(run: int, nodes: list, held: list) -> pa.RecordBatch:
        sizes = np.array([len(h) for h in held], "<u4")
        owner, hashes = np.repeat(np.arange(len(nodes)), sizes), np.concatenate(held)
        part = (hashes >> cut).astype(np.uint16)
        order = np.argsort(part, kind="stable")
        hashes, owner, part = hashes[order], owner[order], part[order]
        low = (hashes << np.uint64(bits)) >> np.uint64(16)
        edges = _edges(part)
        rows = [{"part": int(part[a]), "run": run, "gaps": _gaps(owner[a:b]), "grams": _bytes6(low[a:b])} for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())]
        rows.append({"part": run % (1 << bits), "run": run, "nodes": np.array(nodes, "<i8").tobytes(), "sizes": sizes.tobytes()})
        return pa.RecordBatch.from_pylist(rows, _PART)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        seen: set[int] = set()
        nodes, held, total = [], [], 0
        for batch in small(parts):
            for _, hashes, at in shingle_sets(batch.column("text"), k):
                names = fingerprints(hashes, at).tolist()
                for r, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist())):
                    if b > a and names[r] not in seen:
                        seen.add(names[r])
                        nodes.append(names[r])
                        held.append(hashes[a:b])
                        total += b - a
                    if total >= run_of or len(nodes) == 1 << 16:
                        yield flush(number, nodes, held)
                        number, seen, nodes, held, total = number + 1, set(), [], [], 0
        if nodes:
            yield flush(number, nodes, held)

    return docs.select("text").mapInArrow(run, PART)


#: Bits of an n-gram's number in its part; above them stands the logarithm of its frequency, 31 at most.
NUMBER = 27


def shared_grams(sets: DataFrame, bits: int) -> DataFrame:
    """Of each part the n-grams that several sets have, numbered by rising frequency, dealt back to the runs."""

    def run(t: pa.Table) -> pa.Table:
        told = t.filter(pc.is_valid(t.column("nodes")))
        t = t.filter(pc.is_null(t.column("nodes")))
        rows = told.to_pylist()
        if len(t):
            grams = [_from_bytes6(x.as_py()) for x in t.column("grams")]
            size = np.array([len(g) for g in grams])
            owner = np.concatenate([_from_gaps(x.as_py(), n) for x, n in zip(t.column("gaps"), size.tolist())])
            row, grams = np.repeat(np.arange(len(size)), size), np.concatenate(grams)
            order = np.argsort(grams, kind="stable")
            grams = grams[order]
            edge = np.ones(len(grams), bool)
            edge[1:] = grams[1:] != grams[:-1]
            many = ~edge
            many[:-1] |= many[1:]
            group, order = np.cumsum(edge[many]) - 1, order[many]
            df = np.bincount(group) if len(group) else np.zeros(0, np.int64)
            if len(df) > 1 << NUMBER:
                raise ValueError(f"{len(df)} shared n-grams in one part, more than {NUMBER} bits can number: deal them into more parts")
            rising = np.argsort(df, kind="stable")
            number = np.empty(len(df), np.int64)
            number[rising] = np.arange(len(df))
            number |= np.minimum(np.log2(np.maximum(df, 1)).astype(np.int64), 31) << NUMBER
            back = np.argsort(order, kind="stable")  # rows and owners in order again
            row, owner, ids = row[order][back], owner[order][back], number[group][back]
            edges, runs_, part = _edges(row), t.column("run").to_pylist(), t.column("part")[0].as_py()
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
                rows.append({"part": part, "run": runs_[row[a]], "gaps": _gaps(owner[a:b]), "grams": ids[a:b].astype("<u4").tobytes()})
        return pa.Table.from_pylist(rows, _PART)

    return sets.repartition(1 << bits, "part").groupBy("part").applyInArrow(run, PART)


SKETCH = 8  # words of 64 parity bits
_SET = ["node", "n", "alone", *(f"s{k}" for k in range(SKETCH))]
SETS = "node long, n long, alone long, " + ", ".join(f"s{k} long" for k in range(SKETCH)) + ", weight float, prefix array<long>, segments array<array<long>>"


def live_sets(shared: DataFrame, percent: int) -> DataFrame:
    """The sets that may have a link, see ``SETS``; a set comes once from each run that has it.

    An n-gram's number in the global order holds the logarithm of its frequency (which is its fragment) above its
    part and its number there. alone: n-grams that no other document has. prefix: the rarest shared n-grams; a linked
    set has one of them in its own prefix. s0 to s7: parity bits of the shared n-grams.
    """

    def run(t: pa.Table) -> pa.Table:
        told = t.filter(pc.is_valid(t.column("nodes")))
        t = t.filter(pc.is_null(t.column("nodes")))
        names, n = (np.frombuffer(told.column(c)[0].as_py(), kind) for c, kind in (("nodes", "<i8"), ("sizes", "<u4")))
        n = n.astype(np.int64)
        grams, owner = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for part, gaps, data in zip(*(t.column(c).to_pylist() for c in ("part", "gaps", "grams"))):
            ids = np.frombuffer(data, "<u4").astype(np.int64)
            grams.append(((ids >> NUMBER) << 48) | (part << 32) | (ids & ((1 << NUMBER) - 1)))
            owner.append(_from_gaps(gaps, len(ids)))
        grams, owner = np.concatenate(grams), np.concatenate(owner)
        held = np.bincount(owner, minlength=len(n))
        live = held * 100 >= n * percent
        keep = live[owner]
        owner, grams = (np.cumsum(live) - 1)[owner[keep]], grams[keep]
        order = np.lexsort((grams, owner))
        owner, grams = owner[order], grams[order]
        held, n, names = held[live], n[live], names[live]
        m = len(n)
        at = np.concatenate([[0], np.cumsum(held)])
        sketch = np.zeros((m, SKETCH), np.int64)
        for a in range(0, m, 4096):
            own = slice(at[a], at[min(m, a + 4096)])
            bit = (owner[own] - a) * 64 * SKETCH + (mix(grams[own].view(np.uint64)) & np.uint64(64 * SKETCH - 1)).astype(np.int64)
            odd = (np.bincount(bit, minlength=min(4096, m - a) * 64 * SKETCH) & 1).astype(np.uint8)
            sketch[a : a + 4096] = np.packbits(odd.reshape(-1, 64 * SKETCH), axis=1).view("<i8")
        level = grams >> 48
        weight = np.bincount(owner, 2.0**level, m) / np.maximum(n, 1)
        alone = n - held
        reach = n - -(-n * percent // 100) + 1 - alone
        fits = np.arange(len(grams)) - at[:-1][owner] < reach[owner]
        prefix = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(np.bincount(owner[fits], minlength=m))]).astype(np.int32), pa.array(grams[fits]))
        # segments: for each level up to a row's highest, the n-grams of that level
        wide = (level[at[1:] - 1] if m else np.zeros(0, np.int64)) + 1
        base = np.concatenate([[0], np.cumsum(wide)])
        inner = np.concatenate([[0], np.cumsum(np.bincount(base[:-1][owner] + level, minlength=base[-1]))]).astype(np.int32)
        segments = pa.ListArray.from_arrays(base.astype(np.int32), pa.ListArray.from_arrays(inner, pa.array(grams)))
        columns = [pa.array(names), pa.array(n), pa.array(alone), *(pa.array(np.ascontiguousarray(sketch[:, k])) for k in range(SKETCH)), pa.array(weight.astype(np.float32)), prefix, segments]
        return pa.Table.from_arrays(columns, [*_SET, "weight", "prefix", "segments"])

    return shared.groupBy("run").applyInArrow(run, SETS)


def _may_link(one: str, two: str, percent: int) -> Column:
    """Whether the sets of two structs can be as similar as asked, by their sizes and sketches; exact: it never denies a link.

    The sets differ at least in the n-grams that each has alone and in one n-gram for each unequal parity bit.
    """
    c = lambda side, name: F.col(f"{side}.{name}")
    unequal = sum((F.bit_count(c(one, f"s{k}").bitwiseXOR(c(two, f"s{k}"))) for k in range(1, SKETCH)), F.bit_count(c(one, "s0").bitwiseXOR(c(two, "s0"))))
    differ = F.greatest(unequal + c(one, "alone") + c(two, "alone"), F.abs(c(one, "n") - c(two, "n")))
    return differ * (100 + percent) <= (c(one, "n") + c(two, "n")) * (100 - percent)


def _sized(pairs: DataFrame) -> DataFrame:
    """Distinct (a, b, na, nb), a < b, of pairs of structs one and two."""
    size = lambda end: F.when(F.col("one.node") == F.col(end), F.col("one.n")).otherwise(F.col("two.n"))
    far = pairs.select(F.least("one.node", "two.node").alias("a"), F.greatest("one.node", "two.node").alias("b"), "one", "two")
    return far.select("a", "b", size("a").alias("na"), size("b").alias("nb")).distinct()


def _hubs(placed: DataFrame) -> DataFrame:
    """Of each list with sets of several components the hub, ``two``: the set whose n-grams are the most frequent."""
    ends = [F.min("one.root").alias("_lo"), F.max("one.root").alias("_hi")]
    return placed.groupBy("gram").agg(F.max("one").alias("two"), *ends).where("_lo < _hi").select("gram", "two")


def _hub_pairs(placed: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Each set of a list with the list's hub, a row for each list; equal pairs are merged before sketches are read."""
    met = placed.join(_hubs(placed), "gram").where("one.root != two.root").select(F.col("one.node").alias("a"), F.col("two.node").alias("b")).distinct()
    own = sets.select("node", F.struct(*_SET).alias("_own"))
    met = met.join(own.select(F.col("node").alias("a"), F.col("_own").alias("one")), "a").join(own.select(F.col("node").alias("b"), F.col("_own").alias("two")), "b")
    return _sized(met.where(_may_link("one", "two", percent)))


def _second_hub_pairs(placed: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """As ``_hub_pairs``, among the sets of a list that are not in its hub's component."""
    hubs = _hubs(placed).select("gram", F.col("two.root").alias("_root"))
    return _hub_pairs(placed.join(hubs, "gram").where("one.root != _root").select("gram", "one"), sets, percent)


def _cross_pairs(placed: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """All pairs of a list that lie in different components and may still link.

    At least one of such a pair lies outside the component of the list's hub.
    """
    hubs = _hubs(placed).select("gram", F.col("two.root").alias("_root"))
    rows = placed.join(hubs, "gram").select("gram", "one.node", "one.root", (F.col("one.root") != F.col("_root")).alias("out"))
    rows = rows.join(sets.select(*_SET), "node").select("gram", F.struct(*_SET, "root", "out").alias("one"))
    a, b = rows.where("one.out"), rows.select("gram", F.col("one").alias("two"))
    cross = (F.col("one.root") != F.col("two.root")) & (~F.col("two.out") | (F.col("one.node") < F.col("two.node")))
    return _sized(a.join(b, "gram").where(cross & _may_link("one", "two", percent)))


def overlaps(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b, na, nb) that link: partial overlaps of each fragment, summed per pair."""
    segments = sets.select("node", F.posexplode("segments").alias("frag", "grams")).where(F.size("grams") > 0)
    one = segments.select(F.col("node").alias("a"), "frag", F.col("grams").alias("_one"))
    two = segments.select(F.col("node").alias("b"), "frag", F.col("grams").alias("_two"))
    parts = pairs.join(one, "a").join(two, ["b", "frag"]).select("a", "b", "na", "nb", F.size(F.array_intersect("_one", "_two")).alias("_part"))
    total = parts.groupBy("a", "b", "na", "nb").agg(F.sum("_part").alias("both"))
    return total.where(F.col("both") * 100 >= (F.col("na") + F.col("nb") - F.col("both")) * percent)


def groups(docs: DataFrame, how: Join = Join(), keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_shingles and component_id of each row of ``docs`` (doc_id, text).

    ``component_id`` is the smallest id that links reach, the row's own included. Null and wordless texts have empty sets and link with
    nothing; with fewer words than an n-gram the whole sequence is one. Rows with a null id take part and
    get their component's id. Repeated rows stay rows; an empty table gives no rows; other columns are
    ignored.

    With ``keep``, long columns that together tell all rows apart, these are given too, and ``leads``: whether the
    row is its component's first by id (nulls last) and ``keep``, or its set is empty.
    """
    docs = docs.select("doc_id", "text", *keep)
    signed = materialize(signatures(docs, how.words, keep), "jaccard-signatures")
    place = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", *keep)
    first = [F.min(place).alias("first")] if keep else []
    classes = signed.where("node is not null").groupBy("node").agg(F.first("n_shingles").alias("n"), F.min("doc_id").alias("least"), *first)
    total = classes.agg(F.sum("n")).first()[0] or 0
    bits = min(16, max(4, int(np.ceil(np.log2(max(1, total) / how.part)))))
    shared = shared_grams(parts_of_sets(docs, how.words, bits), bits)
    sets = materialize(live_sets(shared, how.percent).dropDuplicates(["node"]), "jaccard-sets")

    parts = classes.select("node", F.col("node").alias("root")).limit(0)
    links = None
    for step in (_hub_pairs, _second_hub_pairs, _cross_pairs):  # the last is exact; the others leave it few components
        rooted = sets.join(parts, "node", "left").withColumn("root", F.coalesce("root", "node")) if links is not None else sets.withColumn("root", F.col("node"))
        placed = rooted.select(F.explode("prefix").alias("gram"), F.struct("weight", "node", "root").alias("one"))
        pairs = materialize(step(placed, sets, how.percent), "jaccard-pairs")
        new = materialize(overlaps(pairs, sets, how.percent).select("a", "b"), "jaccard-links")
        if not new.isEmpty():
            links = new if links is None else links.union(new)
            parts = components(links)
    member = classes.join(parts, "node", "left").withColumn("root", F.coalesce("root", "node"))
    ids = member.groupBy("root").agg(F.min("least").alias("component_id"), *([F.min("first").alias("_first")] if keep else []))
    named = materialize(member.join(ids, "root").select("node", "component_id", *(["_first"] if keep else [])), "jaccard-classes")
    out = signed.join(named, "node", "left")
    leads = [*keep, (F.col("node").isNull() | place.eqNullSafe(F.col("_first"))).alias("leads")] if keep else []
    return out.select("doc_id", "n_shingles", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), *leads)


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's number of 5-word shingles and its component of links of 0.8 and more."""
    return groups(table(spark, sf_dir, "documents"))


ORACLE = r"""
with recursive told as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents
), sets as (
  select doc_id, case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')] else list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) end as s from told
), shingles as (select doc_id, unnest(s) as shingle from sets
), sizes as (select doc_id, len(s)::bigint as n_shingles from sets
), met as (
  select a.doc_id as a, b.doc_id as b, count(*) as n from shingles a join shingles b on a.shingle = b.shingle and a.doc_id < b.doc_id group by all
), links as (
  select o.a, o.b from met o join sizes x on x.doc_id = o.a join sizes y on y.doc_id = o.b where 100 * n >= 80 * (x.n_shingles + y.n_shingles - n)
), both_ways as (select a, b from links union select b, a from links
), reach as (select a as doc_id, b as other from both_ways union select r.doc_id, e.b from reach r join both_ways e on r.other = e.a
), least_of as (select doc_id, min(other) as m from reach group by doc_id
)
select doc_id, n_shingles, least(doc_id, coalesce(m, doc_id)) as component_id from sizes left join least_of using (doc_id)
"""
