"""Best-fit packing against a document-by-document version, and its tokens against the tokenizers library."""

import random
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
import public_tokenizers
from tokenizers import Tokenizer

from corpusloom.llm import packing

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("byte_bpe_50k.json")


def one_by_one(lengths, most):
    """Rooms of all sequences after best-fit decreasing, each piece by a scan of all open sequences."""
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [(r, k) for k, r in enumerate(rooms) if r >= n]
        if fits:
            rooms[min(fits)[1]] -= n
        else:
            rooms.append(most - n)
    return rooms


def checked(rows, most):
    """Whether the pieces fill their sequences without gaps or overlaps."""
    for _, g in rows.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == [0, *np.cumsum(g.length)[:-1]] and g.length.sum() <= most


def test_tree_finds_the_least_open_capacity():
    rng, tree, held = random.Random(3), packing.CapacityTree(50), set()
    for _ in range(4000):
        room = rng.randint(1, 50)
        tree.mark(room, rng.random() < 0.4)
        held = held | {room} if tree.open[room + tree.width] else held - {room}
        n = rng.randint(1, 50)
        assert tree.tightest(n) == min((r for r in held if r >= n), default=-1)


@pytest.mark.parametrize("seed", range(12))
def test_plan_packs_as_one_by_one(seed):
    rng, most = random.Random(seed), 64
    lengths = [min(most, int(rng.paretovariate(0.4 + seed / 8))) for _ in range(rng.randint(1, 900))]
    plan, seen, left = packing.best_fit(Counter(lengths), most), Counter(), {}
    for n in lengths:
        s, at = (int(x[0]) for x in plan.place(np.array([n]), np.array([seen[n]])))
        seen[n] += 1
        left.setdefault(s, []).append((at, n))
    want = one_by_one(lengths, most)
    assert sorted(most - sum(n for _, n in x) for x in left.values()) == sorted(want) and plan.sequences == len(want)
    assert all(at == sum(n for _, n in sorted(x)[:k]) for x in left.values() for k, (at, _) in enumerate(sorted(x)))
    assert len(plan.key) <= 1.5 * most**2


def test_only_a_first_piece_is_short():
    doc, piece, start, length = packing.cut_lengths(np.array([1, 2048, 2049, 5000]), 2048)
    assert list(zip(doc.tolist(), piece.tolist(), start.tolist(), length.tolist())) == [(0, 0, 0, 1), (1, 0, 0, 2048), (2, 0, 0, 1), (2, 1, 1, 2048), (3, 0, 0, 904), (3, 1, 904, 2048), (3, 2, 2952, 2048)]


def test_query_against_the_library(spark):
    docs, tok = pd.read_parquet(f"{SF}/documents.parquet"), Tokenizer.from_file(PATH)
    got = packing.op11_best_fit_packing(spark, SF).toPandas()
    lengths = []
    for i, text in zip(docs.doc_id, docs.text):
        ids = np.array(tok.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        own = got[got.doc_id == i].sort_values("piece")
        assert own.piece.tolist() == list(range(-(-len(ids) // 2048)))
        assert own.start.tolist() == [0, *np.cumsum(own.length)[:-1]] and own.length.sum() == len(ids) and (own.length.iloc[1:] == 2048).all()
        assert own.ids_crc32.tolist() == [zlib.crc32(ids[a : a + n].tobytes()) for a, n in zip(own.start, own.length)]
        lengths += own.length.tolist()
    checked(got, 2048)
    assert got.sequence_id.nunique() == len(one_by_one(lengths, 2048))


def test_sequences_and_odd_rows(spark):
    texts = [None, "", "one two", "one two", "a " * 300, "é漢字 <|endoftext|> x", " \n\t"]
    rows = [(k if k != 3 else None, t, "x", 5) for k, t in enumerate(texts)] + [(2, "one two", "y", 6)] * 40  # a repeated id
    docs = spark.createDataFrame(rows, "doc_id long, text string, length string, part int").repartition(3)
    packed = packing.pack(docs, PATH, most=16)
    got, tok = packed.toPandas(), Tokenizer.from_file(PATH)
    checked(got, 16)
    want = Counter((d, tuple(tok.encode(t or "", add_special_tokens=False).ids + [0])) for d, t, _, _ in rows)
    short = Counter((None if pd.isna(r.doc_id) else int(r.doc_id), tuple(r.ids)) for r in got.itertuples() if r.doc_id != 4)
    assert short == Counter({k: n for k, n in want.items() if k[0] != 4})
    long = got[got.doc_id == 4].sort_values("piece")
    assert [x for ids in long.ids for x in ids] == list(next(k[1] for k in want if k[0] == 4)) and (long.length.iloc[1:] == 16).all()
    whole = packing.sequences(packed).toPandas()
    assert whole.n_tokens.sum() == got.length.sum() and whole.n_tokens.max() <= 16 and len(whole) == got.sequence_id.nunique()
    first = got[got.sequence_id == whole.sequence_id[0]].sort_values("offset")
    assert [x for ids in first.ids for x in ids] == list(whole.ids[0])
    assert packing.pack(docs.limit(0), PATH).collect() == []


def test_workers_drop_what_other_operators_keep():
    from corpusloom.llm import bytebpe, session, tokenstore

    bytebpe.coder(*bytebpe.public_file())
    tokenstore.encoder(PATH)
    session.forget("coder")
    assert (bytebpe.coder.cache_info().currsize, tokenstore.encoder.cache_info().currsize) == (1, 0)
    assert list(session.small(iter([]))) == [] and bytebpe.coder.cache_info().currsize == 0
