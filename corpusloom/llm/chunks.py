"""Splitting text at spaces where the tokenizers' pattern always starts a new match.

The public pattern lets a space open the next match when a non-space follows it. So a text may
be cut before every space that precedes a character other than white space, and each chunk
encoded alone; chunks repeat far more often than texts, so their ids are kept in a table. Where the rule may not hold
(white space of other kinds, special strings) no cut is made; a longer chunk has the same ids.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from corpusloom.llm.wordkernel import BYTE_CODE, span_hash

class Codes(dict):
    """Numbers keys in the order in which they are first asked for."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, key: str) -> int:
        self.new.append(key)
        k = self[key] = len(self)
        return k


def gathered(ids: np.ndarray, offsets: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the given rows of a ragged table one after another, and n+1 offsets."""
    first = offsets[rows]
    sizes = offsets[rows + 1] - first
    upto = np.zeros(len(rows) + 1, np.int64)
    np.cumsum(sizes, out=upto[1:])
    return ids[np.arange(upto[-1]) + np.repeat(first - upto[:-1], sizes)], upto


#: Bytes that may begin white space of the pattern, and lead bytes of characters among which white space is.
_BLANK = np.zeros(256, bool)
_BLANK[[*range(0x09, 0x0E), *range(0x1C, 0x21), 0xC2, 0xE1, 0xE2, 0xE3]] = True


class SpanTable:
    """Ids of chunks seen so far in this process, at most about ``most`` chunks; then it starts anew.

    A chunk is a slice of a UTF-8 buffer, known by a 64-bit hash, its length and its first eight bytes. ``apart`` takes strings, and
    ``together`` a string of chunks that each start with a space, and their ends in bytes; both return ids one after
    another with n+1 offsets. Where a space may precede white space or a ``special`` string no cut is made.
    """

    def __init__(self, apart: Callable, together: Callable, most: int = 1_000_000, special: tuple[str, ...] = ()):
        self.apart, self.together, self.most = apart, together, most
        self.shift = np.uint64(64 - (int(2.5 * most).bit_length()))
        self.blank = _BLANK.copy()
        self.blank[[s.encode()[0] for s in special if s]] = True
        self.clear()

    def clear(self) -> None:
        size = 1 << (64 - int(self.shift))
        self.keys, self.heads, self.vals = np.zeros(size, np.uint64), np.zeros(size, np.uint64), np.zeros(size, np.int32)
        self.ids, self.offsets, self.n = np.zeros(0, np.int32), np.zeros(1, np.int64), 0

    def _keep(self, ids: np.ndarray, sizes: np.ndarray) -> None:
        """Append chunks to the table; its arrays grow by half."""
        used = int(self.offsets[self.n])
        if used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids[:used], np.zeros(used // 2 + 2 * len(ids), np.int32)])
        if self.n + len(sizes) >= len(self.offsets):
            self.offsets = np.concatenate([self.offsets[: self.n + 1], np.zeros(self.n // 2 + 2 * len(sizes), np.int64)])
        self.ids[used : used + len(ids)] = ids
        self.offsets[self.n + 1 : self.n + 1 + len(sizes)] = used + np.cumsum(sizes)
        self.n += len(sizes)

    def _find(self, key: np.ndarray, head: np.ndarray) -> np.ndarray:
        """The chunk's number, or -1."""
        at, out, mask = (key >> self.shift).astype(np.int64), np.full(len(key), -1, np.int64), len(self.keys) - 1
        found = self.keys[at]
        hit = (found == key) & (self.heads[at] == head)
        out[hit] = self.vals[at[hit]]
        todo = np.flatnonzero(~hit & (found != 0))
        while len(todo):
            at[todo] = (at[todo] + 1) & mask
            found = self.keys[at[todo]]
            hit = (found == key[todo]) & (self.heads[at[todo]] == head[todo])
            out[todo[hit]] = self.vals[at[todo[hit]]]
            todo = todo[~hit & (found != 0)]
        return out

    def _put(self, key: np.ndarray, head: np.ndarray, val: np.ndarray) -> None:
        at, todo, mask = (key >> self.shift).astype(np.int64), np.arange(len(key)), len(self.keys) - 1
        while len(todo):
            free = todo[self.keys[at[todo]] == 0]
            _, first = np.unique(at[free], return_index=True)
            put = free[first]
            self.keys[at[put]], self.heads[at[put]], self.vals[at[put]] = key[put], head[put], val[put]
            placed = np.zeros(len(key), bool)
            placed[put] = True
            todo = todo[~placed[todo]]
            at[todo] = (at[todo] + 1) & mask

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, n+1 offsets) of a buffer of texts and its n+1 offsets."""
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        opens = np.zeros(len(data), bool)  # a space before something that is not white space
        opens[:-1] = (data[:-1] == 32) & ~self.blank[data[1:]]
        opens[offsets[1:][np.diff(offsets) > 0] - 1] = False  # the text's last byte
        begins = opens.copy()
        begins[offsets[:-1][np.diff(offsets) > 0]] = True
        starts = np.flatnonzero(begins)
        ends = np.append(starts[1:], len(data))
        size = ends - starts
        key = np.maximum(span_hash(BYTE_CODE[data], starts, ends), np.uint64(1))
        padded = np.concatenate([data, np.zeros(8, np.uint8)])
        eight = np.ndarray((len(data),), "<u8", padded, strides=(1,))[starts]
        short = np.uint64(8) * (np.uint64(8) - np.minimum(size, 8).astype(np.uint64))
        head = ((eight << short) >> short) ^ (size.astype(np.uint64) << np.uint64(40))
        if self.n > self.most:
            self.clear()
        code = self._find(key, head)
        new = np.flatnonzero(code < 0)
        if len(new):
            order = new[np.lexsort((head[new], key[new]))]
            edge = np.ones(len(order), bool)
            edge[1:] = (key[order][1:] != key[order][:-1]) | (head[order][1:] != head[order][:-1])
            fresh = order[edge]
            joined = opens[starts[fresh]]
            fresh, joined = np.concatenate([fresh[joined], fresh[~joined]]), int(joined.sum())
            base, flat, sizes = self.n, [], []
            if joined:
                own, upto = gathered(data, np.append(starts, len(data)), fresh[:joined])
                ids, at = self.together(own.tobytes(), upto)
                flat.append(ids)
                sizes.append(np.diff(at))
            if joined < len(fresh):
                raw = data.tobytes()
                ids, at = self.apart([raw[a:b].decode() for a, b in zip(starts[fresh[joined:]].tolist(), ends[fresh[joined:]].tolist())])
                flat.append(ids)
                sizes.append(np.diff(at))
            number = base + np.arange(len(fresh))
            self._keep(np.concatenate(flat), np.concatenate(sizes))
            if self.n * 2 > len(self.keys):  # one batch of very many chunks: they are not kept
                self.keys[:] = 0
            else:
                self._put(key[fresh], head[fresh], number)
            code[fresh] = number
            code[order] = code[order[edge]][np.cumsum(edge) - 1]
        flat, upto = gathered(self.ids, self.offsets, code)
        return flat, upto[np.searchsorted(starts, offsets)]
