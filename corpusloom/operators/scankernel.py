"""The part of scan search that runs on batches of files: which terms lie in which line, and each query's best places in the batch.

A term holds no white space, so it lies in a line where it lies in one of its words. Each distinct word's terms are looked up once, by
its substrings; a line's terms are those of its words, as bits. Lines meet queries as a product of matrices.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

# Fixed value: signs that are in no term.
SIGNS = ',;!?"()'
#: Words whose terms are kept, and elements of a matrix.
WORDS, CELLS = 200_000, 8_000_000
OUT = pa.schema([("_q", pa.int32()), ("path", pa.string()), ("start_line", pa.int32()), ("end_line", pa.int32()), ("excerpt", pa.string()), ("covered", pa.int32()), ("exact", pa.bool_()), ("path_matches", pa.int32())])


class Scan:
    """``queries``: pairs of the whole query, trimmed and in lower case, and its terms. The first ``used`` lines with a term give places of ``around`` lines on both sides."""

    def __init__(self, queries: list[tuple[str, list[str]]], k: int, used: int, around: int) -> None:
        self.whole, self.k, self.used, self.around = [w for w, _ in queries], k, used, around
        self.terms = {t: i for i, t in enumerate(dict.fromkeys(t for _, terms in queries for t in terms))}
        self.short = {n: {t: i for t, i in self.terms.items() if len(t) == n} for n in (1, 2)}
        self.lengths: dict[str, list[int]] = {}  # of longer terms, by their first three characters
        for t in self.terms:
            if len(t) > 2 and len(t) not in (own := self.lengths.setdefault(t[:3], [])):
                own.append(len(t))
        self.asks = np.zeros((len(self.terms), len(queries)), np.float32)
        for q, (_, terms) in enumerate(queries):
            self.asks[[self.terms[t] for t in terms], q] = 1
        self.asked = self.asks.sum(axis=0).astype(np.int32)
        self.width = 8 * -(-len(self.terms) // 64)
        self.step = max(64, CELLS // max(1, len(self.terms), len(queries)))
        self._fresh()

    def _fresh(self) -> None:
        self.known: dict[str, int] = {}
        self.bits = np.zeros((1024, self.width), np.uint8)

    def _add(self, word: str) -> int:
        """The number of a word that is not known yet."""
        n, get, lengths, found = len(self.known), self.terms.get, self.lengths.get, []
        for size, own in self.short.items():
            if own:
                found += [own[x] for i in range(len(word) - size + 1) if (x := word[i : i + size]) in own]
        for i in range(len(word) - 2):
            for size in lengths(word[i : i + 3], ()):
                t = get(word[i : i + size])
                if t is not None:
                    found.append(t)
        if n == len(self.bits):
            self.bits = np.concatenate([self.bits, np.zeros_like(self.bits)])
        if found:
            mask = np.zeros(self.width * 8, np.uint8)
            mask[found] = 1
            self.bits[n] = np.packbits(mask)
        self.known[word] = n
        return n

    def _of(self, rows: list) -> np.ndarray:
        """The terms of each row of words, as bits."""
        known, add, ids, ends = self.known, self._add, [], []
        for words in rows:
            for w in words:
                i = known.get(w)
                ids.append(add(w) if i is None else i)
            ends.append(len(ids))
        out, ends = np.zeros((len(rows), self.width), np.uint8), np.array(ends)
        starts = np.concatenate([[0], ends[:-1]])
        some = ends > starts
        if some.any():
            out[some] = np.bitwise_or.reduceat(self.bits.view(np.uint64)[np.array(ids)], starts[some], axis=0).view(np.uint8)
        if len(known) > WORDS:
            self._fresh()
        return out

    def _times(self, bits: np.ndarray) -> np.ndarray:
        """How many terms of each query each row of bits has."""
        return np.unpackbits(bits, axis=1, count=len(self.terms)).astype(np.float32) @ self.asks

    def best(self, paths: list[str], low_paths: list[str], texts: list[str], lows: list[str]) -> pa.RecordBatch:
        """Places of each query in files of different paths, those that can be among its ``k`` best."""
        lines, words, sizes = [], [], []
        for low in lows:
            own = low.split("\n")
            lines += own
            sizes.append(len(own))
            for c in SIGNS:
                low = low.replace(c, " ")
            words += low.replace(". ", " ").replace(".\n", "\n").split("\n")
        first = np.concatenate([[0], np.cumsum(sizes)])
        of = np.repeat(np.arange(len(paths)), sizes)
        bits = np.concatenate([self._of([set(x.split()) for x in words[a : a + self.step]]) for a in range(0, len(words), self.step)])
        in_path = self._of([[p] for p in low_paths])
        windows = bits | in_path[of]
        for d in range(1, self.around + 1):
            same = of[d:] == of[:-d]
            windows[d:] |= bits[:-d] * same[:, None]
            windows[:-d] |= bits[d:] * same[:, None]
        found = []  # line, query, covered
        seen = np.zeros(len(self.whole), np.int32)  # places so far of a file that goes on from one step to the next
        for a in range(0, len(lines), self.step):
            b = min(a + self.step, len(lines))
            hit = self._times(bits[a:b]) > 0
            count = np.cumsum(hit, axis=0, dtype=np.int32)
            before = np.concatenate([np.zeros((1, count.shape[1]), np.int32), count])
            begin = np.maximum(first[of[a:b]], a) - a
            count -= before[begin]
            count[first[of[a:b]] < a] += seen
            seen = count[-1] if first[of[b - 1] + 1] > b else np.zeros_like(seen)
            at, q = np.nonzero(hit & (count <= self.used))
            rows, back = np.unique(at, return_inverse=True)
            covered = self._times(windows[a:b][rows])[back, q].astype(np.int32)
            able = self.least[q] <= (covered.astype(np.int64) * 2 + 2) * (len(self.terms) + 1)
            found.append((at[able] + a, q[able], covered[able]))
        line, q, covered = (np.concatenate(x) for x in zip(*found))
        file = of[line]
        number = line - first[file] + 1
        start, end = np.maximum(number - self.around, 1), np.minimum(number + self.around, np.array(sizes)[file])
        # in a short file two lines may give one place
        order = np.lexsort((line, file, q))
        line, q, covered, file, start, end = (x[order] for x in (line, q, covered, file, start, end))
        once = np.ones(len(line), bool)
        once[1:] = (q[1:] != q[:-1]) | (file[1:] != file[:-1]) | (start[1:] != start[:-1]) | (end[1:] != end[:-1])
        line, q, covered, file, start, end = (x[once] for x in (line, q, covered, file, start, end))
        above = self._times(in_path).astype(np.int32)[file, q]
        exact = np.zeros(len(line), bool)
        # the whole query holds all of its terms
        for i in np.flatnonzero(covered == self.asked[q]):
            whole, at = self.whole[q[i]], first[file[i]]
            exact[i] = whole != "" and (whole in low_paths[file[i]] or whole in "\n".join(lines[at + start[i] - 1 : at + end[i]]))
        score = (covered.astype(np.int64) * 2 + exact) * (len(self.terms) + 1) + above
        place = np.empty(len(paths), np.int64)
        place[sorted(range(len(paths)), key=paths.__getitem__)] = np.arange(len(paths))  # by code points, as bytes of UTF-8 are
        order = np.lexsort((end, start, place[file], -score, q))
        rank = np.arange(len(order)) - np.searchsorted(q[order], q[order])
        kept = order[(rank < self.k) & (score[order] >= self.least[q[order]])]
        # what is worse than the k-th place of one batch is not among the best
        last = order[rank == self.k - 1]
        self.least[q[last]] = np.maximum(self.least[q[last]], score[last])
        texts_of = {f: texts[f].split("\n") for f in set(file[kept].tolist())}
        cut = ["\n".join(texts_of[f][s - 1 : e]) for f, s, e in zip(file[kept].tolist(), start[kept].tolist(), end[kept].tolist())]
        columns = [q[kept], [paths[f] for f in file[kept]], start[kept], end[kept], cut, covered[kept], exact[kept], above[kept]]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) if isinstance(c, list) else pa.array(c).cast(f.type) for c, f in zip(columns, OUT)], schema=OUT)

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        self.least = np.zeros(len(self.whole), np.int64)
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            times: dict[str, int] = {}
            rounds: list[list[int]] = []  # a path that comes again goes into another round
            for i, path in enumerate(columns[0]):
                n = times[path] = times.get(path, -1) + 1
                if n == len(rounds):
                    rounds.append([])
                rounds[n].append(i)
            for own in rounds:
                for a in range(0, len(own), 1000):
                    yield self.best(*[[c[i] for i in own[a : a + 1000]] for c in columns])
