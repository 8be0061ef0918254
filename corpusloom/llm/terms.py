"""Terms of texts inside Arrow tasks: runs of bytes of a class, A-Z lower-cased.

The classes take every byte beyond ASCII, so a run of bytes is a run of whole characters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from corpusloom.llm.wordkernel import LOWER, pieces, row_of, runs, utf8

_LETTERS = np.zeros(256, bool)
_LETTERS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_WORDS = _LETTERS.copy()
_WORDS[48:58] = True
#: Letters alone, and letters with digits.
LETTERS, WORDS = _LETTERS, _WORDS
#: Bytes of text scanned at a time; a longer text is scanned whole.
SCAN = 1 << 20


def scanned(texts: pa.Array, inside: np.ndarray) -> Iterator[tuple[int, int, pa.StringArray, np.ndarray]]:
    """(i, j, terms, row) for runs of rows [i, j): all their terms in order, and the row, from i, that holds each.

    Null counts as the empty text, which has no term.
    """
    data, offsets = utf8(texts)
    for i, j in pieces(offsets, SCAN):
        own, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        held = inside[own]
        starts, ends = runs(held, at)
        upto = np.zeros(len(starts) + 1, np.int32)
        np.cumsum(ends - starts, out=upto[1:])
        terms = pa.StringArray.from_buffers(len(starts), pa.py_buffer(upto), pa.py_buffer(LOWER[own[held]]))
        yield i, j, terms, i + row_of(starts, at)
