"""Words of many texts as flat numpy arrays: the shared first step of the operators that read words in bulk.

A batch of texts is cut into slabs of a bounded number of bytes. A slab holds several whole texts, or a window of one very
long text; windows overlap by ``overlap`` words, and ``fresh`` tells which words a slab is the first to show, so that
every run of up to ``overlap + 1`` words is seen whole and counted once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLAB_BYTES = 8 << 20
WORD, SPACE, BREAK = 0, 1, 2


@dataclass(frozen=True)
class Words:
    """One entry for each word of a slab; ``piece`` changes wherever a run of words ends."""
    ids: np.ndarray         # place in ``vocab``
    row: np.ndarray         # row of the batch
    piece: np.ndarray
    start: np.ndarray       # bytes from the start of the text
    end: np.ndarray
    fresh: np.ndarray
    vocab: np.ndarray       # bytes of all distinct words, one after the other
    cuts: np.ndarray        # where each distinct word starts in ``vocab``, and the end


def byte_classes(spaces: bytes, breaks: bytes) -> np.ndarray:
    kind = np.full(256, WORD, np.uint8)
    kind[list(spaces)] = SPACE
    kind[list(breaks)] = BREAK
    return kind


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    col = texts.cast(pa.large_binary())
    _, offsets, data = col.buffers()
    at = np.frombuffer(offsets, np.int64)[col.offset:col.offset + len(col) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), at


def _slab(data: np.ndarray, rows: np.ndarray, starts: np.ndarray, base: np.ndarray, kind: np.ndarray, skip: int) -> Words:
    """Words of ``data``, which holds the texts ``rows`` from ``starts`` on; ``base`` is where each begins in its text."""
    cls = kind[data]
    inside = cls == WORD
    first = np.zeros(len(data) + 1, bool)
    first[starts] = True
    first = first[:len(data)]
    opens = inside & (first | ~np.r_[False, inside[:-1]])
    closes = inside & ~np.r_[inside[1:] & ~first[1:], False]
    start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    piece = np.cumsum((cls == BREAK) | first)[start]
    of = np.searchsorted(starts, start, side="right") - 1
    sizes = np.r_[0, np.cumsum(end - start)].astype(np.int64)
    flat = np.ascontiguousarray(data[inside])
    coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(sizes), pa.py_buffer(flat)]) \
        .dictionary_encode()
    vocab, cuts = _bytes_of(coded.dictionary)
    fresh = np.ones(len(start), bool)
    fresh[:skip] = False
    return Words(coded.indices.to_numpy(), rows[of], piece, start - starts[of] + base[of], end - starts[of] + base[of], fresh,
                 vocab[cuts[0]:cuts[-1]], cuts - cuts[0])


def slabs(texts: pa.Array, kind: np.ndarray, overlap: int, fold: np.ndarray | None = LOWER,
          limit: int = SLAB_BYTES) -> Iterator[Words]:
    """All words of ``texts``, slab by slab; ``fold`` maps bytes before words are told apart."""
    data, at = _bytes_of(texts)
    folded = (lambda x: x) if fold is None else (lambda x: fold[x])
    n, r = len(texts), 0
    while r < n:
        if at[r + 1] - at[r] > limit:
            yield from _long(folded, data[at[r]:at[r + 1]], r, kind, overlap, limit)
            r += 1
            continue
        last = max(r + 1, int(np.searchsorted(at, at[r] + limit, side="right")) - 1)
        rows = np.flatnonzero(np.diff(at[r:last + 1])) + r            # empty texts have no words
        if len(rows):
            yield _slab(folded(data[at[r]:at[last]]), rows, (at[rows] - at[r]).astype(np.int64), np.zeros(len(rows), np.int64), kind, 0)
        r = last


def _long(folded, text: np.ndarray, row: int, kind: np.ndarray, overlap: int, limit: int) -> Iterator[Words]:
    one, zero = np.array([row]), np.zeros(1, np.int64)
    lo, reach, skip = 0, 0, 0
    while reach < len(text):
        hi = min(len(text), reach + limit)
        while hi < len(text) and kind[text[hi]] == WORD:              # up to the end of a word
            run = np.flatnonzero(kind[text[hi:hi + limit]] != WORD)
            hi += int(run[0]) if len(run) else min(limit, len(text) - hi)
        w = _slab(folded(text[lo:hi]), one, zero, np.array([lo]), kind, skip)
        yield w
        reach = hi
        skip = min(overlap, len(w.start))
        lo = int(w.start[-skip]) if skip else hi
