"""Words and word shingles of whole texts as 64-bit hashes, a batch of texts at a time in numpy.

Words are maximal runs of bytes other than 0x20 and 0x09-0x0D, A-Z in lower case, as in `[^\\x20\\x09-\\x0D]+`. Equal words
have equal hashes in every task and on every machine; unequal ones differ but for a chance of about 2^-64 a pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from veilframe.llm.common import kept

SLICE_BYTES = 1 << 18  # some fifty bytes of arrays for each, powers included
_U64 = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Also ASCII punctuation and control characters: words are then runs of letters, digits and anything beyond ASCII.
PLAIN = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit integers (the finaliser of splitmix64)."""
    x = (x ^ (x >> _U64(30))) * _U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U64(27))) * _U64(0x94D049BB133111EB)
    return x ^ (x >> _U64(31))


def numbers(n: int, seed: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit numbers."""
    return mix(np.arange(1, n + 1, dtype=_U64) * _U64(0x9E3779B97F4A7C15) + _U64(seed))


_BYTE = numbers(256, 11)
_BYTE[65:91] = _BYTE[97:123]
_BASE = _U64(0xD6E8FEB86659FD93)  # odd, so it has an inverse modulo 2^64
_BACK = _U64(pow(0xD6E8FEB86659FD93, -1, 1 << 64))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, at least n + 1 of each."""
    size = 2 * SLICE_BYTES
    while size < n:
        size *= 2

    def make():
        out = []
        for base in (_BASE, _BACK):
            p = np.full(size + 1, base, _U64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        return out[0], out[1]

    return kept(("powers", size), make)


def text_slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets of the rows in these bytes) of consecutive rows of a string array.

    A slice ends with the row that reaches `most` bytes, so a text of any length is in one slice. Null is empty.
    """
    if not len(texts):
        return
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(texts):
        hi = min(len(texts), max(lo + 1, int(np.searchsorted(off, off[lo] + most, "right")) - 1))
        yield lo, hi, raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


def word_hashes(data: np.ndarray, off: np.ndarray, between: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all rows in order, and the offsets of the rows in them."""
    starts, ends, rows = word_bounds(data, off, between)
    up, down = _powers(len(data))
    total = np.zeros(len(data) + 1, _U64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=total[1:])
    hashes = mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(_U64))
    return hashes, rows


def word_bounds(data: np.ndarray, off: np.ndarray, between: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of all rows in order, and the offsets of the rows in them."""
    inside = ~between[data]
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    edge = off[1:-1]  # a row's first byte follows nothing, its last byte precedes nothing
    before[edge[edge < len(data)]] = False
    after[edge[edge > 0] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, off)


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Running Karp-Rabin: hashes of all runs of exactly `width` words, each from the one before by a sum."""
    if len(words) < width or not width:
        return np.zeros(0, _U64)
    up, down = _powers(len(words))
    total = np.zeros(len(words) + 1, _U64)
    np.cumsum(words * up[: len(words)], out=total[1:])
    return mix((total[width:] - total[:-width]) * down[: len(words) - width + 1])


_STEP = numbers(64, 29) | _U64(1)


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the runs of `width` words of one text in order; of all its words as one run if it has fewer."""
    n = min(width, len(words))
    if not n:
        return np.zeros(0, _U64)
    total = np.full(len(words) - n + 1, _U64(n), _U64)
    for i in range(n):
        total += words[i : len(words) - n + 1 + i] * _STEP[i]
    return mix(total)


def shingle_sets(texts: pa.Array, width: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of every text."""
    for lo, hi, data, off in text_slices(texts):
        words, rows = word_hashes(data, off)
        for i in range(hi - lo):
            yield lo + i, np.unique(shingle_hashes(words[rows[i] : rows[i + 1]], width))
