"""Words of whole texts as 64-bit hashes, cut out of Arrow buffers without a Python object for each word.

A word is a run of bytes other than space and the controls 9 to 13.  These are single bytes in UTF-8, so
cutting bytes cuts code points too.  A hash is a sum of random values by byte and place, then mixed; two words
share one with odds of about 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes worked on at once; a longer document goes through in pieces that end between words.
PIECE = 1 << 20

SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_RANDOM = np.random.default_rng(20240229)
_BYTE = _RANDOM.integers(1, 2**64, 256, dtype=np.uint64)
_BYTE[SEPARATOR] = 0
_PLACE = np.uint64(0x9E3779B97F4A7C15)
_powers = np.ones(1, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed one-to-one scrambling of 64-bit values (the finisher of MurmurHash3)."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def powers(n: int) -> np.ndarray:
    """The first n powers of the place factor, modulo 2**64."""
    global _powers
    if len(_powers) < n:
        _powers = np.concatenate([[np.uint64(1)], np.cumprod(np.full(max(n, 4096), _PLACE), dtype=np.uint64)])
    return _powers[:n]


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and the offsets between them; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    if not len(texts):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, ends, data = texts.buffers()
    offsets = np.frombuffer(ends, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    held = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.empty(0, np.uint8)
    return held, offsets - offsets[0]


def slices(offsets: np.ndarray, most: int = PIECE) -> Iterator[tuple[int, int]]:
    """Runs of documents of at most so many bytes together, or one longer document."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
        yield first, min(last, n)
        first = min(last, n)


@dataclass
class Words:
    """Words of documents first to last: their bytes and the cuts between documents, hashes and byte spans of the
    words, and the first word of each document."""

    first: int
    last: int
    data: np.ndarray
    cuts: np.ndarray
    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    of_doc: np.ndarray

    def span(self, k: int) -> slice:
        """Words of the k-th document of this run."""
        return slice(int(self.of_doc[k]), int(self.of_doc[k + 1]))


def _piece(data: np.ndarray, a: int, b: int, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, starts and ends of the words in data[a:b]; cuts are the document starts in it."""
    part = data[a:b]
    word = ~SEPARATOR[part]
    opens = word.copy()
    opens[1:] &= ~word[:-1]
    inside = cuts[(cuts > a) & (cuts < b)] - a
    opens[inside] = word[inside]
    starts = np.flatnonzero(opens)
    if not len(starts):
        return np.empty(0, np.uint64), starts, starts
    run = np.diff(np.append(starts, b - a))
    place = np.arange(starts[0], b - a) - np.repeat(starts, run)
    value = _BYTE[part[starts[0] :]] * powers(int(run.max()) + 1)[place]
    sums = np.add.reduceat(value, starts - starts[0])
    ends = starts + np.add.reduceat(word[starts[0] :], starts - starts[0], dtype=np.int64)
    return mix(sums), starts + a, ends + a


def words(texts: pa.Array, lower: bool, most: int = PIECE) -> Iterator[Words]:
    """The words of all texts, by runs of documents; ``lower`` turns A-Z into a-z first."""
    data, offsets = buffers(texts)
    for first, last in slices(offsets, most):
        lo, hi = int(offsets[first]), int(offsets[last])
        held = LOWER[data[lo:hi]] if lower else data[lo:hi]
        cuts = offsets[first : last + 1] - lo
        parts, a = [], 0
        while a < hi - lo:
            b = min(a + PIECE, hi - lo)
            while b < hi - lo and not SEPARATOR[held[b]]:
                stop = np.flatnonzero(SEPARATOR[held[b : b + PIECE]])
                b = b + int(stop[0]) if len(stop) else min(b + PIECE, hi - lo)
            parts.append(_piece(held, a, b, cuts))
            a = b
        hashes, starts, ends = (
            (np.concatenate(x) for x in zip(*parts)) if parts else (np.empty(0, np.uint64), *[np.empty(0, np.int64)] * 2)
        )
        yield Words(first, last, held, cuts, hashes, starts, ends, np.searchsorted(starts, cuts))


def windows(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of n neighbouring words."""
    if len(hashes) < n:
        return np.empty(0, np.uint64)
    total = np.full(len(hashes) - n + 1, np.uint64(n))
    for k in range(n):
        total = mix(total) + hashes[k : len(hashes) - n + 1 + k]
    return mix(total)


_ANY = _RANDOM.integers(1, 2**64, 256, dtype=np.uint64)


def lines(data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, 64-bit hash and whether it holds a word, for each line of documents that start at the cuts.

    A line of any length is summed up piece by piece.
    """
    breaks = np.flatnonzero(data == 10)
    of_doc = np.searchsorted(cuts, breaks, "right") - 1
    starts = np.concatenate([cuts[:-1], breaks + 1])
    doc = np.concatenate([np.arange(len(cuts) - 1), of_doc])
    order = np.lexsort((doc, starts))  # the line after a document's last break may start where the next one does
    starts, doc = starts[order], doc[order]
    mark, has_word = np.zeros(len(starts), np.uint64), np.zeros(len(starts), bool)
    high = powers(PIECE + 1)[PIECE]
    for a in range(0, len(data), PIECE):
        part = data[a : a + PIECE]
        first = int(np.searchsorted(starts, a, "right")) - 1
        last = int(np.searchsorted(starts, a + len(part), "left"))
        inside = np.maximum(starts[first:last] - a, 0)
        keep = np.append(inside[1:] > inside[:-1], inside[-1] < len(part))
        inside = inside[keep]
        line = np.arange(first, last)[keep]
        run = np.diff(np.append(inside, len(part)))
        place = np.arange(a, a + len(part)) - np.repeat(starts[line], run)
        factor = powers(PIECE)[place & (PIECE - 1)]
        if place[0] >= PIECE or run.max() >= PIECE:
            factor = factor * _high_power(high, place >> 20)
        value = np.where(part == 10, np.uint64(0), _ANY[part] * factor)
        mark[line] += np.add.reduceat(value, inside)
        has_word[line] |= np.logical_or.reduceat(~SEPARATOR[part], inside)
    return doc, mark, has_word


def _high_power(base: np.uint64, exponent: np.ndarray) -> np.ndarray:
    """base to each of these powers, of which a piece has at most two."""
    value, at = np.unique(exponent, return_inverse=True)
    modulus = 1 << 64
    return np.array([pow(int(base), int(v), modulus) for v in value], np.uint64)[at]
