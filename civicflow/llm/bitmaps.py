"""Bloom filters of 64-bit hashes that tasks fill on their own and that are then folded into one.

A filter is an array of 64-bit words; a hash sets four bits of one word.  Two filters go together: ``once`` has all
hashes, ``twice`` those met again.  Filters of two tasks fold by (a | b) for ``once`` and by a | b, and the bits that
both tasks' ``once`` have, for ``twice``, so a hash met by two tasks is in ``twice`` too: no hash met twice is ever
missing from it, in whatever order tasks are folded.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civicflow.llm.words import buffers
from civicflow.llm.workers import map_batches

#: Words of a segment, the piece of a filter that is folded on its own.
SEGMENT = 8192
#: Groups in which the tasks' filters are folded first.
FAN = 256
#: Bits of a filter for each hash, if they are within the bound.
BITS = 16


def words_for(hashes: int, most_bytes: int) -> int:
    """Words of a filter for so many hashes: a power of two, in at most so many bytes."""
    wanted = 1 << max(0, (hashes * BITS // 64 - 1).bit_length())
    return max(SEGMENT, min(wanted, 1 << (most_bytes // 8).bit_length() - 1))


def _bits(hashes: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Word and mask of each hash."""
    at = (hashes & np.uint64(words - 1)).astype(np.int64)
    mask = np.zeros(len(hashes), np.uint64)
    for shift in (40, 46, 52, 58):
        mask |= np.uint64(1) << ((hashes >> np.uint64(shift)) & np.uint64(63))
    return at, mask


def maybe_in(filter_: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes may be in a filter; those that are not are surely not."""
    at, mask = _bits(hashes, len(filter_))
    return (filter_[at] & mask) == mask


class Seen:
    """The two filters of one task."""

    def __init__(self, words: int):
        self.once, self.twice = np.zeros(words, np.uint64), np.zeros(words, np.uint64)

    def add(self, hashes: np.ndarray) -> None:
        """Note hashes, of which some may be equal."""
        kinds, count = np.unique(hashes, return_counts=True)
        again = kinds[(count > 1) | maybe_in(self.once, kinds)]
        np.bitwise_or.at(self.twice, *_bits(again, len(self.twice)))
        np.bitwise_or.at(self.once, *_bits(kinds, len(self.once)))


def _pack(part: np.ndarray) -> bytes:
    return pa.compress(part.tobytes(), codec="zstd", asbytes=True)


def _unpack(raw: bytes) -> np.ndarray:
    return np.frombuffer(pa.decompress(raw, SEGMENT * 8, codec="zstd", asbytes=True), np.uint64)


def hashes_of(column: pa.Array, step: int) -> np.ndarray:
    """A column of bigint as hashes, or the first eight bytes of every ``step`` bytes of a column of bytes."""
    if pa.types.is_int64(column.type):
        return column.to_numpy(zero_copy_only=False).view(np.uint64)
    return np.frombuffer(buffers(column)[0].tobytes(), "<u8")[:: step // 8]


def _fill(words: int, step: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Seen(words)
        for batch in batches:
            seen.add(hashes_of(batch.column(0), step))
        part = TaskContext.get().partitionId()
        for k in range(0, words, SEGMENT):
            once, twice = seen.once[k : k + SEGMENT], seen.twice[k : k + SEGMENT]
            if once.any():
                columns = [[k // SEGMENT], [part], [_pack(once)], [_pack(twice)]]
                kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=NAMES)

    return run


NAMES = ["segment", "part", "once", "twice"]
_TYPES = "segment int, part int, once binary, twice binary"


def _fold(table: pa.Table) -> pa.Table:
    once, twice = np.zeros(SEGMENT, np.uint64), np.zeros(SEGMENT, np.uint64)
    for a, b in zip(table.column("once"), table.column("twice")):
        more = _unpack(a.as_py())
        twice |= _unpack(b.as_py()) | (once & more)
        once |= more
    columns = [table.column("segment")[:1], table.column("part")[:1], [_pack(once)], [_pack(twice)]]
    return pa.table(columns, names=NAMES)


def filters(hashes: DataFrame, words: int, step: int = 8) -> DataFrame:
    """(segment, once, twice) of the hashes in the one column of a frame: bigint, or bytes of which each ``step`` are one.

    Only filters move, not hashes.  Tasks' filters fold in two levels: a segment's come first together by 256th
    of the tasks.
    """
    filled = map_batches(hashes, _fill(words, step), _TYPES)
    some = filled.groupBy("segment", F.pmod("part", F.lit(FAN)).alias("bin")).applyInArrow(_fold, _TYPES)
    return some.groupBy("segment").applyInArrow(_fold, _TYPES).select("segment", "once", "twice")


def gathered(parts: DataFrame, words: int, which: str) -> np.ndarray:
    """One of the two filters whole, on the driver: of a size that was bounded when it was made."""
    out = np.zeros(words, np.uint64)
    for row in parts.select("segment", which).toLocalIterator():
        out[row.segment * SEGMENT : (row.segment + 1) * SEGMENT] = _unpack(bytes(row[which]))
    return out
