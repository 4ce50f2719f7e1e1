"""Fill-in-the-middle texts: each text is cut at two random units and its parts are put in another order.

A unit is a run of white space with the word after it; white space at the end is a unit of its own.  A text is
divided into blocks of a fixed number of bytes.  Two Fenwick trees over the blocks hold how many units end in
each and how many code points start in each.  A cut after so many units is found by binary-lifting descent: the
descent gives the block in which the unit ends, and the units and code points before it, and only that block is
looked at for the place itself.  A point update keeps the trees right when a block is rewritten.

Which texts are changed, where they are cut and in which order they are put follows from a keyed hash of doc_id,
so every run and every partitioning gives the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civicflow.llm.words import SEPARATOR, buffers
from civicflow.llm.workers import map_batches

#: What stands before the prefix, the suffix and the middle.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: Bytes looked at together while blocks are counted, and bytes of a batch of results.
STRETCH, BATCH = 1 << 20, 16 << 20


@dataclass(frozen=True)
class Fim:
    """Key of the hash; percent of texts that are changed, and of these that start with the suffix; bytes a block."""

    seed: int = 42
    percent: int = 50
    suffix_first: int = 80
    block: int = 4096

    def draws(self, doc_id: int | None) -> list[int]:
        """Four numbers of 32 bits: two for the cuts, one for whether and one for how to change."""
        digest = sha256(f"{self.seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
        return [int(digest[k : k + 8], 16) for k in range(0, 32, 8)]


class BlockTree:
    """How many units and code points the blocks of a text hold, with sums up to any block in logarithmic time."""

    def __init__(self, units: np.ndarray, chars: np.ndarray):
        self.n = len(units)
        place = np.arange(1, self.n + 1)
        below = place - (place & -place)
        self.units, self.chars = (
            [0, *(total[place] - total[below]).tolist()]
            for total in (np.concatenate([[0], np.cumsum(x, dtype=np.int64)]) for x in (units, chars))
        )

    def add(self, block: int, units: int, chars: int) -> None:
        """Change the counts of one block by so much."""
        at = block + 1
        while at <= self.n:
            self.units[at] += units
            self.chars[at] += chars
            at += at & -at

    def total(self) -> int:
        """All units."""
        at, out = self.n, 0
        while at:
            out += self.units[at]
            at -= at & -at
        return out

    def descend(self, unit: int) -> tuple[int, int, int]:
        """Of the unit with this number, from 1: the block in which it ends, its number among the units that end
        there, and the code points of the blocks before."""
        at, rest, chars = 0, unit, 0
        step = 1 << (self.n.bit_length() - 1)
        while step:
            if at + step <= self.n and self.units[at + step] < rest:
                at += step
                rest -= self.units[at]
                chars += self.chars[at]
            step >>= 1
        return at, rest, chars


def _ends(data: np.ndarray, a: int, b: int) -> np.ndarray:
    """Which bytes of data[a:b] are the last of a unit."""
    word = ~SEPARATOR[data[a : min(b + 1, len(data))]]
    out = word[: b - a].copy()
    out[: len(word) - 1] &= ~word[1:]
    if b == len(data):
        out[-1] = True
    return out


def _starts(part: np.ndarray) -> np.ndarray:
    """Which bytes start a code point."""
    return (part & 0xC0) != 0x80


def block_tree(data: np.ndarray, block: int) -> BlockTree:
    """The tree of a text's bytes, gathered a stretch at a time."""
    units, chars = [], []
    whole = max(STRETCH // block, 1) * block
    for a in range(0, len(data), whole):
        b = min(a + whole, len(data))
        cuts = np.arange(0, b - a, block)
        units.append(np.add.reduceat(_ends(data, a, b), cuts, dtype=np.int64))
        chars.append(np.add.reduceat(_starts(data[a:b]), cuts, dtype=np.int64))
    none = np.empty(0, np.int64)
    return BlockTree(np.concatenate([none, *units]), np.concatenate([none, *chars]))


def cut(data: np.ndarray, tree: BlockTree, units: int, block: int) -> tuple[int, int]:
    """Bytes and code points of the first so many units of a text."""
    if not units:
        return 0, 0
    k, number, chars = tree.descend(units)
    a, b = k * block, min((k + 1) * block, len(data))
    end = a + int(np.flatnonzero(_ends(data, a, b))[number - 1]) + 1
    return end, chars + int(np.count_nonzero(_starts(data[a:end])))


def rearranged(data: np.ndarray, doc_id: int | None, p: Fim) -> tuple[int, str, int | None, int | None, bytes]:
    """Units, form, code points of the prefix and of the middle, and the new text, of a text's bytes."""
    tree = block_tree(data, p.block)
    n, raw = tree.total(), data.tobytes()
    first, second, whether, how = p.draws(doc_id)
    if not n or whether % 100 >= p.percent or any(mark in raw for mark in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, raw
    low, high = sorted((first % (n + 1), second % (n + 1)))
    (a, a_chars), (b, b_chars) = cut(data, tree, low, p.block), cut(data, tree, high, p.block)
    prefix, middle, suffix = raw[:a], raw[a:b], raw[b:]
    if how % 100 < p.suffix_first:
        return n, "spm", a_chars, b_chars - a_chars, b"".join((SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle))
    return n, "psm", a_chars, b_chars - a_chars, b"".join((PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle))


SCHEMA = pa.schema(
    [("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64())]
    + [("middle_chars", pa.int64()), ("text", pa.string())]
)


def _rows(p: Fim):
    def batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = [pa.array(c, pa.binary() if f.name == "text" else f.type) for c, f in zip(zip(*rows), SCHEMA)]
        columns[-1] = columns[-1].cast(pa.string())
        return pa.RecordBatch.from_arrays(columns, schema=SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for part in batches:
            data, offsets = buffers(part.column(1))
            for k, doc_id in enumerate(part.column(0).to_pylist()):
                held.append((doc_id, *rearranged(data[offsets[k] : offsets[k + 1]], doc_id, p)))
                size += len(held[-1][-1])
                if size > BATCH:
                    yield batch(held)
                    held, size = [], 0
            if held:
                yield batch(held)
                held, size = [], 0

    return run


def fill_in_middle(docs: DataFrame, p: Fim = Fim()) -> DataFrame:
    """Every row of docs (doc_id, text) with its text made ready for filling in the middle.

    Columns: doc_id, n (units), form (plain, psm or spm), prefix_chars and middle_chars (code points, null if
    plain) and text.  A text stays plain if the draw says so, if it has no units, or if it holds one of the three
    marks, which would make the new text ambiguous.  A null text counts as empty; a row without doc_id draws by the
    empty id; rows that repeat a doc_id draw alike and are each returned.  Other columns are ignored; an empty table
    gives no rows.  A text is held in memory whole, three times while it is rearranged, and its trees take 16
    numbers for each 64 kB.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    names = "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, text string"
    return map_batches(rows, _rows(p), names)


def restored(text: Column, form: Column) -> Column:
    """The text that a row was made of, from the new text and its form alone.

    The marks are in no part, and no mark can arise where two parts meet, so the new text is cut at its marks.
    """
    part = F.split(text, "<[PSM]>", -1)
    psm, spm = F.concat(part[1], part[3], part[2]), F.concat(part[2], part[3], part[1])
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(text)
