"""Line dedup across documents: lines that several documents share stay in one of them only.

1. Every document gives the 128-bit digests of its distinct lines, as one packed value; texts are not read for this
   again.
2. Tasks put the digests in two Bloom filters, for hashes seen once and seen twice, which are folded into one pair
   (``bitmaps``).  Their size follows the number of lines, up to a bound.
3. Only lines that the second filter holds are suspects.  They alone are shuffled, as digest and doc_id, summed up
   before the shuffle; their exact counts tell which lines are shared, and by the largest doc_id who keeps them.
   A line that many documents share is dealt out over many groups where its documents are told.
4. What each document loses is gathered by document, and goes to its text with a join in which Spark picks the
   strategy by the measured size.

Past the bound on the filters more lines than need be are suspects, at most all; the result stays the same, and the
exact count then moves 24 bytes for each line.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civicflow.llm.bitmaps import filters, gathered, hashes_of, maybe_in, words_for
from civicflow.llm.components import Written
from civicflow.llm.words import buffers
from civicflow.llm.workers import map_batches
from civicflow.operators.relate import join_hot_key

_SPACE = b" \t\n\x0b\x0c\r"
#: Bytes of a text that are split into lines together, of a digest, and of a batch of results.
STRETCH, DIGEST, BATCH = 1 << 20, 16, 16 << 20


@dataclass(frozen=True)
class Lines:
    """Code points that a line has at least, and documents that share it at least; bytes of a filter at most."""

    least_chars: int = 20
    least_docs: int = 3
    most_bytes: int = 64 << 20


def pieces(text: bytes) -> Iterator[list[bytes]]:
    """The lines of a text, some at a time."""
    a = 0
    while len(text) - a > STRETCH:
        b = text.rfind(b"\n", a, a + STRETCH)
        if b < 0:
            b = text.find(b"\n", a + STRETCH)
            if b < 0:
                break
        yield text[a:b].split(b"\n")
        a = b + 1
    yield text[a:].split(b"\n")


def digest_of(line: bytes, least_chars: int) -> bytes | None:
    """The digest of a line's key (trimmed, A-Z lower-cased), or None if the key is too short."""
    key = line.strip(_SPACE)
    if len(key) < least_chars or len(key) < 4 * least_chars and len(key.decode("utf-8", "replace")) < least_chars:
        return None
    return xxhash.xxh3_128_digest(key.lower())  # of bytes: A-Z only


def _marks(p: Lines):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column(2))
            packed = []
            for k in range(batch.num_rows):
                found: set[bytes | None] = set()
                for lines in pieces(data[offsets[k] : offsets[k + 1]].tobytes()):
                    found.update(digest_of(line, p.least_chars) for line in lines)
                packed.append(b"".join(sorted(found - {None})))
            columns = [batch.column(0), batch.column(1), pa.array(packed, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "row", "keys"])

    return run


def _suspects(twice):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(2)
            held = b"".join(keys.to_pylist())
            found = np.flatnonzero(maybe_in(twice.value, hashes_of(keys, DIGEST)))
            size = np.diff(buffers(keys)[1]) // DIGEST
            of = pa.array(np.repeat(np.arange(batch.num_rows), size)[found])
            key = pa.array([held[k * DIGEST : (k + 1) * DIGEST] for k in found.tolist()], pa.binary())
            columns = [key, batch.column(0).take(of), batch.column(1).take(of)]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "doc_id", "row"])

    return run


def _without(p: Lines):
    def batch(rows: list[tuple]) -> pa.RecordBatch:
        ids, n, dropped, texts = zip(*rows)
        texts = pa.array(texts, pa.binary()).cast(pa.string())
        columns = [pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(dropped, pa.int64()), texts]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_lines", "n_dropped", "text"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            data, offsets = buffers(part.column(1))
            held, size = [], 0
            for k, (doc_id, drops) in enumerate(zip(part.column(0).to_pylist(), part.column(2).to_pylist())):
                text = data[offsets[k] : offsets[k + 1]].tobytes()
                n, lost = text.count(b"\n") + 1, 0
                if drops:
                    drops, kept = set(drops), []
                    for lines in pieces(text):
                        stay = [x for x in lines if digest_of(x, p.least_chars) not in drops]
                        lost += len(lines) - len(stay)
                        if stay:
                            kept.append(b"\n".join(stay))
                    text = b"\n".join(kept)
                held.append((doc_id, n, lost, text))
                size += len(text)
                if size > BATCH:
                    yield batch(held)
                    held, size = [], 0
            if held:
                yield batch(held)

    return run


def dropped_lines(docs: DataFrame, p: Lines = Lines()) -> DataFrame:
    """(doc_id, row, drops) of the rows that lose lines: the digests of the lines, and a hash of the text as row."""
    spark = docs.sparkSession
    marked = map_batches(docs.select("doc_id", "row", "text"), _marks(p), "doc_id bigint, row bigint, keys binary")
    marks = Written(marked.where(F.octet_length("keys") > 0))
    count = marks.frame.agg(F.sum(F.octet_length("keys").cast("bigint"))).first()[0] or 0
    words = words_for(count // DIGEST, p.most_bytes)
    twice = spark.sparkContext.broadcast(gathered(filters(marks.frame.select("keys"), words, DIGEST), words, "twice"))
    suspects = Written(
        map_batches(marks.frame.select("doc_id", "row", "keys"), _suspects(twice), "key binary, doc_id bigint, row bigint")
    )
    counts = suspects.frame.groupBy("key").agg(F.count("*").alias("n"), F.max("doc_id").alias("keeper"))
    shared = counts.where(F.col("n") >= p.least_docs).select("key", "keeper")
    lost = join_hot_key(suspects.frame, shared, ["key"]).where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    drops = Written(lost.groupBy("doc_id", "row").agg(F.collect_set("key").alias("drops")))
    marks.remove()
    suspects.remove()
    twice.unpersist()
    return drops.frame


def without_shared_lines(docs: DataFrame, p: Lines = Lines()) -> DataFrame:
    """Every row of docs (doc_id, text) without the lines that it shares with a larger doc_id.

    Columns: doc_id, n_lines (before), n_dropped and text.  A line's key is the line without white space (bytes 9
    to 13 and 32) at its ends and with A-Z lower-cased; keys of ``least_chars`` code points in ``least_docs`` rows
    lose all their lines except in the row of the largest doc_id that holds them, where every repeat stays.  A null
    or empty text is one empty line; a row that loses all lines has an empty text.  Each row counts as a document:
    rows that repeat a doc_id count each, and if theirs is the largest all of them keep the line; a row without
    doc_id comes after all others, and if only such rows hold a line they all keep it.  Lines are told apart by
    128-bit digests.  Other columns are ignored; an empty table gives no rows.  Texts are cut into lines a stretch at
    a time; a text is held twice, beside 16 bytes for each of its distinct lines.
    """
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(text).alias("row"), text.alias("text"))
    drops = dropped_lines(rows, p).select(F.col("doc_id").alias("of_id"), F.col("row").alias("of_row"), "drops")
    same = F.col("doc_id").eqNullSafe(F.col("of_id")) & (F.col("row") == F.col("of_row"))
    joined = rows.join(drops, same, "left").select("doc_id", "text", "drops")
    return map_batches(joined, _without(p), "doc_id bigint, n_lines bigint, n_dropped bigint, text string")
