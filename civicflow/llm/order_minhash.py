"""Order MinHash fingerprints: sketches that feel the order of a text, not only its content.

Every character k-mer of a text is numbered by its occurrence, so that the second "the" differs from the first,
and hashed.  The m orders of the method are rotations of one random order: order j starts at the j-th m-th of
the circle of hashes.  Each takes the next few numbered k-mers from its start, puts them back in text order and
hashes the tuple.  A fingerprint is the 16-bit tuple hashes one after the other, in hex; the likeness of two
fingerprints is the share of equal ones, which falls with the edit distance.

To set each document beside the next one, rows go once to range buckets of doc_id, of which each also gets the
first row of the bucket after it; inside a bucket rows are streamed in order, two held at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civicflow.llm.workers import map_batches
from civicflow.llm.words import mix

_STEP = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)]


@dataclass(frozen=True)
class Sketch:
    """k characters (a power of two) a k-mer, m orders, and how many k-mers an order takes."""

    k: int = 8
    m: int = 128
    taken: int = 2


def _kmers(codes: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k characters from each position on; past the end they count as zeros."""
    x = np.zeros(len(codes) + k, np.uint64)
    x[: len(codes)] = codes
    x = mix(x + _STEP[0])
    width, turn = 1, 0
    while width < k:
        x = x[:-width] * _STEP[turn % 4] + x[width:]
        x ^= x >> np.uint64(29)
        width, turn = 2 * width, turn + 1
    return mix(x[: len(codes)])


def fingerprint(text: str, s: Sketch = Sketch()) -> np.ndarray:
    """The m tuple hashes of a text, 16 bits each; all zero for an empty one."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    n = len(codes)
    if not n:
        return np.zeros(s.m, np.uint16)
    kmer = _kmers(codes, s.k)
    bits = np.uint64(max(20, n.bit_length()))
    low = (np.uint64(1) << bits) - np.uint64(1)
    order = np.sort((kmer & ~low) | np.arange(n, dtype=np.uint64))  # by k-mer, then by position
    at = (order & low).astype(np.int64)
    opens = np.ones(n, bool)
    opens[1:] = (order[1:] & ~low) != (order[:-1] & ~low)
    start = np.flatnonzero(opens)
    number = np.arange(n) - np.repeat(start, np.diff(np.append(start, n)))
    ring = np.sort((mix(kmer[at] + number.astype(np.uint64) * _STEP[1]) & ~low) | order & low)
    starts = np.arange(s.m, dtype=np.uint64) * np.uint64(2**64 // s.m)
    first = np.searchsorted(ring, starts)
    places = np.sort((ring[(first[:, None] + np.arange(s.taken)) % n] & low).astype(np.int64), axis=1)
    whole = np.full(s.m, np.uint64(s.k))
    for c in range(s.taken):
        whole = mix(whole * _STEP[2] + kmer[places[:, c]])
    return np.maximum(whole >> np.uint64(48), np.uint64(1)).astype(np.uint16)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal tuple hashes; two empty texts are alike, an empty and another one are not at all."""
    return float(np.count_nonzero(a == b)) / len(a)


def as_hex(marks: np.ndarray) -> str:
    """A fingerprint as text."""
    return marks.astype(">u2").tobytes().hex()


def from_hex(text: str) -> np.ndarray:
    """A fingerprint back from its text."""
    return np.frombuffer(bytes.fromhex(text), ">u2")


def edited(text: str, following: str) -> str:
    """The text with its last half replaced by as many characters, or all, of the start of the following one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _cuts(docs: DataFrame, buckets: int) -> list[int]:
    """Ids that cut docs into about even ranges; at most one less than buckets."""
    if buckets < 2:
        return []
    share = [k / buckets for k in range(1, buckets)]
    found = docs.agg(F.percentile_approx(F.col("doc_id").cast("bigint"), share, max(10_000, 20 * buckets))).first()[0]
    return sorted(set(found or []))


def _bucket(doc_id: Column, cuts: list[int]) -> Column:
    """How many cuts are above an id, so that buckets rise as ids fall; an id that is null comes after all.

    The cuts stand in blocks of about the root of their number, so few are compared for a row.
    """
    if not cuts:
        return F.lit(0)
    size = max(1, int(len(cuts) ** 0.5))
    blocks = [cuts[k : k + size] for k in range(0, len(cuts), size)]
    bigint = lambda xs: F.array(*(F.lit(x).cast("bigint") for x in xs))
    block = F.size(F.filter(bigint([b[-1] for b in blocks]), lambda c: c <= doc_id))
    within = F.get(F.array(*(bigint(b) for b in blocks)), block)
    below = block * size + F.size(F.filter(F.coalesce(within, bigint([])), lambda c: c <= doc_id))
    return F.when(doc_id.isNull(), F.lit(len(cuts))).otherwise(F.lit(len(cuts)) - below).cast("int")


def with_next(docs: DataFrame, buckets: int) -> DataFrame:
    """Every row (bucket, guest, doc_id, text) in order by falling doc_id, and each bucket's follower as a guest.

    Rows come sorted by bucket, guest, falling doc_id (null last) and text.  The guest of a bucket is the first
    row of the next bucket that has rows; after the last comes the first.  Only the ids of the buckets' first
    rows come to the driver, at most one for each bucket.
    """
    columns = [F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")]
    rows = docs.select(*columns).withColumn("bucket", _bucket(F.col("doc_id"), _cuts(docs, buckets)))
    heads = rows.groupBy("bucket").agg(F.max("doc_id").alias("head")).collect()
    heads.sort(key=lambda r: r.bucket)
    guests = [(r.head, heads[k - 1].bucket) for k, r in enumerate(heads)]
    table = rows.sparkSession.createDataFrame(guests, "head bigint, host int")
    rows = rows.join(F.broadcast(table), F.col("doc_id").eqNullSafe(F.col("head")), "left")
    seat = lambda bucket, guest: F.struct(bucket.alias("bucket"), F.lit(guest).alias("guest"))
    seats = F.array(seat(F.col("bucket"), False), seat(F.col("host"), True))
    seats = F.when(F.col("host").isNull(), F.slice(seats, 1, 1)).otherwise(seats)
    rows = rows.select(F.explode(seats).alias("seat"), "doc_id", "text").select("seat.*", "doc_id", "text")
    order = ["bucket", "guest", F.col("doc_id").desc_nulls_last(), "text"]
    return rows.repartitionById(buckets, "bucket").sortWithinPartitions(*order)


SCHEMA = (
    "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)


def _compare(s: Sketch):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        waiting = None  # bucket, doc_id, text, fingerprint
        for batch in batches:
            out: list[tuple] = []
            for bucket, guest, doc_id, text in zip(*(c.to_pylist() for c in batch.columns)):
                if guest and (waiting is None or waiting[0] != bucket):
                    continue  # of guests that share an id only the first counts
                text = text or ""
                marks = fingerprint(text, s)
                if waiting is not None and waiting[0] == bucket:
                    _, own_id, own, own_marks = waiting
                    new = edited(own, text)
                    new_marks = own_marks if new == own else fingerprint(new, s)
                    sha = sha256(new.encode()).hexdigest()
                    near = likeness(own_marks, new_marks), likeness(own_marks, marks)
                    out.append((own_id, len(own), sha, as_hex(own_marks), as_hex(new_marks), *near))
                waiting = None if guest else (bucket, doc_id, text, marks)
            columns = zip(*out) if out else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)

    return run


def fingerprints(docs: DataFrame, s: Sketch = Sketch(), buckets: int | None = None) -> DataFrame:
    """Fingerprints of every row of docs (doc_id, text) and of its edited text, and their likeness.

    Columns: doc_id, n_chars (code points), edited_sha256 (of the edited text in UTF-8), fingerprint,
    edited_fingerprint, near_edited (likeness of the text and its edited text) and near_next (of the text and
    the next row's).  The next row is the one with the next smaller doc_id; after the last comes the first.  Rows
    that repeat a doc_id follow one another by text; rows without one come last.  A null text counts as empty.
    A table of one row is its own next.  Other columns are ignored; an empty table gives no rows.  ``buckets`` is
    the number of range buckets, by default the session's number of shuffle partitions.
    """
    if buckets is None:
        buckets = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return map_batches(with_next(docs, buckets), _compare(s), SCHEMA)
