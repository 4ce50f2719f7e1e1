"""Token ids as binary shards in training order, for reading on from any sequence.

Documents are dealt by a hash of their id and text to ranges of the training order, once.  In a range the ids of its
documents, by doc_id, each closed by an end id, form one stream that is cut into sequences of fixed length; only
the last is padded.  A keyed Feistel permutation with cycle-walking gives each sequence its place in the range,
and the sequences of the ranges before it are counted without moving any text, so each sequence has one global
slot and the slots have no gaps.  The task of a range writes its shard: records of a fixed stride in slot order.
Where a slot lies is arithmetic on a manifest of one row for each shard.  So ``write_shards`` shuffles within ranges.

``write_shuffled`` puts one permutation over the sequences of all ranges, so those of a document lie all over the
corpus.  Its sequences move a second time, to the shards of their global slots, group by group of shards.

The shards are written with Spark's own text writer, one record a line of raw bytes: it commits whole tasks, so
lost executors and second attempts leave no half shards, and it writes to whatever store Spark does.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from civicflow.llm.components import shared_folder
from civicflow.llm.words import mix
from civicflow.llm.workers import map_batches

#: Shards whose sequences are counted together before those of all groups are.
GROUP = 4096
#: Parts in which shuffled sequences move to their shards, one after another.
PARTS = 8
#: The setting by which the shuffles of a query are deleted at its end, not when the driver forgets them.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@dataclass(frozen=True)
class Layout:
    """Ids a sequence and bytes an id; the ids that end a document and fill up; bytes a shard; the key.

    The defaults are those of UTF-8 bytes as ids: 255 and 254 are in no UTF-8 text.
    """

    length: int = 2048
    width: int = 1
    end: int = 255
    pad: int = 254
    shard_bytes: int = 8_000_000
    key: int = 20240501

    @property
    def stride(self) -> int:
        """Bytes of a record: the ids and a line end."""
        return self.length * self.width + 1


def permute(index: np.ndarray, n: int, key: int, rounds: int = 6) -> np.ndarray:
    """The keyed permutation of 0 to n - 1: a Feistel network on the next even power of two, walked until below n."""
    half = max(1, ((n - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    start = np.uint64(key * 0x9E3779B97F4A7C15 % 2**64)
    keys = mix(np.arange(1, rounds + 1, dtype=np.uint64) + start)
    out = index.astype(np.uint64)
    walking = np.arange(len(out))
    while len(walking):
        left, right = out[walking] >> np.uint64(half), out[walking] & mask
        for k in keys:
            left, right = right, left ^ (mix(right ^ k) & mask)
        out[walking] = left << np.uint64(half) | right
        walking = walking[out[walking] >= np.uint64(n)]
    return out.astype(np.int64)


def _grids(batches: Iterator[pa.RecordBatch], p: Layout) -> Iterator[tuple[int, np.ndarray]]:
    """(range, sequences) of each range whose rows, as (range, ids), are in the batches."""
    kind = np.dtype(f"<u{p.width}")
    end = np.array([p.end], kind).tobytes()
    held: dict[int, list[bytes]] = {}
    for batch in batches:
        for of, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            held.setdefault(of, []).extend((ids or b"", end))
    for of, parts in held.items():
        raw = b"".join(parts)
        n = -(-len(raw) // (p.length * p.width))
        fill = np.array([p.pad], kind).tobytes() * (n * p.length - len(raw) // p.width)
        yield of, np.frombuffer(raw + fill, np.uint8).reshape(n, -1)


def _records(p: Layout):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for of, grid in _grids(batches, p):
            n = len(grid)
            order = np.empty(n, np.int64)
            order[permute(np.arange(n), n, p.key + of)] = np.arange(n)
            for at in range(0, n, 1024):
                some = [grid[k].tobytes() for k in order[at : at + 1024]]
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.binary())], names=["value"])

    return run


def _placed(p: Layout, total: int):
    """(slot, value) of each sequence; ``of`` is here the number of the range's first sequence among all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for of, grid in _grids(batches, p):
            slots = permute(of + np.arange(len(grid)), total, p.key)
            for at in range(0, len(grid), 1024):
                some = [row.tobytes() for row in grid[at : at + 1024]]
                columns = [pa.array(slots[at : at + 1024], pa.int64()), pa.array(some, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["slot", "value"])

    return run


def _ranged(docs: DataFrame, ids: Column, p: Layout) -> tuple[DataFrame, int, Column, Column]:
    """The rows as (doc_id, ids), the number of ranges, and each row's range and bytes."""
    key = F.col("doc_id").cast("bigint")
    rows = docs.select(key.alias("doc_id"), ids.alias("ids"))
    size = F.coalesce(F.octet_length("ids"), F.lit(0)) + p.width
    total = rows.agg(F.sum(size.cast("bigint"))).first()[0] or 0
    ranges = 1 + total // p.shard_bytes
    shard = F.pmod(F.xxhash64("doc_id", "ids", F.lit(p.key)), F.lit(ranges)).cast("int").alias("shard")
    return rows, ranges, shard, size


def _counted(rows: DataFrame, shard: Column, size: Column, p: Layout) -> DataFrame:
    """(shard, first_slot, n_sequences, n_ids, n_docs) of each range that has rows."""
    counts = rows.select(shard, size.cast("bigint").alias("size")).groupBy("shard")
    counts = counts.agg(F.sum("size").alias("bytes"), F.count("*").alias("n_docs"))
    counts = counts.withColumn("n_sequences", F.ceil(F.col("bytes") / (p.length * p.width)))
    # Sequences before a shard: those of the groups of shards before its group, and those before it in the group.
    counts = counts.withColumn("group", F.floor(F.col("shard") / GROUP))
    sums = counts.groupBy("group").agg(F.sum("n_sequences").alias("sum"))
    earlier = F.sum("sum").over(Window.orderBy("group").rowsBetween(Window.unboundedPreceding, -1))
    groups = sums.select("group", F.coalesce(earlier, F.lit(0)).alias("base"))
    before = Window.partitionBy("group").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    first = F.col("base") + F.coalesce(F.sum("n_sequences").over(before), F.lit(0))
    counts = counts.join(groups, "group")
    return counts.select(
        "shard", first.alias("first_slot"), "n_sequences", (F.col("bytes") / p.width).cast("bigint").alias("n_ids"), "n_docs"
    )


def write_shards(docs: DataFrame, ids: Column, path: str, p: Layout = Layout()) -> DataFrame:
    """Write the ids of every row of docs (doc_id, and what ``ids`` needs) to shards under a path; the manifest.

    ``ids`` is binary, little-endian, ``p.width`` bytes an id; null counts as none, so such a row is its end id.
    The manifest (shard, first_slot, n_sequences, n_ids, n_docs) is also written, under ``path/manifest``, and the
    shards are ``path/shards/part-*``, by number.  A row is dealt by its doc_id and its ids together, so rows that
    repeat a doc_id fill no shard; in a shard they stand by their ids' bytes.  A range without rows has no shard; an
    empty table has none.  A shard is as long as its rows, so one very long row makes a long shard.
    """
    spark = docs.sparkSession
    rows, ranges, shard, size = _ranged(docs, ids, p)
    dealt = rows.select(shard, "ids", "doc_id").repartitionById(ranges, "shard")
    ordered = dealt.sortWithinPartitions("shard", F.col("doc_id").asc_nulls_last(), "ids")
    lines = map_batches(ordered.select("shard", "ids"), _records(p), "value binary")
    records = lines.select(F.col("value").cast("string").alias("value"))
    # One file for a task, whatever the session's settings: a file's number is its shard's.
    records.write.option("maxRecordsPerFile", 0).text(f"{path}/shards", lineSep="\n")

    manifest = _counted(rows, shard, size, p)
    manifest.coalesce(1).write.parquet(f"{path}/manifest")
    return spark.read.parquet(f"{path}/manifest")


@contextmanager
def _cleaned_up(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(CLEAN_UP, None)
    spark.conf.set(CLEAN_UP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEAN_UP) if before is None else spark.conf.set(CLEAN_UP, before)


def write_shuffled(docs: DataFrame, ids: Column, path: str, p: Layout = Layout()) -> DataFrame:
    """Write the ids of every row as ``write_shards`` does, but in the order of one permutation over all slots.

    Sequences are cut from the streams of the ranges; those of all ranges are numbered through, and the slot of a
    sequence is where the one permutation of these numbers puts it.  A slot's shard and place follow from it.  The
    manifest is (shard, first_slot, n_sequences); (shard, first_slot, n_sequences, n_ids, n_docs) under
    ``path/ranges`` says which numbers a range's sequences have, by which its stream can be put together again.
    Slots do not hang on the partitions of docs.

    The numbers before a range come from a narrow pass.  The sequences are written once between their two moves, and
    move to their shards in ``PARTS`` parts, each deleted when its shards stand.
    """
    spark = docs.sparkSession
    rows, ranges, shard, size = _ranged(docs, ids, p)
    _counted(rows, shard, size, p).coalesce(1).write.parquet(f"{path}/ranges")
    table = spark.read.parquet(f"{path}/ranges")
    total = table.agg(F.sum("n_sequences")).first()[0] or 0
    each = max(1, p.shard_bytes // (p.length * p.width))
    shards = -(-total // each)
    step = max(1, -(-shards // PARTS))

    first = table.select("shard", F.col("first_slot").alias("first"))
    dealt = rows.select(shard, "ids", "doc_id").join(first, "shard").repartitionById(ranges, "shard")
    ordered = dealt.sortWithinPartitions("first", F.col("doc_id").asc_nulls_last(), "ids")
    placed = map_batches(ordered.select("first", "ids"), _placed(p, total), "slot bigint, value binary")
    between = f"{shared_folder(spark)}/sequences-{uuid.uuid4().hex}"
    with _cleaned_up(spark):
        parts = placed.withColumn("part", F.floor(F.col("slot") / (each * step)))
        parts.write.partitionBy("part").option("compression", "zstd").parquet(between)
        for at in range(0, shards, step):
            own = spark.read.schema("slot bigint, value binary").parquet(f"{between}/part={at // step}")
            own = own.withColumn("shard", (F.floor(F.col("slot") / each) - at).cast("int"))
            own = own.repartitionById(min(step, shards - at), "shard").sortWithinPartitions("slot")
            records = own.select(F.col("value").cast("string").alias("value"))
            records.write.option("maxRecordsPerFile", 0).text(f"{path}/shards/first={at}", lineSep="\n")
            _delete(spark, f"{between}/part={at // step}")
    _delete(spark, between)
    if not shards:
        spark.range(0).select(F.lit("").alias("value")).write.text(f"{path}/shards")
    slot = F.col("id") * each
    manifest = spark.range(shards).select(
        F.col("id").cast("int").alias("shard"), slot.alias("first_slot"), F.least(F.lit(each), F.lit(total) - slot).cast("bigint").alias("n_sequences")
    )
    manifest.coalesce(1).write.parquet(f"{path}/manifest")
    return spark.read.parquet(f"{path}/manifest")


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def read_slots(spark: SparkSession, path: str, p: Layout = Layout(), first: int = 0, last: int | None = None) -> DataFrame:
    """(slot, shard, ids) of the sequences from slot ``first`` to before ``last``, read from their shards only.

    Each file is one shard, read whole; a record is cut out by its place.  Sorted by slot this is the training order,
    and reading can go on from any slot.  A file that is not as long as its shard should be raises an error.
    """
    manifest = spark.read.parquet(f"{path}/manifest").where(F.col("first_slot") + F.col("n_sequences") > first)
    if last is not None:
        manifest = manifest.where(F.col("first_slot") < last)
    first_of = F.coalesce(F.nullif(F.regexp_extract("path", r"/first=(\d+)/[^/]*$", 1), F.lit("")).cast("int"), F.lit(0))
    number = first_of + F.regexp_extract("path", r"part-(\d+)[^/]*$", 1).cast("int")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{path}/shards")
    held = files.select(number.alias("shard"), "content", "length").join(manifest, "shard")
    wrong = F.raise_error(F.concat(F.lit("a file does not hold its shard: "), F.col("shard").cast("string")))
    whole = F.when(F.col("length") == F.col("n_sequences") * p.stride, F.col("content")).otherwise(wrong.cast("binary"))
    held = held.select("shard", "first_slot", "n_sequences", whole.alias("content"))
    places = F.sequence(F.lit(0).cast("bigint"), F.col("n_sequences") - 1)

    def records(content: Column) -> Column:
        return F.transform(places, lambda k: F.substring(content, (k * p.stride + 1).cast("int"), F.lit(p.stride - 1)))

    # Bound to a name once: a column of a row would be copied whole for each record cut from it.
    cut = F.transform(F.array("content"), records)[0]
    rows = held.select("shard", "first_slot", F.posexplode(cut).alias("place", "ids"))
    rows = rows.select((F.col("first_slot") + F.col("place")).alias("slot"), "shard", "ids")
    rows = rows.where(F.col("slot") >= first)
    return rows if last is None else rows.where(F.col("slot") < last)
