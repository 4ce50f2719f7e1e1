"""Near-duplicate documents: circulant MinHash, banding, exact Jaccard verification, connected components.

1. Every whole text becomes its set of word shingles (64-bit hashes).  Documents of equal sets form one class,
   however many they are, and only classes go on: a bigint ``node`` made from the set stands for each.
2. Circulant MinHash: the permutation sigma scrambles the set, and one more permutation pi, shifted on by one
   place for each coordinate, gives all coordinates.  Both are one-to-one maps of the 64-bit numbers, so no
   table of a permutation is kept.  ``rows`` coordinates form a band.
3. Classes that share a band are joined by candidate links in a star around the smallest node of the band's
   bucket, never as all pairs, and the stars' components are candidate groups.
4. The texts of a candidate group, one for each class, meet in one task, which intersects full sets.  A group too heavy for one task
   is dealt in blocks, and each two blocks meet in a task of their own, so nothing is capped or left out.
5. Verified links give components again; each takes the smallest doc_id in it.

A pair of similarity s lacks a common band with odds (1 - s**rows)**bands: below 1e-6 at 0.8 and the defaults.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civicflow.llm.components import components, kept_frame
from civicflow.llm.words import mix, windows, words
from civicflow.llm.workers import map_batches

#: Nodes of candidate groups up to which they are broadcast.
FEW_NODES = 200_000
#: Shingles worked on at once for the coordinates.
STRETCH = 1024
_SIGMA, _PI = np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB)


@dataclass(frozen=True)
class Near:
    """Parameters: words a shingle; least similarity in hundredths; bands and coordinates a band.

    ``block`` is the number of shingles of one side that a verifying task holds.
    """

    width: int = 5
    percent: int = 80
    bands: int = 35
    rows: int = 5
    block: int = 1_000_000


def shingle_set(hashes: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct shingles of a text's words; a shorter text is one shingle, a text without words none."""
    if not len(hashes):
        return hashes
    return np.unique(windows(hashes, min(width, len(hashes))))


def fingerprint(shingles: np.ndarray) -> bytes:
    """128 bits that stand for a set."""
    return blake2b(shingles.tobytes(), digest_size=16).digest()


def coordinates(shingles: np.ndarray, n: int) -> np.ndarray:
    """Circulant MinHash of a set: the k-th coordinate is the least pi(sigma(shingle) + k)."""
    least = np.full(n, np.uint64(2**64 - 1))
    shift = np.arange(n, dtype=np.uint64)[:, None]
    for at in range(0, len(shingles), STRETCH):
        x = mix(shingles[at : at + STRETCH] ^ _SIGMA) + shift
        x *= _PI
        x ^= x >> np.uint64(32)
        x *= _SIGMA
        np.minimum(least, x.min(axis=1), out=least)
    return least


def band_keys(least: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key for each band of so many coordinates."""
    grid = least.reshape(-1, rows)
    key = np.arange(len(grid), dtype=np.uint64)
    for k in range(rows):
        key = mix(key) + grid[:, k]
    return mix(key)


def _sketches(p: Near):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, high, low, keys = [], [], [], []
            for part in words(batch.column("_text"), lower=True):
                for k in range(part.last - part.first):
                    found = shingle_set(part.hashes[part.span(k)], p.width)
                    mark = np.frombuffer(fingerprint(found), np.int64)
                    size.append(len(found))
                    high.append(mark[0])
                    low.append(mark[1])
                    bands = band_keys(coordinates(found, p.bands * p.rows), p.rows) if len(found) else found
                    keys.append(bands.view(np.int64))
            ends = np.cumsum([0, *map(len, keys)])
            flat = np.concatenate(keys) if keys else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(n) for n in ("doc_id", "_row", "_text_key")),
                    pa.array(size, pa.int64()),
                    pa.array(high, pa.int64()),
                    pa.array(low, pa.int64()),
                    pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat)),
                ],
                names=["doc_id", "_row", "_text_key", "n_shingles", "mark", "node", "bands"],
            )

    return run


def _overlaps(one: list[np.ndarray], two: list[np.ndarray] | None, percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each set of ``one``, the sets of ``two`` (or the later ones of ``one``) that are similar enough."""
    other = one if two is None else two
    sizes = np.array([len(x) for x in other], np.int64)
    flat = np.concatenate(other)
    owner = np.repeat(np.arange(len(other)), sizes)
    order = np.lexsort((owner, flat))
    flat, owner = flat[order], owner[order]
    for k, mine in enumerate(one):
        lo, hi = np.searchsorted(flat, mine, "left"), np.searchsorted(flat, mine, "right")
        run = hi - lo
        where = np.repeat(lo - np.cumsum(run) + run, run) + np.arange(run.sum())
        common = np.bincount(owner[where], minlength=len(other))
        near = 100 * common >= percent * (len(mine) + sizes - common)
        if two is None:
            near[: k + 1] = False
        yield k, np.flatnonzero(near)


def _links(nodes: np.ndarray, sets: list[np.ndarray], first: np.ndarray, second: np.ndarray, percent: int):
    """Links (a, b) that span the verified components among these sets; first and second: rows of both sides."""
    parent = np.arange(len(nodes))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    same = first is second
    for k, near in _overlaps([sets[i] for i in first], None if same else [sets[i] for i in second], percent):
        a = root(first[k])
        for b in {root(x) for x in np.unique(parent[second[near]])}:
            if a != b:
                yield nodes[a], nodes[b]
                parent[max(a, b)] = min(a, b)
                a = min(a, b)


def _verify(p: Near):
    def group(key: tuple, rows: list[tuple]) -> Iterator[tuple[int, int]]:
        held: dict[int, tuple[int, np.ndarray]] = {}
        texts = pa.array([r[2] for r in rows], pa.large_string())
        for part in words(texts, lower=True):
            for k in range(part.last - part.first):
                node, block, _ = rows[part.first + k]
                found = shingle_set(part.hashes[part.span(k)], p.width)
                if np.frombuffer(fingerprint(found), np.int64)[1] == node:  # a row of this id may hold another text
                    held[node] = (block, found)
        nodes = np.array(sorted(held), np.int64)
        sets = [held[n][1] for n in nodes.tolist()]
        block = np.array([held[n][0] for n in nodes.tolist()], np.int64)
        first = np.flatnonzero(block == key[1])
        second = first if key[1] == key[2] else np.flatnonzero(block == key[2])
        if len(first) and len(second):
            yield from _links(nodes, sets, first, second, p.percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []
        for batch in batches:
            out: list[tuple[int, int]] = []
            for comp, i, j, node, block, text in zip(*(c.to_pylist() for c in batch.columns)):
                if key != (comp, i, j):
                    out += group(key, rows) if rows else []
                    key, rows = (comp, i, j), []
                rows.append((node, block, text))
            yield _pairs(out)
        if rows:
            yield _pairs(list(group(key, rows)))

    return run


def _pairs(out: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([int(x[k]) for x in out], pa.int64()) for k in (0, 1)], names=["a", "b"]
    )


def _row_key(doc_id: Column, text: Column) -> Column:
    """The id of a row; rows without doc_id go by their text."""
    return F.coalesce(doc_id.cast("bigint"), F.xxhash64(text))


def near_groups(docs: DataFrame, p: Near = Near()) -> tuple[DataFrame, DataFrame]:
    """The sketches of all rows and, for each node, its component.

    Sketches: (doc_id, _row, _text_key, n_shingles, mark, node); one row for each of docs.
    Components: (node, label, component_id, first) with the smallest doc_id of the component, or null if none of
    its rows has one, and ``first``, a struct (no_id, _row, _text_key) that marks the row standing for it.
    """
    text = F.col("text")
    source = docs.select("doc_id", _row_key(F.col("doc_id"), text).alias("_row"), text.alias("_text"))
    source = source.withColumn("_text_key", F.xxhash64("_text"))
    names = "doc_id bigint, _row bigint, _text_key bigint, n_shingles bigint, mark bigint, node bigint"
    read = source.select(F.col("doc_id").cast("bigint"), "_row", "_text_key", "_text")
    sketches = kept_frame(map_batches(read, _sketches(p), f"{names}, bands array<bigint>"))

    full = sketches.where("n_shingles > 0")
    no_id = F.col("doc_id").isNull().alias("no_id")
    classes = full.groupBy("node", "mark").agg(
        F.min("doc_id").alias("doc_id"),
        F.min(F.struct(no_id, "_row", "_text_key")).alias("first"),
        F.first("n_shingles").alias("n_shingles"),
        F.first("bands").alias("bands"),
    )
    banded = classes.select("node", F.explode("bands").alias("band"))
    hubs = banded.groupBy("band").agg(F.min("node").alias("b"), F.max("node").alias("far")).where("b < far")
    stars = banded.join(hubs.select("band", "b"), "band").select(F.col("node").alias("a"), "b")
    groups = components(stars)

    plain = classes.select("node", "doc_id", "first", "n_shingles")
    links = kept_frame(_verified(source, plain, groups, p))
    found = components(links)
    labelled = plain.join(found, "node", "left").withColumn("label", F.coalesce("root", "node"))
    least = labelled.groupBy("label").agg(F.min("doc_id").alias("component_id"), F.min("first").alias("first"))
    return sketches.drop("bands"), labelled.select("node", "label").join(least, "label")


def _verified(source: DataFrame, plain: DataFrame, groups: DataFrame, p: Near) -> DataFrame:
    """Links (a, b) between nodes of one candidate group whose full sets are similar enough.

    A node's text is that of one row: rows equal in id and text are folded before the shuffle.
    """
    keys = ["_row", "_text_key"]
    marks = [F.col(f"first.{k}").alias(k) for k in keys]
    members = plain.join(groups, "node").select("node", F.col("root").alias("group"), *marks, "n_shingles")
    weight = members.groupBy("group").agg(F.ceil(F.sum("n_shingles") / p.block).cast("int").alias("blocks"))
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block")
    members = kept_frame(members.join(weight, "group").select("group", "node", *keys, "blocks", block))
    texts = source.select(*keys, "_text")
    if members.count() <= FEW_NODES:
        members = F.broadcast(members)
        texts = texts.join(members.select(*keys), keys, "left_semi")
    texts = texts.groupBy(*keys).agg(F.first("_text").alias("_text"))
    meets = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1),
        lambda x: F.struct(F.least(x, "block").alias("i"), F.greatest(x, "block").alias("j")),
    )
    rows = texts.join(members, keys).withColumn("meet", F.explode(meets))
    rows = rows.select("group", "meet.i", "meet.j", "node", "block", "_text")
    rows = rows.repartition("group", "i", "j").sortWithinPartitions("group", "i", "j")
    return map_batches(rows, _verify(p), "a bigint, b bigint")


def near_duplicates(docs: DataFrame, p: Near = Near()) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of docs (doc_id, text; more columns are ignored).

    ``n_shingles`` is the size of the whole text's set; documents whose sets overlap enough are linked, and
    ``component_id`` is the smallest doc_id reachable, the row's own included; ``kept`` says that it is the
    row's own.  A text that is null, empty or without words has no shingles, is linked with nothing and kept.
    Rows that repeat a doc_id stay rows of their own.  A row without doc_id takes part; its component_id is null
    if no row of its component has a doc_id, and it is not kept.  An empty table gives no rows.
    """
    sketches, groups = near_groups(docs, p)
    out = sketches.join(groups.select("node", "label", F.col("component_id").alias("c")), "node", "left")
    component = F.when(F.col("label").isNull(), F.col("doc_id")).otherwise(F.col("c"))
    out = out.select("doc_id", "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def without_near_duplicates(docs: DataFrame, p: Near = Near()) -> DataFrame:
    """The rows of docs, all columns, with one row left of each component: its smallest doc_id.

    Rows without words all stay.  Rows equal in doc_id and text count as one document, of which one stays.  If
    no row of a component has a doc_id, the row whose text has the least hash stays.  Names of docs that start
    with ``_near_`` are not for use.
    """
    sketches, groups = near_groups(docs, p)
    empty = sketches.where("n_shingles = 0").select("_row", "_text_key", F.col("doc_id").isNull().alias("no_id"))
    stay = groups.select("first._row", "first._text_key", "first.no_id").union(empty)
    stay = stay.toDF("_near_0", "_near_1", "_near_2").distinct()
    mark = [_row_key(F.col("doc_id"), F.col("text")), F.xxhash64("text"), F.col("doc_id").isNull()]
    held = docs.select(*(f"`{c}`" for c in docs.columns), *(m.alias(f"_near_{k}") for k, m in enumerate(mark)))
    held = held.join(stay, [f"_near_{k}" for k in range(3)], "left_semi")
    once = held.dropDuplicates([f"_near_{k}" for k in range(3)])
    return once.select(*(f"`{c}`" for c in docs.columns))
