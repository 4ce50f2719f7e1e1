"""Spelling variants: words one edit apart, each tied to a much more frequent form.

1. Runs of letters are cut out of whole texts as arrays and counted: by task and slice first, then by word.  Given a
   noise rule, some runs of a document lose a letter before they count.
2. Reduced alphabet: letters are hashed to a few symbols.  Frequent letters are spread over different symbols, by
   their counts in the vocabulary; the number of symbols grows with the seventh root of the vocabulary, so reduced
   words stay about as rare as words.
3. Every word generates the full one-edit neighbourhood of its reduced word, as hashes, each once.  Those that no
   reduced word has are left out by a Bloom filter of the reduced vocabulary, the others join it.
4. A join verifies each candidate on the original strings.  Reduced words that many words share are joined by one
   more key, a deletion variant of the original string, which two words one edit apart always share.
5. Near words are summed up for each word, and forms are followed to their roots by doubling.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civicflow.llm.bitmaps import filters, gathered, maybe_in, words_for
from civicflow.llm.components import Written
from civicflow.llm.words import LOWER, buffers, mix, powers, slices
from civicflow.llm.workers import map_batches

#: Bytes of text whose runs are counted together; runs up to so many bytes are checked side by side.
PIECE, SHORT = 4 << 20, 64

LETTER = np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = True

_BYTE = np.random.default_rng(20250313).integers(1, 2**64, 256, dtype=np.uint64)


@dataclass(frozen=True)
class Variants:
    """Code points and occurrences of a word at least; how many times as frequent its form is; every how manieth run
    loses a letter (0: none); words that share a reduced word before one more key is used; bytes of a filter."""

    least_chars: int = 6
    least_n: int = 5
    times: int = 5
    noise: int = 0
    crowd: int = 64
    most_bytes: int = 64 << 20


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


CRC = _crc_table()


def letter_runs(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of A-Z, a-z and U+00C0 to U+00FF, which in UTF-8 are 0xC3 and one byte more."""
    lead = data == 0xC3
    held = np.zeros(len(data) + 2, bool)
    held[1:-1] = LETTER[data] | lead
    held[2:-1] |= lead[:-1]
    edge = np.flatnonzero(held[1:] != held[:-1])
    return edge[::2], edge[1::2]


def run_crcs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, before: np.ndarray) -> np.ndarray:
    """crc32 of each run, going on from the crc32 of what stands before it."""
    out = before.astype(np.uint32) ^ np.uint32(0xFFFFFFFF)
    order = np.argsort(starts - ends, kind="stable")  # long runs first, so those still open are a prefix
    size = (ends - starts)[order]
    state, at = out[order], starts[order]
    for k in range(min(int(size[0]), SHORT) if len(size) else 0):
        n = int(np.searchsorted(-size, -k, "left"))
        state[:n] = CRC[(state[:n] ^ data[at[:n] + k]) & np.uint32(255)] ^ (state[:n] >> np.uint32(8))
    out[order] = state ^ np.uint32(0xFFFFFFFF)
    for k in np.flatnonzero(ends - starts > SHORT).tolist():
        out[k] = crc32(data[starts[k] : ends[k]].tobytes(), int(before[k]))
    return out


def _hash_runs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run of bytes."""
    place = np.arange(len(data)) - np.repeat(starts, np.diff(np.append(starts, len(data))))
    value = _BYTE[data] * powers(int(place.max()) + 1)[place]
    total = np.concatenate([[np.uint64(0)], np.cumsum(value, dtype=np.uint64)])
    return mix(total[ends] - total[starts])


def _count(data: np.ndarray, cuts: np.ndarray, ids: list[int | None], p: Variants) -> tuple[list[bytes], list[int]]:
    """Words of documents that start at the cuts, in lower-cased bytes, and how often each occurs."""
    starts, ends = letter_runs(data)
    inside = cuts[1:-1]
    split = inside[(np.searchsorted(starts, inside) != np.searchsorted(ends, inside, "right"))]
    starts = np.sort(np.concatenate([starts, split]))  # a run goes over the end of a document into the next one
    ends = np.sort(np.concatenate([ends, split]))
    lead = np.concatenate([[0], np.cumsum(data == 0xC3)])
    long = ends - starts - (lead[ends] - lead[starts]) >= p.least_chars
    starts, ends = starts[long], ends[long]
    if not len(starts):
        return [], []
    words, counts = [], []
    keep = np.ones(len(starts), bool)
    if p.noise:
        prefix = np.array([crc32(f"{'' if i is None else i}:".encode()) for i in ids], np.uint32)
        crc = run_crcs(data, starts, ends, prefix[np.searchsorted(cuts, starts, "right") - 1])
        hit = np.flatnonzero(crc % np.uint32(p.noise) == 0)
        keep[hit] = False
        for k in hit.tolist():
            word = data[starts[k] : ends[k]].tobytes().decode()
            at = int(crc[k]) % len(word)
            if len(word) > p.least_chars:
                words.append((word[:at] + word[at + 1 :]).encode())
                counts.append(1)
    starts, ends = starts[keep], ends[keep]
    if len(starts):
        first = int(starts[0])  # hashes run from the first word on
        _, at, n = np.unique(_hash_runs(data[first:], starts - first, ends - first), return_index=True, return_counts=True)
        words += [data[a:b].tobytes() for a, b in zip(starts[at].tolist(), ends[at].tolist())]
        counts += n.tolist()
    return words, counts


def _pieces(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """First and last document and first and last byte of the pieces of texts; a long text is cut between runs."""
    for first, last in slices(offsets, PIECE):
        a, end = int(offsets[first]), int(offsets[last])
        while end - a > 2 * PIECE:  # one long document
            b = a + PIECE
            while b < end:
                part = data[b : b + PIECE]
                gap = np.flatnonzero((part < 0x80) & ~LETTER[part])
                if len(gap):
                    b += int(gap[0])
                    break
                b = min(b + PIECE, end)
            yield first, last, a, b
            a = b
        yield first, last, a, end


def _words(p: Variants):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column(1))
            ids = batch.column(0).to_pylist()
            for first, last, a, b in _pieces(data, offsets):
                cuts = np.clip(offsets[first : last + 1] - a, 0, b - a)
                words, counts = _count(LOWER[data[a:b]], cuts, ids[first:last], p)
                words = pa.array(words, pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([words, pa.array(counts, pa.int64())], names=["word", "n"])

    return run


def vocabulary(docs: DataFrame, p: Variants) -> DataFrame:
    """(word, n) of the words of docs (doc_id, text) that are long and frequent enough."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counted = map_batches(rows, _words(p), "word string, n bigint")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= p.least_n)


def symbols_of(letters: dict[str, int], symbols: int) -> dict[int, int]:
    """A symbol for each letter: the most frequent one first, to the symbol with the fewest letters in words so far."""
    load, out = [0] * symbols, {}
    for letter, n in sorted(letters.items(), key=lambda x: (-x[1], x[0])):
        k = load.index(min(load))
        load[k] += n
        out[ord(letter)] = k + 1
    return out


def neighbourhood(codes: np.ndarray, symbols: int) -> np.ndarray:
    """Distinct hashes of reduced words (rows of codes, all of one length) and of all that are one edit away.

    Column 0 is the reduced word itself; hashes that repeat an earlier one of the row are 0.
    """
    n, size = codes.shape
    power = powers(size + 2)
    value = codes.astype(np.uint64)
    left = np.zeros((n, size + 1), np.uint64)  # hash of the first k symbols
    left[:, 1:] = np.cumsum(value * power[:size], axis=1, dtype=np.uint64)
    right = left[:, -1:] - left  # of the others, where they stand
    kinds = np.arange(1, symbols + 1, dtype=np.uint64)
    shorter = left[:, :-1] + _shift(value, power, size, -1)
    replaced = (left[:, :-1] + right[:, 1:])[:, :, None] + (power[:size, None] * kinds)[None]
    longer = (left + _shift(value, power, size, 1))[:, :, None] + (power[: size + 1, None] * kinds)[None]
    parts = [(left[:, -1:], size), (shorter, size - 1), (replaced.reshape(n, -1), size), (longer.reshape(n, -1), size + 1)]
    found = np.concatenate([mix(h + powers(k + 2)[k + 1]) for h, k in parts], axis=1)
    found[found == 0] = 1
    order = np.argsort(found, axis=1, kind="stable")
    ranked = np.take_along_axis(found, order, axis=1)
    again = np.zeros(found.shape, bool)
    np.put_along_axis(again, order[:, 1:], ranked[:, 1:] == ranked[:, :-1], axis=1)
    found[again] = 0
    return found


def _shift(value: np.ndarray, power: np.ndarray, size: int, by: int) -> np.ndarray:
    """Hash of the symbols from k on, one place to the right (k up to size), or of those after k one to the left."""
    if by > 0:
        moved = np.cumsum((value * power[1 : size + 1])[:, ::-1], axis=1, dtype=np.uint64)[:, ::-1]
        return np.concatenate([moved, np.zeros((len(value), 1), np.uint64)], axis=1)
    moved = np.zeros(value.shape, np.uint64)
    moved[:, :-1] = np.cumsum((value[:, 1:] * power[: size - 1])[:, ::-1], axis=1, dtype=np.uint64)[:, ::-1]
    return moved


def reduced(words: pa.Array, symbol: dict[int, int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows and codes of the reduced words, those of one length together and few enough at once."""
    held = [w.translate(symbol) for w in words.to_pylist()]
    size = np.array([len(w) for w in held])
    for k in np.unique(size):
        rows = np.flatnonzero(size == k)
        some = max(1, (1 << 14) // int(k) ** 2)
        for at in range(0, len(rows), some):
            here = rows[at : at + some]
            codes = np.array([np.frombuffer(held[i].encode("utf-32-le"), np.uint32) for i in here])
            yield here, codes


def _keys(symbol: dict[int, int], symbols: int, known=None):
    """(word, n, key) of the reduced words, or of their neighbours that may be known."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, codes in reduced(batch.column(0), symbol):
                if known is None:
                    keys, of = neighbourhood(codes, 0)[:, 0], rows
                else:
                    found = neighbourhood(codes, symbols)
                    row, place = np.nonzero((found != 0) & maybe_in(known.value, found.ravel()).reshape(found.shape))
                    keys, of = found[row, place], rows[row]
                words, n = (batch.column(k).take(pa.array(of)) for k in (0, 1))
                yield pa.RecordBatch.from_arrays([words, n, pa.array(keys.view(np.int64))], names=["word", "n", "key"])

    return run


def _deletions(word: Column) -> Column:
    """Hashes of a string and of its strings with one letter less, each once."""
    less = F.transform(
        F.sequence(F.lit(1), F.char_length(word)),
        lambda k: F.xxhash64(F.concat(F.substring(word, F.lit(1), k - 1), F.substring(word, k + 1, F.char_length(word)))),
    )
    return F.array_distinct(F.concat(F.array(F.xxhash64(word)), less))


def near_pairs(words: DataFrame, p: Variants) -> DataFrame:
    """(word, near, near_n) for every word of words (word, n) and every other one edit away."""
    spark = words.sparkSession
    size = words.count()
    symbols = min(16, max(4, round(size ** (1 / 7))))
    letters = words.select(F.explode(F.split("word", "")).alias("letter")).groupBy("letter").count()
    symbol = symbols_of({r.letter: r["count"] for r in letters.collect() if r.letter}, symbols)  # the alphabet's size
    own = Written(map_batches(words.select("word", "n"), _keys(symbol, symbols), "word string, n bigint, key bigint"))
    space = words_for(size, p.most_bytes)
    known = gathered(filters(own.frame.select("key"), space), space, "once")
    shared = spark.sparkContext.broadcast(known)
    found = map_batches(words.select("word", "n"), _keys(symbol, symbols, shared), "word string, n bigint, key bigint")
    crowds = own.frame.groupBy("key").count().where(F.col("count") > p.crowd).select("key", F.lit(True).alias("crowded"))

    def dealt(side: DataFrame) -> DataFrame:
        marked = side.join(crowds, "key", "left")
        variants = F.when(F.col("crowded"), _deletions(F.col("word"))).otherwise(F.array(F.lit(0).cast("bigint")))
        return marked.select("key", "word", "n", F.explode(variants).alias("variant"))

    there = dealt(own.frame).select("key", "variant", F.col("word").alias("near"), F.col("n").alias("near_n"))
    pairs = dealt(found).drop("n").join(there, ["key", "variant"])
    return pairs.where(F.levenshtein("word", "near", 1) == 1).select("word", "near", "near_n")


def followed(words: DataFrame) -> DataFrame:
    """words (word, form, ...) with the last word that following the forms leads to as ``root``.

    Forms must not lead round in a circle; each round doubles how far a word sees, so rounds are few.
    """
    held = Written(words.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root")))
    moving = True
    while moving:
        ahead = held.frame.select(F.col("word").alias("root"), F.col("root").alias("further"))
        seen = held.frame.select("word", "root").join(ahead, "root", "left")
        moved = Written(seen.select("word", F.coalesce("further", "root").alias("root"), "further"))
        held.remove()
        held = moved
        moving = not held.frame.where(F.col("further").isNotNull()).isEmpty()
    return words.join(held.frame.select("word", "root"), "word", "left").withColumn("root", F.coalesce("root", "word"))


def spelling_variants(docs: DataFrame, p: Variants = Variants()) -> DataFrame:
    """The words of docs (doc_id, text), and of each the form and the root it is a variant of.

    Words are runs of A-Z, a-z and U+00C0 to U+00FF with A-Z lower-cased, of ``least_chars`` code points and
    ``least_n`` occurrences over all rows.  Columns: word; form, the near word (one code point inserted, deleted or
    replaced) that occurs most, the first in code-point order among equals, if it occurs ``times`` times as often as
    the word, else null; root, where the forms lead to, the word itself if it has none; n; n_near, the number of near
    words; form_n.  With ``noise``, a run whose crc32 of ``<doc_id>:<run>`` it divides loses one letter first (a
    missing doc_id counts as empty there).  A null or empty text has no words; repeated rows count each; other
    columns are ignored; an empty table gives no rows.  A long text is counted a piece at a time.
    """
    words = Written(vocabulary(docs, p))
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near")))
    near = near_pairs(words.frame, p).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    joined = words.frame.join(near, "word", "left")
    top = -F.col("best.less")
    good = top >= p.times * F.col("n")
    forms = Written(
        joined.select(
            "word",
            F.when(good, F.col("best.near")).alias("form"),
            "n",
            F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"),
            F.when(good, top).alias("form_n"),
        )
    )
    return followed(forms.frame).select("word", "form", "root", "n", "n_near", "form_n")
