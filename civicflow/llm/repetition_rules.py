"""Quality rules: plain counts of a text, and repetition found with a suffix array of its words.

The words of a run of documents form one sequence with a closing mark of its own after each document, so no
repeat crosses two documents.  Prefix doubling sorts the suffixes: they are ranked by their first word, then by
two, four and so on, and only suffixes that still tie go on.  The ranks of every fourth round give the longest
common prefix of two neighbours of the sorted array.  The deepest interval of common prefixes around a suffix is a
maximal repeated substring, as long as the longer of its two common prefixes; the spans of all that are long
enough are united, and the share of words they cover and the longest of them are limited.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civicflow.llm.words import SEPARATOR, Words, lines, mix, words
from civicflow.llm.workers import give_back, ship

SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True


@dataclass(frozen=True)
class Limits:
    """Least words of a text; window of the plain rule and the share of words, in hundredths, it may cover; least
    words of a repeated substring, the share that these may cover, and the most words of the longest."""

    least_words: int = 20
    window: int = 8
    window_percent: int = 30
    repeat: int = 5
    covered_percent: int = 30
    longest: int = 60


#: Of the rounds of prefix doubling, every so manieth is kept for the common prefixes.
KEPT_ROUND = 4


def suffix_ranks(codes: np.ndarray) -> tuple[list[tuple[int, np.ndarray]], np.ndarray]:
    """(codes that count, ranks of all suffixes by these) of every fourth round, and the ranks by all codes.

    Ties share the place of the first of them.  No two suffixes that tie may reach the end of the array.  What is
    kept are 4 bytes a code for each power of 16 that the longest repeat reaches, so memory follows the text.
    """
    small = np.int32 if len(codes) < 2**31 else np.int64
    order = np.argsort(codes, kind="stable")
    opens = np.ones(len(codes), bool)
    opens[1:] = codes[order[1:]] != codes[order[:-1]]
    rank = np.empty(len(codes), small)
    rank[order] = np.flatnonzero(opens)[np.cumsum(opens) - 1]
    del order, opens
    size = np.bincount(rank, minlength=len(codes) + 1)
    tied = np.flatnonzero(size[rank] > 1)
    del size
    kept, width, turn = [], 1, 0
    while len(tied):
        if turn % KEPT_ROUND == 0:
            kept.append((width, rank.copy()))
        key = rank[tied] * np.int64(len(codes)) + rank[tied + width]
        order = np.argsort(key)
        tied, key = tied[order], key[order]
        del order
        group = rank[tied]
        opens = np.ones(len(tied), bool)
        opens[1:] = key[1:] != key[:-1]
        del key
        new_group = np.ones(len(tied), bool)
        new_group[1:] = group[1:] != group[:-1]
        first = np.flatnonzero(opens).astype(small)[np.cumsum(opens, dtype=small) - 1]
        first -= np.flatnonzero(new_group).astype(small)[np.cumsum(new_group, dtype=small) - 1]
        rank[tied] = group + first
        opens[:-1] &= opens[1:]
        tied = tied[~opens]
        width *= 2
        turn += 1
    return kept, rank


def common_prefixes(kept: list[tuple[int, np.ndarray]], array: np.ndarray) -> np.ndarray:
    """The length of the longest common prefix of each two neighbours of the suffix array."""
    common = np.zeros(max(len(array) - 1, 0), np.int64)
    for width, rank in reversed(kept):
        still = np.arange(len(common))
        while len(still):  # fewer than 16 turns, as all longer prefixes have been walked already
            here = common[still]
            still = still[rank[array[still] + here] == rank[array[still + 1] + here]]
            common[still] += width
    return common


def longest_repeats(part: Words) -> np.ndarray:
    """For each word of a run of documents, the length in words of the longest repeated substring from it on."""
    docs = part.last - part.first
    n = len(part.hashes)
    of = np.repeat(np.arange(docs), np.diff(part.of_doc))
    salt = mix(np.arange(1, docs + 1, dtype=np.uint64))
    place = np.arange(n) + of  # each earlier document has a closing mark
    codes = np.empty(n + docs, np.uint64)
    codes[place] = mix(part.hashes ^ salt[of])
    codes[part.of_doc[1:] + np.arange(docs)] = mix(~salt)
    kept, rank = suffix_ranks(codes)
    array = np.empty(len(codes), np.int64)
    array[rank] = np.arange(len(codes))
    common = common_prefixes(kept, array)
    best = np.zeros(len(codes), np.int64)
    best[array[:-1]] = common
    best[array[1:]] = np.maximum(best[array[1:]], common)
    return best[place]


def covered(best: np.ndarray, of_doc: np.ndarray, least: int) -> np.ndarray:
    """Words of each document inside a repeated substring of at least so many words."""
    step = np.zeros(len(best) + 1, np.int64)
    at = np.flatnonzero(best >= least)
    step[at] += 1
    np.subtract.at(step, at + best[at], 1)
    inside = np.append(0, np.cumsum(np.cumsum(step[:-1]) > 0))
    return inside[of_doc[1:]] - inside[of_doc[:-1]]


def measure(texts: pa.Array, p: Limits) -> dict[str, np.ndarray]:
    """All counts of each whole text; null counts as empty."""
    out: dict[str, list[np.ndarray]] = {}
    for part in words(texts, lower=False):
        data, cuts, docs = part.data, part.cuts, part.last - part.first
        between = lambda flags: np.diff(np.append(0, np.cumsum(flags))[cuts])  # noqa: B023, E731
        best = longest_repeats(part)
        longest = np.zeros(docs, np.int64)
        np.maximum.at(longest, np.repeat(np.arange(docs), np.diff(part.of_doc)), best)
        found = {
            "n_words": np.diff(part.of_doc),
            "word_chars": between(~SEPARATOR[data] & ((data & 0xC0) != 0x80)),
            "n_symbols": between(SYMBOL[data]),
            "n_dup_lines": _repeated_lines(data, cuts),
            "n_repeat_words": covered(best, part.of_doc, p.window),
            "n_covered_words": covered(best, part.of_doc, p.repeat),
            "longest_repeat": longest,
        }
        for name, value in found.items():
            out.setdefault(name, []).append(value.astype(np.int64))
    return {name: np.concatenate(out[name]) if name in out else np.empty(0, np.int64) for name in COUNTS}


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_covered_words", "longest_repeat"]


def _repeated_lines(data: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Lines of each document that hold a word and equal an earlier line of it."""
    doc, mark, has_word = lines(data, cuts)
    doc, mark = doc[has_word], mark[has_word]
    docs = len(cuts) - 1
    kinds = np.unique(np.stack([doc.astype(np.uint64), mark]), axis=1)[0].astype(np.int64)
    return np.bincount(doc, minlength=docs) - np.bincount(kinds, minlength=docs)


def rules(spark, p: Limits = Limits()):
    """A function of a text column: a struct of the counts and the verdicts base_failed and kept.

    A text fails the plain rules with fewer than ``least_words`` words, or if repeated windows cover too many of
    them.  It is kept if it passes them, if repeated substrings of at least ``repeat`` words cover no more than
    their share of its words, and if none is longer than ``longest``.  A null or empty text has no words: all
    counts are 0 and it fails.  The function is not marked as repeatable, so that a filter on it is not worked
    out twice.
    """
    ship(spark)
    counts = ", ".join(f"{c}: bigint" for c in COUNTS)

    @F.arrow_udf(f"struct<{counts}, base_failed: boolean, kept: boolean>")
    def judge(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in texts:
            m = measure(part, p)
            n = m["n_words"]
            failed = (n < p.least_words) | (100 * m["n_repeat_words"] > p.window_percent * n)
            kept = ~failed & (100 * m["n_covered_words"] <= p.covered_percent * n) & (m["longest_repeat"] <= p.longest)
            columns = [pa.array(m[c]) for c in COUNTS] + [pa.array(failed), pa.array(kept)]
            yield pa.StructArray.from_arrays(columns, names=[*COUNTS, "base_failed", "kept"])
        give_back()

    judge = judge.asNondeterministic()
    return lambda text: judge(text.cast("string"))


def judged(docs: DataFrame, p: Limits = Limits()) -> DataFrame:
    """doc_id, all counts, base_failed and kept for every row of docs (doc_id, text).

    Repeated rows are judged each; an empty table gives no rows; other columns are ignored.  A text is held whole,
    with about 100 bytes for each of its words whatever it repeats.
    """
    verdict: Column = rules(docs.sparkSession, p)(F.col("text"))
    return docs.select("doc_id", verdict.alias("v")).select("doc_id", "v.*")
