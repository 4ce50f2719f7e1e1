"""Language-model scores by a weighted backoff automaton.

Training tokens (lower-cased words and one end for each text) give smoothed n-grams.  Each known n-gram shorter
than the order is a state; the empty one is the root.  From state h an arc for each token w seen after h weighs
log10(mix * c(hw) / c(h) + (1 - mix) * p(w | shorter h)).  A token without an arc takes h's failure arc, which
weighs log10(1 - mix), to the state of the shorter context, and tries again.  At the root, c(w) is discounted and
what that frees is shared by all tokens and one unknown token, so the weights of each state are a distribution.
A text starts in the state of the end token and is read once from left to right, state by state.

No table of all n-grams is held anywhere.  Texts are dealt to blocks of bounded size, and each block builds the part
of the automaton that its texts can reach.  For that it needs the counts of its n-grams over all training texts:

1. A block sends its distinct n-grams, as sorted 64-bit hashes with their training counts, in 256 slices of the hash
   space.
2. The slices of up to 256 blocks meet and are added up.  If there are more blocks, the sums go on in the same way, as
   256 finer slices of each, until one group of blocks is left; so every step sends 256 rows for a block, and the
   number of steps grows with the logarithm of the input.
3. The totals go back the same way, to each in the order in which it asked.

Everything follows the input: no n-gram is pruned, and nothing is sampled.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civicflow.llm.words import mix, words
from civicflow.llm.workers import ship

END = np.uint64(0x5D1C3F0E9B7A2468)
#: Where there is no arc; a weight is 0 at most.
NO_ARC = 1.0
_STEP = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Model:
    """Longest n-gram; weight of the longer context; discount of token counts; bytes of text a block; bits of the hash
    that tell a step's slices apart, which is also how many blocks, as a power of two, meet in a step."""

    order: int = 2
    mix: float = 0.3
    discount: float = 0.75
    block_bytes: int = 8_000_000
    slice_bits: int = 8


@dataclass
class Grams:
    """The tokens of a block: for each order, its sorted distinct n-grams and which of them ends at each position.

    ``of[m]`` is -1 where no n-gram of that order ends, at the start of a text; ``at[m]`` is one position where each
    ends.  ``starts`` are the positions of the texts, each of which closes with the end token; ``train`` says of each
    position whether it may be learned.
    """

    keys: list[np.ndarray]
    of: list[np.ndarray]
    at: list[np.ndarray]
    starts: np.ndarray
    train: np.ndarray

    def counts(self, m: int) -> np.ndarray:
        """How often each n-gram of an order ends at a position that may be learned."""
        held = self.of[m][self.train & (self.of[m] >= 0)]
        return np.bincount(held, minlength=len(self.keys[m]))


def grams(texts: pa.Array, train: np.ndarray, order: int) -> Grams:
    """Cut texts into tokens; null counts as empty and has the end only."""
    tokens, lengths = [], []
    for part in words(texts, lower=True):
        docs = part.last - part.first
        of = np.repeat(np.arange(docs), np.diff(part.of_doc))
        own = np.full(len(part.hashes) + docs, END)
        own[np.arange(len(of)) + of] = part.hashes
        tokens.append(own)
        lengths.append(np.diff(part.of_doc) + 1)
    token = np.concatenate(tokens) if tokens else np.empty(0, np.uint64)
    length = np.concatenate(lengths) if lengths else np.empty(0, np.int64)
    starts = np.cumsum(length) - length
    place = np.arange(len(token)) - np.repeat(starts, length)  # tokens of the text before this one
    keys, of, where = [], [], []
    gram = token
    for m in range(order):
        if m:
            before = np.full(len(token), END)  # the state in which a text starts
            before[1:] = gram[:-1]
            before[starts] = END
            gram = mix(before * _STEP + token + np.uint64(m))
        there = place >= m - 1
        kinds, first, at = np.unique(gram[there], return_index=True, return_inverse=True)
        which = np.full(len(token), -1)
        which[there] = at
        keys.append(kinds)
        of.append(which)
        where.append(np.flatnonzero(there)[first])
    return Grams(keys, of, where, starts, np.repeat(train, length))


def _pack(values: np.ndarray, kind: str) -> bytes:
    """Size and compressed bytes."""
    raw = values.astype(kind).tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unpack(raw: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(pa.decompress(raw[8:], int.from_bytes(raw[:8], "little"), codec="zstd", asbytes=True), kind)


_ASKED = "block bigint, path bigint, keys array<binary>, n array<binary>"
_ANSWERED = "block bigint, path bigint, learned bigint, kinds bigint, totals array<binary>"
_PACKS = pa.list_(pa.binary())


def _sliced(block: int, path: int, keys: list[np.ndarray], counts: list[np.ndarray], depth: int, bits: int) -> pa.Table:
    """Rows of keys and counts for each slice of the part of the hash space that the path's ``depth`` bits lead to."""
    slices = range(path << bits, (path + 1) << bits)
    cuts = np.array([k << (64 - depth - bits) for k in slices[1:]], np.uint64)
    edges = [np.concatenate([[0], np.searchsorted(k, cuts), [len(k)]]) for k in keys]
    packed, sums = [], []
    for r in range(len(slices)):
        spans = [slice(e[r], e[r + 1]) for e in edges]
        packed.append([_pack(np.diff(k[s], prepend=np.uint64(0)), "<u8") for k, s in zip(keys, spans)])
        sums.append([_pack(c[s], "<u8") for c, s in zip(counts, spans)])
    columns = [pa.array([block] * len(slices), pa.int64()), pa.array(slices, pa.int64())]
    return pa.table([*columns, pa.array(packed, _PACKS), pa.array(sums, _PACKS)], names=["block", "path", "keys", "n"])


def _ask(p: Model):
    """A block's n-grams and training counts, one row for each slice of the hash space."""

    def run(table: pa.Table) -> pa.Table:
        g = grams(table.column("text"), table.column("train").to_numpy(), p.order)
        counts = [g.counts(m) for m in range(p.order)]
        return _sliced(table.column("block")[0].as_py(), 0, g.keys, counts, 0, p.slice_bits)

    return run


@dataclass
class Meeting:
    """What some blocks ask of one slice: for each order, the distinct keys, their counts, and where each block's are."""

    blocks: list[int]
    keys: list[np.ndarray]
    counts: list[np.ndarray]
    at: list[list[np.ndarray]]

    @classmethod
    def of(cls, table: pa.Table) -> "Meeting":
        """Taken from rows in any order."""
        table = table.sort_by("block")
        asked, n = table.column("keys").to_pylist(), table.column("n").to_pylist()
        out = cls(table.column("block").to_pylist(), [], [], [])
        for m in range(len(asked[0])):
            runs = [np.cumsum(_unpack(k[m], "<u8"), dtype=np.uint64) for k in asked]
            kinds, at = np.unique(np.concatenate(runs), return_inverse=True)
            found = np.concatenate([_unpack(c[m], "<u8") for c in n])
            out.keys.append(kinds)
            out.counts.append(np.bincount(at, weights=found, minlength=len(kinds)).astype(np.int64))
            out.at.append(np.split(at, np.cumsum([len(r) for r in runs])[:-1]))
        return out

    def replies(self, path: int, totals: list[np.ndarray], learned: int, kinds: int) -> pa.Table:
        """One row for each block: the totals of its keys, and how many tokens and kinds of them were learned."""
        packs = [[_pack(t[at[k]], "<u8") for t, at in zip(totals, self.at)] for k in range(len(self.blocks))]
        n = len(packs)
        numbers = [self.blocks, [path] * n, [learned] * n, [kinds] * n]
        names = ["block", "path", "learned", "kinds", "totals"]
        return pa.table([*(pa.array(c, pa.int64()) for c in numbers), pa.array(packs, _PACKS)], names=names)


def _add_up(table: pa.Table) -> pa.Table:
    """The totals of a slice that all blocks' rows have reached."""
    meeting = Meeting.of(table)
    seen = meeting.counts[0]
    return meeting.replies(table.column("path")[0].as_py(), meeting.counts, int(seen.sum()), int((seen > 0).sum()))


def _ask_on(depth: int, bits: int):
    """The sums of a group of blocks, as rows for the finer slices, asked in the name of the group."""

    def run(table: pa.Table) -> pa.Table:
        meeting = Meeting.of(table)
        group, path = table.column("block")[0].as_py() >> bits, table.column("path")[0].as_py()
        return _sliced(group, path, meeting.keys, meeting.counts, depth, bits)

    return run


def _pass_on(asked: pa.Table, above: pa.Table) -> pa.Table:
    """What a group was told of the finer slices, told to each of its blocks."""
    meeting, above = Meeting.of(asked), above.sort_by("path")
    packs = above.column("totals").to_pylist()
    totals = [np.concatenate([_unpack(row[m], "<u8") for row in packs]) for m in range(len(meeting.keys))]
    learned, kinds = (sum(above.column(c).to_pylist()) for c in ("learned", "kinds"))
    return meeting.replies(asked.column("path")[0].as_py(), totals, learned, kinds)


def answers(asked: DataFrame, blocks: int, bits: int, depth: int) -> DataFrame:
    """The totals of all n-grams for each block that asked; ``depth`` is how many bits of the hash a path holds."""
    if blocks <= 1 << bits:
        return asked.groupBy("path").applyInArrow(_add_up, _ANSWERED)
    group = F.shiftright("block", bits).alias("group")
    met = asked.groupBy(group, "path")
    on = met.applyInArrow(_ask_on(depth, bits), _ASKED)
    above = answers(on, ((blocks - 1) >> bits) + 1, bits, depth + bits)
    told = above.groupBy(F.col("block").alias("group"), F.shiftright("path", bits).alias("above"))
    return met.cogroup(told).applyInArrow(_pass_on, _ANSWERED)


class Automaton:
    """The part of the automaton that the texts of a block can reach.

    States are numbered from 1, by order and key; 0 is the root.  ``arcs`` are numbers state * tokens + token, with
    their ``weight`` and the ``next`` state; ``failure`` leads from a state to that of the shorter context, and weighs
    ``back``.  The state before a position is that of some last tokens that were read, so its order tells it, and the
    n-gram that ends at the position tells the arc: ``offered`` has, for each order, the weight of an arc by n-gram.
    """

    def __init__(self, g: Grams, totals: list[np.ndarray], learned: int, kinds: int, p: Model):
        self.tokens = max(1, len(g.keys[0]))
        free = p.discount * kinds / learned / (kinds + 1) if learned else 1.0
        self.unknown = float(np.log10(free))
        end = int(np.searchsorted(g.keys[0], END))
        opens = np.zeros(len(g.of[0]), bool)
        opens[g.starts] = True
        state = [np.zeros(0, np.int64) for _ in range(p.order)]  # the number of each n-gram's state
        chance = [np.zeros(0) for _ in range(p.order)]
        keys, weight, after, failure, used = [], [], [], [np.zeros(1, np.int64)], 1
        self.offered = []
        for m in range(p.order):
            count, at = totals[m], g.at[m]
            token, known = g.of[0][at], count > 0
            if m == 0:
                source, shorter = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
                chance[0] = np.maximum(count - p.discount, 0) / max(learned, 1) + free
            else:
                before = np.where(opens[at], end, g.of[m - 1][at - 1])
                suffix = g.of[m - 1][at]
                source, shorter = state[m - 1][before], state[m - 1][suffix]
                share = np.divide(count, totals[m - 1][before], out=np.zeros(len(at)), where=known)
                chance[m] = p.mix * share + (1 - p.mix) * chance[m - 1][suffix]
            if m < p.order - 1:
                state[m] = np.where(known, used - 1 + np.cumsum(known), 0)
                used += int(known.sum())
                failure.append(shorter[known])
                goes = state[m]
            else:
                goes = shorter
            keys.append((source * self.tokens + token)[known])
            offered = np.full(len(at) + 1, NO_ARC)  # the last is for positions where no such n-gram ends
            offered[:-1][known] = np.log10(chance[m][known])
            self.offered.append(offered)
            weight.append(offered[:-1][known])
            after.append(goes[known])
        self.arcs, self.weight, self.next = (np.concatenate(x) for x in (keys, weight, after))
        self.failure = np.concatenate(failure)
        self.back = float(np.log10(1 - p.mix))
        self.start = int(state[0][end]) if p.order > 1 and len(state[0]) else 0

    def read(self, of: list[np.ndarray], first: int, last: int) -> float:
        """The log10 probability of the text from one position to before another, read from left to right.

        Each position offers the arcs of the states of all orders; the state that is carried takes its own, or goes by
        failure arcs to the first that has one.
        """
        arcs = [offered[which[first:last]].tolist() for offered, which in zip(self.offered, of)]
        back, unknown, top = self.back, self.unknown, len(arcs) - 1
        order, total = 1 if self.start else 0, 0.0
        for j in range(last - first):
            weight = arcs[order][j]
            while weight > 0 and order:
                total += back
                order -= 1
                weight = arcs[order][j]
            if weight > 0:
                total += unknown
            else:
                total += weight
                if order < top:
                    order += 1
        return total


def _score(p: Model):
    """Scores of a block's texts by the totals that came back."""

    def run(docs: pa.Table, replies: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return SCORES.empty_table()
        g = grams(docs.column("text"), docs.column("train").to_numpy(), p.order)
        replies = replies.sort_by("path")
        packs = replies.column("totals").to_pylist()
        totals = [np.concatenate([_unpack(row[m], "<u8") for row in packs]).astype(np.float64) for m in range(p.order)]
        learned, kinds = (sum(replies.column(c).to_pylist()) for c in ("learned", "kinds"))
        del packs, replies
        seen = totals[0][g.of[0]]
        base = np.log10((seen + 1.0) / (learned + kinds + 1))
        ends = np.append(g.starts[1:], len(seen))
        automaton = Automaton(g, totals, learned, kinds, p)
        read = [automaton.read(g.of, a, b) for a, b in zip(g.starts.tolist(), ends.tolist())]
        columns = [
            docs.column("doc_id"),
            pa.array(ends - g.starts, pa.int64()),
            pa.array(np.add.reduceat((seen > 0).astype(np.int64), g.starts)),
            pa.array([learned] * docs.num_rows, pa.int64()),
            pa.array(np.add.reduceat(base, g.starts)),
            pa.array(read, pa.float64()),
        ]
        return pa.table(columns, schema=SCORES)

    return run


SCORES = pa.schema(
    [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64())]
    + [("base_score", pa.float64()), ("score", pa.float64())]
)


def scores(docs: DataFrame, train: Column, p: Model = Model()) -> DataFrame:
    """Scores of every row of docs (doc_id, text), learned from the rows where ``train`` holds.

    Columns: doc_id, n_tokens (words and the end), n_known (tokens seen in training), train_tokens (all training
    tokens), base_score (log10 probability by token counts plus one) and score (by the automaton).  A null or
    empty text is its end token.  Rows that repeat a doc_id count and are scored each, in blocks that their texts
    tell too; so do rows without one.  If nothing may be learned, every token has probability one.  Other columns are
    ignored; an empty table gives no rows.  A block holds its texts' n-grams, about 250 bytes a token.
    """
    spark = docs.sparkSession
    ship(spark)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = 1 + size // p.block_bytes
    key = F.col("doc_id").cast("bigint")
    dealt = docs.select(
        key.alias("doc_id"),
        F.col("text").cast("string").alias("text"),
        F.coalesce(train, F.lit(False)).alias("train"),
        F.pmod(F.xxhash64(key, F.col("text").cast("string")), F.lit(blocks)).cast("bigint").alias("block"),
    )
    by_block = dealt.groupBy("block")
    asked = by_block.applyInArrow(_ask(p), _ASKED)
    told = answers(asked, blocks, p.slice_bits, p.slice_bits).groupBy("block")
    names = "doc_id bigint, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    return by_block.cogroup(told).applyInArrow(_score(p), names)
