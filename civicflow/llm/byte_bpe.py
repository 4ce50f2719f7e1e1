"""Byte-level BPE: whole texts to token ids by a rank file, and back to bytes.

A text is cut by the tokenizer's pattern, and each match is merged on its own.  A match that is a token is that
token.  Otherwise its bytes are the leaves of a segment tree: a leaf holds the rank of the pair that starts at
its position, together with the position, and each node the least of its two children, so the root is the
leftmost pair of the least rank.  A merge changes three leaves (the pair's own, its right half's, and the live
neighbour's on the left) and the nodes above them.  Many matches of one tree size are merged side by side, one
merge of each at a time, in numpy.

Matches repeat, so each worker keeps the ids of those it has seen, up to a fixed number.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from civicflow.llm.workers import map_batches

#: Unicode's White_Space, which is what the pattern's \s means.
_SPACE = "\t-\r \x85\xa0  -     　"
#: Cuts that every match respects: a word with the space before it, or a run of white space by itself.
_CHUNK = re.compile(f" ?[^{_SPACE}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
_BREAK = re.compile(f"(?<=[^{_SPACE}])[{_SPACE}]")
#: Characters worked on at once, and the most chunks kept with their ids.
PIECE, KEPT = 1 << 19, 200_000
#: Leaves of all trees that are merged side by side.
LANES = 1 << 15
NONE = np.int64(2**62)


def read_ranks(path: str) -> bytes:
    """A rank file's bytes: a token in base64 and its rank on each line."""
    with open(path, "rb") as file:
        return file.read()


class Encoder:
    """The ranks and what is worked out from them."""

    def __init__(self, ranks: bytes, pattern: str):
        rows = (line.split() for line in ranks.splitlines() if line)
        self.rank = {base64.b64decode(token): int(rank) for token, rank in rows}
        self.token = {i: token for token, i in self.rank.items()}
        self.pattern = regex.compile(pattern)
        self.size = max(self.token, default=0) + 1
        pairs: dict[int, int] = {}
        for token, whole in self.rank.items():
            for cut in range(1, len(token)):
                left, right = self.rank.get(token[:cut]), self.rank.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left * self.size + right] = whole
        self.keys = np.array(sorted(pairs), np.int64)
        self.values = np.array([pairs[k] for k in sorted(pairs)], np.int64)
        self.byte = np.array([self.rank.get(bytes([b]), -1) for b in range(256)], np.int64)
        two = [self.rank.get(bytes([a, b]), NONE) for a in range(256) for b in range(256)]
        self.bytes_pair = np.array(two, np.int64)
        self.le = {token: i.to_bytes(4, "little") for token, i in self.rank.items()}
        self.seen: dict[str, bytes] = {}

    def pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the token that two neighbours make, NONE if they make none."""
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.values[at], NONE)

    def merge(self, words: list[bytes]) -> list[bytes]:
        """Ids of each of these byte strings, as little-endian uint32."""
        out: list[bytes] = [b""] * len(words)
        by_leaves: dict[int, list[int]] = {}
        for k, word in enumerate(words):
            by_leaves.setdefault(max(2, 1 << (len(word) - 1).bit_length()), []).append(k)
        for leaves, at in by_leaves.items():
            step = max(1, LANES // leaves)
            for lo in range(0, len(at), step):
                some = at[lo : lo + step]
                raw, ends = self._merge([words[k] for k in some], leaves)
                start = 0
                for k, end in zip(some, ends):
                    out[k] = raw[start:end]
                    start = end
        return out

    def _merge(self, words: list[bytes], n: int) -> tuple[bytes, list[int]]:
        """Ids of words of at most n bytes, one after the other, and their ends; each has a tree of n leaves."""
        count = len(words)
        lengths = np.array([len(w) for w in words], np.int64)
        place = np.arange(n)
        held = place < lengths[:, None]
        raw = np.zeros((count, n), np.int64)
        raw[held] = np.frombuffer(b"".join(words), np.uint8)
        ids = self.byte[raw]
        after = np.where(place + 1 < lengths[:, None], place + 1, n)
        before = np.tile(place - 1, (count, 1))
        tree = np.full((count, 2 * n), NONE)
        first = self.bytes_pair[raw[:, :-1] * 256 + raw[:, 1:]]
        tree[:, n : 2 * n - 1] = np.where((after[:, :-1] < n) & (first < NONE), first * n + place[:-1], NONE)
        level = n // 2
        while level:
            tree[:, level : 2 * level] = np.minimum(
                tree[:, 2 * level : 4 * level : 2], tree[:, 2 * level + 1 : 4 * level : 2]
            )
            level //= 2

        ids, after, before, tree = (x.ravel() for x in (ids, after, before, tree))
        live = np.arange(count)
        while True:
            root = tree[live * (2 * n) + 1]
            live, root = live[root < NONE], root[root < NONE]
            if not len(live):
                break
            base = live * n
            left = root % n
            right = after[base + left]
            beyond = after[base + right]
            ids[base + left] = root // n
            after[base + left] = beyond
            held.ravel()[base + right] = False
            more = beyond < n
            before[(base + beyond)[more]] = left[more]
            back = before[base + left]
            ahead = np.full(len(live), NONE)
            ahead[more] = self._leaf(ids, base[more], left[more], beyond[more], n)
            behind = back >= 0
            tree[live * (2 * n) + n + right] = NONE
            tree[live * (2 * n) + n + left] = ahead
            tree[(live * (2 * n) + n + back)[behind]] = self._leaf(ids, base[behind], back[behind], left[behind], n)
            top = np.concatenate([live, live, live[behind]]) * (2 * n)
            node = (np.concatenate([right, left, back[behind]]) + n) >> 1
            while node[0]:
                tree[top + node] = np.minimum(tree[top + 2 * node], tree[top + 2 * node + 1])
                node >>= 1
        return ids[held.ravel()].astype("<u4").tobytes(), (4 * np.cumsum(held.sum(axis=1))).tolist()

    def _leaf(self, ids: np.ndarray, base: np.ndarray, left: np.ndarray, right: np.ndarray, n: int) -> np.ndarray:
        rank = self.pair(ids[base + left], ids[base + right])
        return np.where(rank < NONE, rank * n + left, NONE)

    def _learn(self, chunks: set[str]) -> None:
        """Work out the ids of chunks and keep them."""
        le, seen = self.le, self.seen
        words: list[bytes] = []
        todo: list[str] = []
        cut: dict[str, list[bytes]] = {}
        for chunk in chunks:
            bare = chunk[1:] if chunk[0] == " " else chunk
            if bare.isalpha() or not bare.strip(_STRIP):
                word = chunk.encode()
                if word in le:
                    seen[chunk] = le[word]
                else:
                    todo.append(chunk)
                    words.append(word)
            else:
                cut[chunk] = [p.encode() for p in self.pattern.findall(chunk)]
        rest = list({p for parts in cut.values() for p in parts if p not in le})
        found = self.merge(words + rest)
        seen.update(zip(todo, found))
        more = dict(zip(rest, found[len(todo) :]))
        for chunk, parts in cut.items():
            seen[chunk] = b"".join([le[p] if p in le else more[p] for p in parts])

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers."""
        return b"".join(self._ids(_CHUNK.findall(piece)) for piece in pieces(text))

    def _ids(self, chunks: list[str]) -> bytes:
        new = {c for c in chunks if c not in self.seen}
        if len(self.seen) + len(new) > KEPT:
            self.seen = {c: self.seen[c] for c in chunks if c in self.seen}
        if new:
            self._learn(new)
        return b"".join([self.seen[c] for c in chunks])

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """The same for short texts together, whose new chunks are merged side by side."""
        chunks = [_CHUNK.findall(t) for t in texts]
        self._ids([c for of_text in chunks for c in of_text])
        return [b"".join([self.seen[c] for c in of_text]) for of_text in chunks]

    def decode(self, ids: bytes) -> bytes:
        """The bytes that ids stand for."""
        token = self.token
        return b"".join([token[i] for i in np.frombuffer(ids, "<u4").tolist()])


#: White space without the space itself stripped from both ends of a chunk leaves nothing of a run of it.
_STRIP = "".join(map(chr, [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F]))
_STRIP += " 　"

_encoders: dict[tuple[int, str], Encoder] = {}


def encoder(ranks: bytes, pattern: str) -> Encoder:
    """The encoder of these ranks, made once in each worker."""
    key = (hash(ranks), pattern)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(ranks, pattern)
    return _encoders[key]


def pieces(text: str) -> Iterator[str]:
    """The text in pieces of some length, cut only before white space that follows something else."""
    at = 0
    while len(text) - at > PIECE:
        stop = _BREAK.search(text, at + PIECE)
        if stop is None:
            break
        yield text[at : stop.start()]
        at = stop.start()
    yield text[at:]


def _groups(texts: list[str | None]) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts of about PIECE characters together, with the place of their first."""
    first, held, size = 0, [], 0
    for k, text in enumerate(texts):
        held.append(text or "")
        size += len(held[-1])
        if size >= PIECE:
            yield first, held
            first, held, size = k + 1, [], 0
    if held:
        yield first, held


def encode(docs: DataFrame, ranks: bytes, pattern: str, text: str = "text", decoded: str | None = None) -> DataFrame:
    """All columns of docs but the text, then ``n_tokens`` (bigint) and ``ids`` (binary, little-endian uint32).

    Every row gives one row.  A null or empty text has no tokens and empty ids.  Columns of docs that are named
    n_tokens or ids give way to these.  The ranks go to the executors as one broadcast; their file is only read
    where the caller reads it.  Special tokens are ordinary text.  ``decoded`` names one more column: the SHA-256,
    in lowercase hex, of the bytes to which the same task decodes the ids.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(ranks)
    rest = [c for c in docs.columns if c not in (text, "n_tokens", "ids", decoded)]
    schema = docs.select(*(f"`{c}`" for c in rest)).schema
    schema = schema.add("n_tokens", T.LongType()).add("ids", T.BinaryType())
    if decoded is not None:
        schema = schema.add(decoded, T.StringType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(shared.value, pattern)
        for batch in batches:
            for first, some in _groups(batch.column(len(rest)).to_pylist()):
                long = len(some[-1]) > PIECE
                ids = own.encode_many(some[:-1] if long else some) + ([own.encode(some[-1])] if long else [])
                part = batch.slice(first, len(some))
                counts = pa.array([len(x) // 4 for x in ids], pa.int64())
                columns = [*part.columns[: len(rest)], counts, pa.array(ids, pa.binary())]
                if decoded is not None:
                    columns.append(pa.array([sha256(own.decode(x)).hexdigest() for x in ids], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return map_batches(docs.select(*(f"`{c}`" for c in rest), F.col(f"`{text}`").cast("string")), run, schema)


def decode(encoded: DataFrame, ranks: bytes, pattern: str, ids: str = "ids") -> DataFrame:
    """All columns of encoded and ``decoded``, the bytes of its ids; null ids give null."""
    shared = encoded.sparkSession.sparkContext.broadcast(ranks)
    rest = [c for c in encoded.columns if c != "decoded"]
    schema = encoded.select(*(f"`{c}`" for c in rest)).schema.add("decoded", T.BinaryType())
    at = rest.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(shared.value, pattern)
        for batch in batches:
            found = [None if x is None else own.decode(x) for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.binary())], names=schema.names)

    return map_batches(encoded.select(*(f"`{c}`" for c in rest)), run, schema)
