"""Quality classifier: naive Bayes support vectors on byte n-grams of whole texts.

A text is the set of its byte n-grams of 1 to 3 bytes and of its word-shape n-grams of 1 to 3 words, each hashed
to one of a fixed number of places.  A word's shape is the kind of its first and of its last byte and whether
it repeats the word before it.  A place
is scaled by its log-count ratio between the two classes, each text is brought to length one, and a linear
hinge-loss model is fitted by dual coordinate descent.  Margins become probabilities by a logistic curve fitted
to margins of texts that a fold of the model has not seen.

Only a bounded sample of labelled rows is fitted: at most ``sample`` rows of each class, the first by a hash of
their id, and one text for an id.  A text comes to the driver as a compressed bitmap of the places, so what comes
has a fixed bound: two classes of 2,000 texts of 16 kB are 64 MB, and usually a fifth of that.  Every text is scored,
whole, in one pass without a shuffle.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civicflow.llm.words import Words, words
from civicflow.llm.workers import give_back, map_batches, ship

_ODD = np.uint32(0x9E3779B1)


@dataclass(frozen=True)
class Settings:
    """Longest n-gram; places as a power of two; rows of a class; the hinge's cost; sweeps; smoothing; folds."""

    longest: int = 3
    bits: int = 17
    sample: int = 2000
    cost: float = 1.0
    sweeps: int = 12
    smoothing: float = 1.0
    folds: int = 3
    threshold: float = 0.7


@dataclass(frozen=True)
class Model:
    """Weights by place (ratio and hinge weight multiplied), their bias, and the logistic curve of margins."""

    weights: np.ndarray
    ratios: np.ndarray
    bias: float
    slope: float
    offset: float
    longest: int
    bits: int

    def scores(self, texts: pa.Array) -> np.ndarray:
        """Probability of label 1 for each text; null counts as empty."""
        out = np.empty(len(texts))
        for k, found in enumerate(place_sets(texts, self.longest, self.bits)):
            norm = np.sqrt(np.square(self.ratios[found]).sum())
            margin = self.weights[found].sum() / (norm or 1.0) + self.bias
            out[k] = _logistic(self.slope * margin + self.offset)
        return out


def _logistic(x: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(x, -500, 500))))


#: Bytes worked on at once.
STRETCH = 1 << 20

#: Kinds of bytes: 0 other marks, 1 lower case, 2 upper case, 3 digit, 4 beyond ASCII, 5 full stop and comma, 6 the like.
KIND = np.zeros(256, np.uint32)
for _kind, _of in enumerate((range(97, 123), range(65, 91), range(48, 58), range(128, 256), b".,", b"?!;:"), 1):
    KIND[list(_of)] = _kind


def shapes(part: Words, span: slice) -> np.ndarray:
    """The shape of each word of a document, as a small number."""
    first, last = part.data[part.starts[span]], part.data[part.ends[span] - 1]
    again = np.zeros(len(first), np.uint32)
    again[1:] = part.hashes[span][1:] == part.hashes[span][:-1]
    return (KIND[first] * np.uint32(8) + KIND[last]) * np.uint32(2) + again


def places(text: np.ndarray, shape: np.ndarray, longest: int, bits: int, seen: np.ndarray) -> np.ndarray:
    """Distinct places of a text's byte and shape n-grams; ``seen`` is scratch space, all -1 before and after."""
    shift = np.uint32(32 - bits)
    found = []

    def gather(codes: np.ndarray, most: int, factor: int, salt: int) -> None:
        for at in range(0, len(codes), STRETCH):
            part = codes[at : at + STRETCH + most - 1] + np.uint32(1)
            code = np.zeros(len(part), np.uint32)
            for n in range(min(most, len(part))):
                code = code[: len(part) - n] * np.uint32(factor) + part[n:]
                place = (code * _ODD + np.uint32(salt + n)) * _ODD >> shift
                new = place[seen[place] < 0]
                seen[new] = np.arange(len(new))
                found.append(new[seen[new] == np.arange(len(new))])

    gather(text.astype(np.uint32), longest, 257, 0)
    gather(shape, 3, 129, 16)
    out = np.concatenate(found) if found else np.empty(0, np.uint32)
    seen[out] = -1
    return out


def place_sets(texts: pa.Array, longest: int, bits: int) -> Iterator[np.ndarray]:
    """Distinct places of each whole text; null counts as empty."""
    seen = np.full(1 << bits, -1, np.int64)
    for part in words(texts, lower=False):
        for k in range(part.last - part.first):
            span = part.span(k)
            text = part.data[part.cuts[k] : part.cuts[k + 1]]
            yield places(text, shapes(part, span), longest, bits, seen)


def _bitmaps(s: Settings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            maps = []
            for found in place_sets(batch.column(2), s.longest, s.bits):
                flags = np.zeros(1 << s.bits, bool)
                flags[found] = True
                maps.append(np.packbits(flags).tobytes())
            columns = [batch.column(0), batch.column(1), pa.array(maps, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "label", "bits"])

    return run


def sample(docs: DataFrame, labels: DataFrame, s: Settings) -> DataFrame:
    """(label, bits) of at most ``s.sample`` labelled texts of each class; labels: (doc_id, label 0 or 1).

    Of rows that repeat a doc_id one counts, whichever has the smallest bitmap; each task leaves out its others.
    """
    held = labels.where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1)).select("doc_id", "label").distinct()
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    parts = [held.where(F.col("label") == c).orderBy(*order).limit(s.sample) for c in (0, 1)]
    chosen = F.broadcast(parts[0].union(parts[1]))  # at most twice s.sample rows
    texts = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text")).join(chosen, "doc_id")
    rows = texts.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("label").cast("int").alias("label"), "text")
    maps = map_batches(rows, _bitmaps(s), "doc_id bigint, label int, bits binary")
    return maps.groupBy("doc_id", "label").agg(F.min("bits").alias("bits")).select("label", "bits")


def _compressed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        maps = [zlib.compress(x.as_buffer()) for x in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(maps, pa.binary())], names=["label", "bits"])


def collected(rows: DataFrame) -> tuple[list[np.ndarray], np.ndarray]:
    """The sets of places of a sample and their sides, 1 or -1, in an order that does not depend on the partitions.

    The bitmaps are compressed before they leave the executors: as they are, the driver holds them several times
    over while it takes them in.
    """
    got = map_batches(rows, _compressed, "label int, bits binary").collect()
    held = sorted((r.label, zlib.decompress(r.bits)) for r in got)
    sets = [np.flatnonzero(np.unpackbits(np.frombuffer(x, np.uint8))).astype(np.int32) for _, x in held]
    return sets, np.array([1.0 if label else -1.0 for label, _ in held])


def _descend(rows: list[np.ndarray], y: np.ndarray, cost: np.ndarray, size: int, sweeps: int) -> tuple:
    """Weights and bias of an L2-regularised hinge-loss model, by dual coordinate descent.

    A row is (places, values) with values of length one; the bias is one more feature of value one.
    """
    w, bias = np.zeros(size), 0.0
    alpha = np.zeros(len(rows))
    rng = np.random.default_rng(7)
    for _ in range(sweeps):
        for i in rng.permutation(len(rows)):
            at, value = rows[i]
            gradient = y[i] * (w[at] @ value + bias) - 1
            new = min(max(alpha[i] - gradient / 2.0, 0.0), cost[i])
            step = (new - alpha[i]) * y[i]
            if step:
                alpha[i] = new
                w[at] += step * value
                bias += step
    return w, bias


def _weigh(sets: list[np.ndarray], y: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray, float]:
    """Ratios, weights times ratios, and bias of one fit."""
    size = 1 << s.bits
    counts = np.full((2, size), s.smoothing)
    for at, label in zip(sets, y):
        counts[int(label > 0)][at] += 1
    ratios = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    rows = []
    for at in sets:
        value = ratios[at]
        rows.append((at, (value / (np.sqrt(np.square(value).sum()) or 1.0)).astype(np.float32)))
    share = np.where(y > 0, (y > 0).mean(), (y < 0).mean())
    w, bias = _descend(rows, y, s.cost * 0.5 / share, size, s.sweeps)
    return ratios, w * ratios, bias


def _margins(sets: list[np.ndarray], fit: tuple[np.ndarray, np.ndarray, float]) -> np.ndarray:
    ratios, weights, bias = fit
    return np.array([weights[at].sum() / (np.sqrt(np.square(ratios[at]).sum()) or 1.0) + bias for at in sets])


def _curve(margin: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve that fits the labels best, by Newton's method."""
    target = np.where(y > 0, 1 - 1 / (2 + (y > 0).sum()), 1 / (2 + (y < 0).sum()))
    x = np.stack([margin, np.ones(len(margin))], axis=1)
    beta = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -500, 500)))
        gradient = x.T @ (weight * (p - target)) + 1e-3 * beta
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        beta -= step
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0]), float(beta[1])


def fit(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> Model:
    """The model of labels (doc_id, label) on the texts of docs (doc_id, text).

    Rows of labels without doc_id, or with another label than 0 and 1, are left out.  If there are not at least
    two rows of each class, every text scores the share of label 1, or a half without any.
    """
    sets, y = collected(sample(docs, labels, s))
    size = 1 << s.bits
    if min((y > 0).sum(), (y < 0).sum()) < 2:
        share = (y > 0).mean() if len(y) else 0.5
        flat = float(np.log((share + 1e-6) / (1 - share + 1e-6)))
        return Model(np.zeros(size), np.zeros(size), 0.0, 0.0, flat, s.longest, s.bits)
    natural = labels.groupBy("label").count().where(F.col("label").isin(0, 1)).collect()
    total = {r.label: r["count"] for r in natural}
    fold = np.empty(len(y), int)
    for side in (y > 0, y < 0):
        fold[side] = np.arange(side.sum()) % s.folds
    margin = np.empty(len(y))
    for k in range(s.folds):
        held = np.flatnonzero(fold == k)
        rest = np.flatnonzero(fold != k)
        part = _weigh([sets[i] for i in rest], y[rest], s)
        margin[held] = _margins([sets[i] for i in held], part)
    weight = np.where(y > 0, total.get(1, 1) / (y > 0).sum(), total.get(0, 1) / (y < 0).sum())
    slope, offset = _curve(margin, y, weight / weight.sum() * len(y))
    ratios, weights, bias = _weigh(sets, y, s)
    del sets
    give_back()
    return Model(weights, ratios, bias, slope, offset, s.longest, s.bits)


def scorer(model: Model, docs: DataFrame):
    """A function of a text column: the probability of label 1, from 0 to 1.

    A null text counts as empty.  It is not marked as repeatable, so that a filter on it is not worked out twice.
    """
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in texts:
            yield pa.array(shared.value.scores(part), pa.float64())
        give_back()

    score = score.asNondeterministic()
    return lambda text: score(text.cast("string"))


def classify(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(doc_id, score, predicted) for every row of docs (doc_id, text); predicted is 1 from the threshold on.

    Repeated rows are scored each; an empty table gives no rows; other columns are ignored.
    """
    score: Column = scorer(fit(docs, labels, s), docs)(F.col("text"))
    out = docs.select("doc_id", score.alias("score"))
    return out.withColumn("predicted", (F.col("score") >= s.threshold).cast("int"))
