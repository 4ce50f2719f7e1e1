"""URL filter: rules by host and path, and a logistic regression for what no rule decides.

A rule such as ``example.org/es/`` fits its host and all hosts below it if the path starts with the rule's; of
several the longest wins.  The model sees a URL as the set of byte n-grams of its host and of its path, with
marks for their ends, hashed to a fixed number of places.  It is trained from a small labelled URL table: at most
``sample`` rows of each class are used, the first by a hash of the URL, and each comes to the driver as a bitmap
of the places, so what comes is bounded.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civicflow.llm.words import buffers
from civicflow.llm.workers import map_batches, ship

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Settings:
    """Shortest and longest n-gram; places as a power of two; rows of a class; sweeps, step and decay of the fit."""

    shortest: int = 2
    longest: int = 5
    bits: int = 15
    sample: int = 1000
    sweeps: int = 30
    step: float = 0.5
    decay: float = 1e-4


@dataclass(frozen=True)
class Model:
    """Log-odds of a block by place, and those of a URL without any."""

    weights: np.ndarray
    bias: float
    settings: Settings

    def scores(self, hosts: pa.Array, paths: pa.Array) -> np.ndarray:
        """Probability that each URL is to be blocked."""
        found = url_places(hosts, paths, self.settings)
        odds = np.array([self.weights[at].sum() / np.sqrt(max(1, len(at))) for at in found]) + self.bias
        return 1 / (1 + np.exp(-np.clip(odds, -500, 500)))


def host_of(url: Column) -> Column:
    """What stands after the first ``://`` up to a slash, ? or #, with A-Z in lower case; else empty."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), "://([^/?#]*)", 1)
    return F.translate(host, _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What stands after the host up to ? or #; else empty."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), "://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: dict[str, str]) -> Column:
    """The longest of the rules (host and path together, by verdict) that fits; null if none does."""
    found = []
    for rule in sorted(rules, key=lambda r: (-len(r), r)):
        at = (rule + "/").index("/")
        of_host, of_path = rule[:at], rule[at:]
        fits = ((host == of_host) | host.endswith(f".{of_host}")) & path.startswith(of_path)
        found.append(F.when(fits, F.lit(rule)))
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def url_places(hosts: pa.Array, paths: pa.Array, s: Settings) -> Iterator[np.ndarray]:
    """Distinct places of the n-grams of each URL, host and path apart."""
    sides = [buffers(hosts), buffers(paths)]
    shift = np.uint32(32 - s.bits)
    for k in range(len(hosts)):
        found = []
        for side, (data, offsets) in enumerate(sides):
            text = data[offsets[k] : offsets[k + 1]].astype(np.uint32)
            codes = np.concatenate([[np.uint32(256)], text, [np.uint32(257)]]).astype(np.uint32) + np.uint32(1)
            code = np.zeros(len(codes), np.uint32)
            for n in range(min(s.longest, len(codes))):
                code = code[: len(codes) - n] * np.uint32(0x01000193) + codes[n:]
                if n + 1 >= s.shortest:
                    found.append((code * np.uint32(0x9E3779B1) + np.uint32(2 * n + side)) * np.uint32(0x85EBCA6B) >> shift)
        yield np.unique(np.concatenate(found)) if found else np.empty(0, np.uint32)


def fit(labelled: DataFrame, s: Settings = Settings()) -> Model:
    """The model of a table (url, block), block 1 or 0, by stochastic gradient descent with falling steps.

    Rows of another label are left out and a URL counts once for each label.  With rows of one class only, every
    URL is of that class; without any, none is blocked.
    """
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    held = labelled.where(F.col("block").isin(0, 1)).select(host.alias("host"), path.alias("path"), "block").distinct()
    order = [F.xxhash64("host", "path"), "host", "path"]
    parts = [held.where(F.col("block") == c).orderBy(*order).limit(s.sample) for c in (0, 1)]

    def bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            maps = []
            for at in url_places(batch.column(0), batch.column(1), s):
                flags = np.zeros(1 << s.bits, bool)
                flags[at] = True
                maps.append(np.packbits(flags).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(2), pa.array(maps, pa.binary())], names=["block", "bits"])

    chosen = parts[0].union(parts[1]).select("host", "path", F.col("block").cast("int"))
    rows = map_batches(chosen, bitmaps, "block int, bits binary").collect()
    rows.sort(key=lambda r: (r.block, bytes(r.bits)))
    sets = [np.flatnonzero(np.unpackbits(np.frombuffer(r.bits, np.uint8))) for r in rows]
    y = np.array([r.block for r in rows], float)
    weights, bias = np.zeros(1 << s.bits), 0.0
    if not 0 < y.sum() < len(y):
        return Model(weights, 500.0 if y.sum() else -500.0, s)
    cost = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    rng = np.random.default_rng(11)
    for sweep in range(s.sweeps):
        step = s.step / (1 + sweep)
        for i in rng.permutation(len(y)):
            size = np.sqrt(max(1, len(sets[i])))
            odds = weights[sets[i]].sum() / size + bias
            slope = step * cost[i] * (y[i] - 1 / (1 + np.exp(-np.clip(odds, -500, 500))))
            weights[sets[i]] += slope / size - step * s.decay * weights[sets[i]]
            bias += slope
    return Model(weights, float(bias), s)


def judge(pages: DataFrame, rules: dict[str, str], model: Model) -> DataFrame:
    """(page_id, host, path, rule, verdict, block_score) for every row of pages (page_id, url).

    ``rules`` gives a verdict, allow or block, by host and path.  A null url, or one without ``://``, has an empty
    host and path.  ``rule`` is the rule that decided, else null, and then the model decides: it blocks from a
    probability of a half on.  ``block_score`` is that probability, also where a rule decided.  Repeated rows are
    judged each; an empty table gives no rows; other columns are ignored.
    """
    ship(pages.sparkSession)
    shared = pages.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def blocked(hosts: pa.Array, paths: pa.Array) -> pa.Array:
        return pa.array(shared.value.scores(hosts, paths), pa.float64())

    url = F.col("url").cast("string")
    parts = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"))
    score = blocked.asNondeterministic()(F.col("host"), F.col("path"))
    out = parts.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules)).withColumn("block_score", score)
    by_rule = [F.when(F.col("rule") == r, F.lit(v)) for r, v in rules.items()]
    by_model = F.when(F.col("block_score") >= 0.5, F.lit("block")).otherwise(F.lit("allow"))
    return out.select("page_id", "host", "path", "rule", F.coalesce(*by_rule, by_model).alias("verdict"), "block_score")
