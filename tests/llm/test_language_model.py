from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from civicflow.llm.backoff_lm import Automaton, Model, grams, scores
from civicflow.llm.queries import op5_backoff_automaton
from tests.llm.conftest import LOWER, SF, WORD


def brute(rows: list[tuple], p: Model) -> list[tuple]:
    """The scores of (doc_id, text, train), by counting all n-grams in one place."""
    texts = [WORD.findall((t or "").translate(LOWER)) + [None] for _, t, _ in rows]
    count = Counter()
    for words, (_, _, train) in zip(texts, rows):
        for m in range(p.order if train else 0):
            run = [None, *words]
            count.update(tuple(run[j - m : j + 1]) for j in range(max(1, m), len(run)))
    learned = sum(c for g, c in count.items() if len(g) == 1)
    kinds = sum(len(g) == 1 for g in count)
    out = []
    for words, (doc_id, _, _) in zip(texts, rows):
        run, total, base = [None, *words], 0.0, 0.0
        for j in range(1, len(run)):
            c = count[(run[j],)]
            base += math.log10((c + 1) / (learned + kinds + 1))
            chance = p.discount * kinds / learned / (kinds + 1) if learned else 1.0
            chance += max(c - p.discount, 0) / max(learned, 1)
            for m in range(1, min(p.order - 1, j) + 1):
                state = count[tuple(run[j - m : j])]
                if state:
                    chance = p.mix * count[tuple(run[j - m : j + 1])] / state + (1 - p.mix) * chance
            total += math.log10(chance)
        known = sum(count[(w,)] > 0 for w in words)
        out.append((doc_id, len(words), known, learned, base, total))
    return out


def same(got: list, want: list[tuple]) -> None:
    got = sorted(map(tuple, got), key=str)
    assert len(got) == len(want)
    for a, b in zip(got, sorted(want, key=str)):
        assert a[:4] == b[:4] and a[4:] == pytest.approx(b[4:], rel=1e-9, abs=1e-9)


@pytest.mark.parametrize("order", [1, 2, 3])
@pytest.mark.parametrize("block_bytes,bits", [(30_000, 2), (8_000_000, 8)])
def test_whole_table(documents, order, block_bytes, bits):
    train = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(7)) != 2
    p = Model(order=order, block_bytes=block_bytes, slice_bits=bits)
    rows = [tuple(r) for r in documents.select("doc_id", "text", train).collect()]
    same(scores(documents, train, p).collect(), brute(rows, p))


def test_held_out_texts_score_above_the_base(spark):
    rows = [r for r in op5_backoff_automaton(spark, "/root/testdata/sf0.01").collect() if r.held_out]
    assert sum(r.score for r in rows) > 0.95 * sum(r.base_score for r in rows)
    assert sum(r.score > r.base_score for r in rows) > 0.85 * len(rows)


def test_weights_of_a_state_are_a_distribution(spark):
    rows = [(1, "a b a c"), (2, "b a"), (3, "c c c")]
    probes = [(10 + k, f"{w}") for k, w in enumerate(["a", "b", "c", "other", ""])]
    df = spark.createDataFrame(rows + probes, "doc_id bigint, text string")
    p = Model(order=2)
    got = {r.doc_id: r.score for r in scores(df, F.col("doc_id") < 10, p).collect()}
    end = {r[0]: r for r in brute([(k, t, k < 10) for k, t in rows + probes], p)}
    assert all(got[k] == pytest.approx(end[k][5]) for k in got)
    first = brute([(k, t, True) for k, t in rows], p)
    learned = first[0][3]
    assert learned == 12
    # from the start: three known words, the end, and one unknown word
    count, starts = Counter("abacbaccc"), Counter("abc")
    free = p.discount * 4 / learned
    chance = {w: p.mix * starts[w] / 3 + (1 - p.mix) * ((count[w] - p.discount) / learned + free / 5) for w in "abc"}
    rest = (1 - p.mix) * ((3 - p.discount) / learned + free / 5) + (1 - p.mix) * free / 5
    assert sum(chance.values()) + rest == pytest.approx(1.0)


def test_odd_rows(odd, empty):
    p = Model(block_bytes=20_000)
    for train in (F.lit(True), F.lit(False), F.lit(None).cast("boolean"), F.col("doc_id") > 4):
        rows = [(r.doc_id, r.text, bool(r[2])) for r in odd.select("doc_id", "text", train).collect()]
        same(scores(odd, train, p).collect(), brute(rows, p))
    assert scores(empty, F.lit(True)).collect() == []


def test_the_query_covers_all_rows(spark, documents):
    got = op5_backoff_automaton(spark, SF)
    assert got.count() == documents.count() and got.columns[-1] == "held_out"


def test_an_id_on_half_of_the_rows_fills_no_block(spark, documents):
    text = F.concat("text", F.lit(" of one id, "), F.col("doc_id").cast("string"))
    one = documents.withColumn("text", text).withColumn("doc_id", F.lit(1))
    docs = documents.select("doc_id", "text").union(one.select("doc_id", "text"))
    p = Model(block_bytes=50_000)
    rows = [(r.doc_id, r.text, True) for r in docs.collect()]
    same(scores(docs, F.lit(True), p).collect(), brute(rows, p))
    size = sum(len(r[1].encode()) for r in rows)
    blocks = 1 + size // p.block_bytes
    dealt = docs.groupBy(F.pmod(F.xxhash64(F.col("doc_id").cast("bigint"), "text"), F.lit(blocks))).agg(
        F.sum(F.octet_length("text")).alias("size"), F.max(F.octet_length("text")).alias("longest")
    )
    assert all(r.size <= 2 * p.block_bytes + r.longest for r in dealt.collect())


def test_states_arcs_and_failures_of_a_block():
    texts = pa.array(["a b a c", "b a"])
    g = grams(texts, np.array([True, True]), 3)
    totals = [g.counts(m).astype(float) for m in range(3)]
    made = Automaton(g, totals, int(totals[0].sum()), int((totals[0] > 0).sum()), Model(order=3))
    assert len(made.failure) == 1 + 4 + 7 and made.failure[0] == 0  # the root, a b c and the end, and the seven pairs
    assert len(made.arcs) == sum(len(k) for k in g.keys) == len(made.weight) == len(made.next)
    assert all(made.failure[s] < s for s in range(1, len(made.failure)))
    assert all(0 <= s < len(made.failure) for s in made.next)


def test_rows_of_the_exchange_follow_the_blocks(spark, documents):
    from civicflow.llm.backoff_lm import _ASKED, _ask

    found = []
    for blocks in (4, 8):
        dealt = documents.select("text", F.lit(True).alias("train"), (F.col("doc_id") % blocks).alias("block"))
        found.append(dealt.groupBy("block").applyInArrow(_ask(Model()), _ASKED).count() / blocks)
    assert found == [256, 256]
