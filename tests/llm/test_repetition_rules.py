from __future__ import annotations

import random
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from civicflow.llm import words as w
from civicflow.llm.queries import ORACLES, op6_suffix_array_rules
from civicflow.llm.repetition_rules import COUNTS, Limits, common_prefixes, judged, measure, suffix_ranks
from tests.llm.conftest import SF, WORD


def brute(text: str | None, p: Limits) -> list[int]:
    text = text or ""
    ws = WORD.findall(text)

    def covered(k: int) -> set[int]:
        runs = [tuple(ws[i : i + k]) for i in range(len(ws) - k + 1)]
        n = Counter(runs)
        return {i + j for i, run in enumerate(runs) if n[run] > 1 for j in range(k)}

    longest = 0
    while covered(longest + 1):
        longest += 1
    lines = [x for x in text.split("\n") if WORD.search(x)]
    symbols = sum(c in "#*$%&|<>" for c in text)
    whole = [len(ws), sum(map(len, ws)), symbols, len(lines) - len(set(lines))]
    return [*whole, len(covered(p.window)), len(covered(p.repeat)), longest]


def verdict(counts: list[int], p: Limits) -> tuple[bool, bool]:
    n, *_, again, part, longest = counts
    failed = n < p.least_words or 100 * again > p.window_percent * n
    return failed, not failed and 100 * part <= p.covered_percent * n and longest <= p.longest


@pytest.mark.parametrize("piece", [1 << 20, 32])
def test_counts(monkeypatch, piece):
    monkeypatch.setattr(w, "PIECE", piece)
    rng = random.Random(2)
    parts = ["a ", "b ", "é ", "\n", "a b a ", "# ", "x y z w q r s t u ", "\t", "<k>"]
    texts = [None, "", " \n"] + ["".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(120)]
    for p in (Limits(), Limits(window=3, repeat=2)):
        m = measure(pa.array(texts, pa.string()), p)
        assert [[int(m[c][k]) for c in COUNTS] for k in range(len(texts))] == [brute(t, p) for t in texts]


def test_suffix_ranks_sort_the_suffixes():
    rng = random.Random(3)
    for n in (0, 1, 7, 200):
        codes = [rng.randint(0, 2) for _ in range(n)] + [9]
        order = sorted(range(n + 1), key=lambda k: codes[k:])
        assert np.argsort(suffix_ranks(np.array(codes))[-1]).tolist() == order


def test_verdicts_and_odd_rows(spark, odd, empty):
    words = [f"w{k}" for k in range(600)]
    plain, long = " ".join(words), " ".join(words + words[:70])
    short_runs = " ".join(words[:30] + [x for k in range(0, 60, 6) for x in words[k : k + 6] + ["."] + words[k : k + 6]])
    rows = spark.createDataFrame([(1, plain), (2, long), (3, short_runs), (4, "few words")], "doc_id int, text string")
    p = Limits(covered_percent=30, longest=60)
    got = {r.doc_id: (r.base_failed, r.kept) for r in judged(rows, p).collect()}
    assert got == {r.doc_id: verdict(brute(r.text, p), p) for r in rows.collect()}
    assert got[1] == (False, True) and got[2] == (False, False) and got[4] == (True, False)
    out = judged(odd, Limits()).collect()
    want = [(r.doc_id, *brute(r.text if r.doc_id != 4 else None, Limits())) for r in odd.collect()]
    assert Counter(tuple(r)[:8] for r in out if r.doc_id != 4) == Counter(x for x in want if x[0] != 4)
    assert [(r.n_words, r.longest_repeat, r.kept) for r in out if r.doc_id == 4] == [(30000, 29990, False)] * 2
    assert judged(empty).collect() == []


def test_sql_says_the_same(spark):
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    got = op6_suffix_array_rules(spark, SF)
    want = duck.execute(f"SELECT {', '.join(got.columns)} FROM ({ORACLES['op6_suffix_array_rules']})").fetchall()
    assert Counter(map(tuple, got.collect())) == Counter(want)


def test_memory_of_one_long_text_of_one_word():
    import tracemalloc

    text = pa.array(["word " * 1_600_000])  # 8 MB
    tracemalloc.start()
    found = measure(text, Limits())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert int(found["longest_repeat"][0]) == 1_599_999 and int(found["n_repeat_words"][0]) == 1_600_000
    assert peak < 400e6


def test_common_prefixes_beyond_the_kept_rounds():
    rng = random.Random(6)
    run = [rng.randint(0, 3) for _ in range(700)]
    codes = np.array(run + run[:640] + run[100:500] + [9])
    kept, rank = suffix_ranks(codes)
    array = np.argsort(rank)
    got = common_prefixes(kept, array)
    assert [w for w, _ in kept] == [1, 16, 256]
    for k, n in enumerate(got.tolist()):
        a, b = codes[array[k] :].tolist(), codes[array[k + 1] :].tolist()
        assert a[:n] == b[:n] and a[n : n + 1] != b[n : n + 1]
