from __future__ import annotations

import random
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pytest

from civicflow.llm import spelling_variants as sv
from civicflow.llm.queries import op13_reduced_alphabet
from civicflow.llm.spelling_variants import Variants, spelling_variants
from tests.llm.conftest import LOWER, SF

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def edits(word: str, letters: str) -> set[str]:
    cut = [(word[:k], word[k:]) for k in range(len(word) + 1)]
    less = {a + b[1:] for a, b in cut if b}
    other = {a + c + b[1:] for a, b in cut if b for c in letters}
    more = {a + c + b for a, b in cut for c in letters}
    return (less | other | more) - {word}


def brute(rows: list[tuple], p: Variants) -> list[tuple]:
    count = Counter()
    for doc_id, text in rows:
        for run in RUN.findall((text or "").translate(LOWER)):
            h = crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if p.noise and h % p.noise == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] += 1
    words = {w: n for w, n in count.items() if len(w) >= p.least_chars and n >= p.least_n}
    letters = "".join(sorted({c for w in words for c in w}))
    near = {w: edits(w, letters) & words.keys() for w in words}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= p.times * words[w] else None
    out = []
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), words[form[w]] if form[w] else None))
    return sorted(out)


@pytest.mark.parametrize("p", [Variants(noise=199), Variants(noise=5, crowd=0), Variants(least_chars=2, least_n=1, times=2, crowd=3)])
def test_whole_table(documents, odd, p):
    for docs in (documents, odd):
        rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
        assert sorted(map(tuple, spelling_variants(docs, p).collect())) == brute(rows, p)


def test_words_that_share_one_reduced_word(spark):
    rng = random.Random(6)
    words = ["".join(rng.choice("aé") for _ in range(rng.randint(6, 9))) for _ in range(400)]
    text = " ".join(w for w in words for _ in range(rng.choice([1, 1, 30])))
    p = Variants(least_n=1, crowd=4)
    df = spark.createDataFrame([(1, text)], "doc_id int, text string")
    assert sorted(map(tuple, spelling_variants(df, p).collect())) == brute([(1, text)], p)


def test_chains_are_followed(spark):
    chain = [("abcdefghij"[: 10 - k], 5 ** (k + 1)) for k in range(4)]
    text = " ".join(" ".join([w] * n) for w, n in chain)
    df = spark.createDataFrame([(1, text)], "doc_id int, text string")
    got = {r.word: r for r in spelling_variants(df).collect()}
    assert {w: got[w].root for w, _ in chain} == {w: "abcdefg" for w, _ in chain}
    assert got["abcdefghij"].form == "abcdefghi" and got["abcdefg"].form is None


@pytest.mark.parametrize("piece", [64, 4 << 20])
def test_runs_and_pieces(spark, monkeypatch, piece):
    rng = random.Random(7)
    parts = ["Wört", "STRASSE", "×÷", " ", "'", "1", "é", "日", "😀", "ÿ", "Ā", "\n", "ab"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(60)] + [None, "", "é" * 200]
    monkeypatch.setattr(sv, "PIECE", piece)
    p, total = Variants(least_chars=3, noise=2), Counter()
    import pyarrow as pa

    ids = [None, *range(1, len(texts))]
    batch = pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts, pa.string())], names=["doc_id", "text"])
    for out in sv._words(p)(iter([batch])):
        for w, n in zip(*(c.to_pylist() for c in out.columns)):
            total[w] += n
    want = Counter()
    for doc_id, text in zip(ids, texts):
        for run in RUN.findall((text or "").translate(LOWER)):
            h = crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            want[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 2 == 0 else run] += 1
    assert total == Counter({w: n for w, n in want.items() if len(w) >= 3})


def test_neighbourhoods_are_whole():
    rng = random.Random(8)
    for size in range(1, 7):
        for symbols in (1, 2, 3):
            kinds = "".join(chr(k + 1) for k in range(symbols))
            word = "".join(rng.choice(kinds) for _ in range(size))
            codes = lambda w: np.array([[ord(c) for c in w]]).reshape(1, len(w))
            own = lambda w: int(sv.neighbourhood(codes(w), 0)[0, 0])
            found = sv.neighbourhood(codes(word), symbols)[0].tolist()
            want = {own(w) for w in edits(word, kinds) | {word}}
            assert set(found) - {0} == want and len([x for x in found if x]) == len(want)


def test_frequent_letters_get_symbols_of_their_own():
    got = sv.symbols_of({"e": 100, "n": 50, "t": 40, "x": 1, "y": 1}, 3)
    assert len({got[ord(c)] for c in "ent"}) == 3 and set(got.values()) == {1, 2, 3}


def test_empty_table_and_query(spark, empty, documents):
    assert spelling_variants(empty).collect() == []
    rows = [tuple(r) for r in documents.select("doc_id", "text").collect()]
    assert sorted(map(tuple, op13_reduced_alphabet(spark, SF).collect())) == brute(rows, Variants(noise=199))
