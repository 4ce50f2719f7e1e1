from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

from civicflow.llm import words as w
from tests.llm.conftest import LOWER, WORD


def _texts():
    rng = random.Random(1)
    parts = ["a ", "B", "cd\n", "\t", "é", "日本 ", " ", "\x0b", "x\x85y ", "word "]
    return [None, "", " ", "a"] + ["".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(300)]


@pytest.mark.parametrize("piece", [1 << 20, 16])
@pytest.mark.parametrize("lower", [True, False])
def test_words_are_those_of_the_pattern(monkeypatch, piece, lower):
    monkeypatch.setattr(w, "PIECE", piece)
    texts, known = _texts(), {}
    for part in w.words(pa.array(texts, pa.string()), lower, most=100):
        for k in range(part.last - part.first):
            text = texts[part.first + k] or ""
            want = WORD.findall(text.translate(LOWER) if lower else text)
            span = part.span(k)
            have = [part.data[a:b].tobytes().decode() for a, b in zip(part.starts[span], part.ends[span])]
            assert have == want
            for word, mark in zip(want, part.hashes[span].tolist()):
                assert known.setdefault(word, mark) == mark
    assert len(set(known.values())) == len(known)


@pytest.mark.parametrize("piece", [1 << 20, 16])
def test_lines(monkeypatch, piece):
    monkeypatch.setattr(w, "PIECE", piece)
    texts, known = [t or "" for t in _texts()], {}
    data, cuts = w.buffers(pa.array(texts))
    doc, mark, has_word = w.lines(data, cuts)
    want = [(k, line) for k, text in enumerate(texts) for line in text.split("\n")]
    assert doc.tolist() == [k for k, _ in want]
    assert has_word.tolist() == [bool(WORD.search(line)) for _, line in want]
    for (_, line), m in zip(want, mark.tolist()):
        assert known.setdefault(line, m) == m
    assert len(set(known.values())) == len(known)


def test_sliced_arrays_and_windows():
    part = next(w.words(pa.array(["x x", "a b a b", "c"]).slice(1), False))
    pairs = w.windows(part.hashes[part.span(0)], 2)
    assert len(pairs) == 3 and pairs[0] == pairs[2] != pairs[1]
    assert len(w.windows(np.zeros(2, np.uint64), 3)) == 0
