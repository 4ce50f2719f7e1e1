from __future__ import annotations

import random
from hashlib import sha256

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from civicflow.llm import byte_bpe
from civicflow.llm.queries import byte_ranks, op7_byte_bpe
from tests.llm.conftest import SF


@pytest.fixture(scope="module")
def own():
    return byte_bpe.Encoder(byte_ranks(), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library(own):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own.rank, special_tokens={})


def ids(raw: bytes) -> list[int]:
    return np.frombuffer(raw, "<u4").tolist()


SHAPES = [
    "", "a", " ", "  a", "a  ", "\n\n x", "it's we're 'll 's", "x\x1cy \x1f z", "a　b 　 c", "tab\t\tq \t r",
    "123 4567 a1b2 ½ ²", "日本語 テキスト", "😀😀 👩‍👩‍👧", "<|endoftext|> x", "x" * 3000, "ab" * 500, "!?" * 400, " " * 300 + "q",
    "\r\n\r\n", "a\x85b \x85 c", "\xa0\xa0x \xa0y",
]


def test_ids_are_the_librarys(own, library):
    rng = random.Random(5)
    texts = SHAPES + ["".join(rng.choice("ab '\t\n é1²日😀!.\x1c\u2009") for _ in range(rng.randint(1, 60))) for _ in range(800)]
    for text, raw in zip(texts, own.encode_many(texts)):
        assert ids(raw) == library.encode_ordinary(text) == ids(own.encode(text))
        assert own.decode(raw) == text.encode()


def test_pieces_change_nothing(monkeypatch, own, library):
    monkeypatch.setattr(byte_bpe, "PIECE", 40)
    monkeypatch.setattr(byte_bpe, "KEPT", 30)
    rng = random.Random(6)
    text = "".join(rng.choice(["word", " ", "  ", "\n", "été", "'s", "12 ", "\t"]) for _ in range(3000))
    assert ids(own.encode(text)) == library.encode_ordinary(text)
    assert ids(own.encode("y" * 500)) == library.encode_ordinary("y" * 500)


def test_segment_tree_merges_the_leftmost_least_pair(own):
    rng = random.Random(7)
    for _ in range(200):
        word = bytes(rng.choice(b"abcnt\xc3\xa9") for _ in range(rng.randint(1, 40)))
        parts = [word[k : k + 1] for k in range(len(word))]
        while True:
            ranks = [own.rank.get(a + b, 10**9) for a, b in zip(parts, parts[1:])]
            if not ranks or min(ranks) == 10**9:
                break
            k = ranks.index(min(ranks))
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        assert ids(own.merge([word])[0]) == [own.rank[p] for p in parts]


def test_whole_table(spark, documents, library):
    got = {r.doc_id: r for r in op7_byte_bpe(spark, SF).collect()}
    for r in documents.collect():
        want = library.encode_ordinary(r.text)
        raw = np.array(want, "<u4").tobytes()
        shas = sha256(raw).hexdigest(), sha256(r.text.encode()).hexdigest()
        assert (got[r.doc_id].n_tokens, got[r.doc_id].ids_sha256, got[r.doc_id].decoded_sha256) == (len(want), *shas)


def test_odd_rows(odd, empty, library):
    ranks = byte_ranks()
    out = byte_bpe.decode(byte_bpe.encode(odd, ranks, public_tokenizers.PATTERN), ranks, public_tokenizers.PATTERN)
    have = sorted((str(r.doc_id), r.n_tokens, bytes(r.decoded)) for r in out.collect())
    want = sorted((str(r.doc_id), len(library.encode_ordinary(r.text or "")), (r.text or "").encode()) for r in odd.collect())
    assert have == want
    assert byte_bpe.encode(empty, ranks, public_tokenizers.PATTERN).collect() == []
