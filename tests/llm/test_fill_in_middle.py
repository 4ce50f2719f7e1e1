from __future__ import annotations

import random
import re
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from civicflow.llm.fill_in_middle import BlockTree, Fim, block_tree, cut, fill_in_middle, rearranged, restored
from civicflow.llm.queries import op11_fill_in_middle
from tests.llm.conftest import SF

UNIT = re.compile(r"[ \t-\r]*[^ \t-\r]+|[ \t-\r]+")


def brute(doc_id, text, p: Fim) -> tuple:
    text = text or ""
    units = UNIT.findall(text)
    n = len(units)
    digest = sha256(f"{p.seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= p.percent:
        return doc_id, n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < p.suffix_first:
        return doc_id, n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return doc_id, n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def test_tree_against_plain_sums():
    rng = np.random.default_rng(3)
    for n in (1, 2, 3, 7, 8, 100):
        units, chars = rng.integers(0, 4, n), rng.integers(0, 9, n)
        tree = BlockTree(units, chars)
        for _ in range(20):
            k, u, c = int(rng.integers(n)), int(rng.integers(5)), int(rng.integers(5))
            tree.add(k, u, c)
            units[k] += u
            chars[k] += c
            through = np.cumsum(units)
            assert tree.total() == through[-1]
            for unit in range(1, int(through[-1]) + 1):
                at = int(np.searchsorted(through, unit))
                before = int(through[at - 1]) if at else 0
                assert tree.descend(unit) == (at, unit - before, int(chars[:at].sum()))


@pytest.mark.parametrize("block", [1, 3, 16, 4096])
def test_every_cut(block):
    rng = random.Random(4)
    for _ in range(60):
        text = "".join(rng.choice(["a ", "bc", "é", "日本 ", "\n", " \t", "😀", "<P"]) for _ in range(rng.randint(0, 30)))
        data = np.frombuffer(text.encode(), np.uint8)
        units = UNIT.findall(text)
        tree = block_tree(data, block)
        assert tree.total() == len(units)
        for k in range(len(units) + 1):
            head = "".join(units[:k])
            assert cut(data, tree, k, block) == (len(head.encode()), len(head))


@pytest.mark.parametrize("p", [Fim(), Fim(percent=100, block=7), Fim(seed=1, percent=100, suffix_first=0)])
def test_whole_table(documents, odd, p):
    for docs in (documents, odd):
        got = fill_in_middle(docs, p).withColumn("back", restored(F.col("text"), F.col("form"))).collect()
        rows = docs.select("doc_id", "text").collect()
        assert sorted((tuple(r)[:6] for r in got), key=str) == sorted((brute(*r, p) for r in rows), key=str)
        assert sorted(r.back for r in got) == sorted(r.text or "" for r in rows)


def test_texts_with_marks_stay_plain_and_pieces_of_marks_do_not(spark):
    texts = ["a <P> b", "<S>", "x<M>", "<P", "< P> <", "M> <S <", "<<P", "S><P"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts * 8)], "doc_id int, text string")
    got = fill_in_middle(df, Fim(percent=100)).withColumn("back", restored(F.col("text"), F.col("form"))).collect()
    assert [r.back for r in sorted(got)] == texts * 8
    assert all((r.form == "plain") == (r.doc_id % 8 < 3) for r in got)


def test_long_text_and_empty_table(empty):
    text = "wörd  " * 1_000_000
    data = np.frombuffer(text.encode(), np.uint8)
    n, form, prefix, middle, out = rearranged(data, 4, Fim(percent=100))
    assert (n, form) == (1_000_001, brute(4, "wörd  ", Fim(percent=100))[2]) and prefix + middle <= len(text)
    assert (4, n, form, prefix, middle, out.decode()) == brute(4, text, Fim(percent=100))
    assert fill_in_middle(empty).collect() == []


def test_the_query_gives_back_every_text(spark, documents):
    got = {r.doc_id: r for r in op11_fill_in_middle(spark, SF).collect()}
    for r in documents.collect():
        assert got[r.doc_id].restored_sha256 == sha256(r.text.encode()).hexdigest()
        assert got[r.doc_id].output_sha256 == sha256(brute(r.doc_id, r.text, Fim())[5].encode()).hexdigest()
    assert len(got) == documents.count() and {r.form for r in got.values()} == {"plain", "psm", "spm"}
