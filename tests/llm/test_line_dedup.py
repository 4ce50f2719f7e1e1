from __future__ import annotations

import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from civicflow.llm import line_dedup
from civicflow.llm.bitmaps import SEGMENT, Seen, filters, gathered, hashes_of, maybe_in, words_for
from civicflow.llm.line_dedup import Lines, pieces, without_shared_lines
from civicflow.llm.queries import op12_bloom_lines
from tests.llm.conftest import LOWER, SF


def brute(rows: list[tuple], p: Lines) -> list[tuple]:
    """What (doc_id, text) rows keep, by counting whole keys in one place."""
    holders = defaultdict(list)
    key = lambda line: line.strip(" \t\n\v\f\r").translate(LOWER)
    for doc_id, text in rows:
        for k in {key(x) for x in (text or "").split("\n")}:
            if len(k) >= p.least_chars:
                holders[k].append(-1 if doc_id is None else doc_id)
    out = []
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        own = -1 if doc_id is None else doc_id
        lost = [len(h := holders.get(key(x), [])) >= p.least_docs and own != max(h) for x in lines]
        out.append((doc_id, len(lines), sum(lost), "\n".join(x for x, gone in zip(lines, lost) if not gone)))
    return sorted(out, key=str)


def found(docs, p: Lines = Lines()) -> list[tuple]:
    return sorted(map(tuple, without_shared_lines(docs, p).collect()), key=str)


@pytest.mark.parametrize("p", [Lines(), Lines(least_chars=1, least_docs=2), Lines(least_docs=1), Lines(most_bytes=8 * SEGMENT)])
def test_whole_table(documents, odd, p):
    for docs in (documents, odd):
        assert found(docs, p) == brute([tuple(r) for r in docs.select("doc_id", "text").collect()], p)


def test_a_full_filter_changes_nothing(documents, monkeypatch):
    everything = lambda parts, words, which: np.full(words, np.uint64(2**64 - 1))
    monkeypatch.setattr(line_dedup, "gathered", everything)
    assert found(documents) == brute([tuple(r) for r in documents.select("doc_id", "text").collect()], Lines())


def test_ends_case_and_length_of_lines(spark):
    line = "Ärger mit 20 Zeichen"
    texts = [line, f"\t {line.replace('Z', 'z')}\r", f"x\n{line}\n{line}\n", line.replace("Ä", "ä"), line[:-1], "", None]
    texts += [line[:-1]] * 3 + ["\n\n", f"a\n\n{line}"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id int, text string")
    got = {r.doc_id: r for r in without_shared_lines(df).collect()}
    assert found(df) == brute(list(enumerate(texts)), Lines())
    assert (got[0].text, got[0].n_dropped) == ("", 1) and got[2].text == "x\n" and got[11].n_dropped == 0
    assert got[6].n_lines == 1 and got[10].n_lines == 3 and got[3].n_dropped == 0


def test_hot_line_and_repeated_rows(spark):
    line = "a line that is in a third of all of the rows"
    rows = [(k // 2, f"own words of the row number {k}\n{line if k % 3 == 0 else 'none'}") for k in range(600)]
    rows += [(7, f"{line}\n{line}")] * 300 + [(None, line)] * 3
    df = spark.createDataFrame(rows, "doc_id int, text string").repartition(7)
    assert found(df) == brute(rows, Lines())
    alone = spark.createDataFrame([(None, line)] * 4, "doc_id int, text string")
    assert [r.n_dropped for r in without_shared_lines(alone).collect()] == [0] * 4


def test_long_texts_go_in_pieces(spark, empty, monkeypatch):
    for text in (b"", b"\n", b"a" * 50, b"ab\n" * 40, b"\n" * 30, b"x" * 40 + b"\ny"):
        whole = [text[k:] for k in range(3)]
        monkeypatch.setattr(line_dedup, "STRETCH", 8)
        assert [sum(pieces(t), []) for t in whole] == [t.split(b"\n") for t in whole]
    monkeypatch.undo()
    rows = [(k, "\n".join(f"line of a long text, number {j % 40_000}" for j in range(120_000))) for k in range(3)]
    df = spark.createDataFrame(rows, "doc_id int, text string")
    assert [r.n_dropped for r in without_shared_lines(df).orderBy("doc_id").collect()] == [120_000, 120_000, 0]
    assert without_shared_lines(empty).collect() == []


def test_filters_miss_no_repeat(spark):
    rng = random.Random(5)
    words = words_for(3000, 1 << 20)
    once = [rng.getrandbits(64) for _ in range(2000)]
    again = [rng.getrandbits(64) for _ in range(300)]
    values = [v - 2**63 for v in once + again + again]
    df = spark.createDataFrame([(v,) for v in values], "h bigint").repartition(9)
    parts = filters(df, words)
    unsigned = lambda vs: np.array([(v - 2**63) % 2**64 for v in vs], np.uint64)
    first, second = gathered(parts, words, "once"), gathered(parts, words, "twice")
    assert maybe_in(first, unsigned(once + again)).all() and maybe_in(second, unsigned(again)).all()
    assert maybe_in(second, unsigned(once)).mean() < 0.05
    assert maybe_in(first, np.array([rng.getrandbits(64) for _ in range(2000)], np.uint64)).mean() < 0.05
    seen = Seen(SEGMENT)
    seen.add(unsigned(again + again[:5]))
    seen.add(unsigned(again[5:9]))
    assert maybe_in(seen.twice, unsigned(again[:9])).all()
    assert hashes_of(pa.array([b"12345678abcdefgh", b""]), 16).tobytes() == b"12345678"
    assert words_for(10**12, 1 << 20) * 8 <= 1 << 20 and words_for(0, 1 << 20) == SEGMENT


def test_the_query_covers_all_rows(spark, documents):
    got = op12_bloom_lines(spark, SF)
    assert got.count() == documents.count()
    assert got.agg(F.sum("n_dropped")).first()[0] > 0
