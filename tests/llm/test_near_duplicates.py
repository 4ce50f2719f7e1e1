from __future__ import annotations

import random
from collections import Counter, defaultdict

import duckdb
import pytest

from civicflow.llm import minhash_dedup
from civicflow.llm.components import components
from civicflow.llm.minhash_dedup import Near, near_duplicates, without_near_duplicates
from civicflow.llm.workers import map_batches
from tests.llm.conftest import LOWER, WORD


def brute(rows: list[tuple], width: int, percent: int = 80) -> dict:
    """doc_id: (size of the set, smallest doc_id reachable), by comparing all pairs."""
    sets = {}
    for k, text in rows:
        ws = WORD.findall((text or "").translate(LOWER))
        sets[k] = {tuple(ws)} if 0 < len(ws) < width else set(zip(*(ws[i:] for i in range(width))))
    root = {k: k for k in sets}

    def find(x):
        return x if root[x] == x else find(root[x])

    at = defaultdict(list)
    for k in sorted(sets):
        common = Counter(j for s in sets[k] for j in at[s])
        for j, c in common.items():
            if 100 * c >= percent * (len(sets[k]) + len(sets[j]) - c):
                a, b = find(j), find(k)
                root[max(a, b)] = min(a, b)
        for s in sets[k]:
            at[s].append(k)
    return {k: (len(sets[k]), find(k)) for k in sets}


@pytest.mark.parametrize("few", [200_000, 0])
def test_one_text_of_each_class_is_verified(spark, monkeypatch, few):
    long = " ".join(f"w{k}" for k in range(60))
    rows = [(1, long)] * 50 + [(None, f"{long} null")] * 50 + [(1, f"{long} {k}") for k in range(20)] + [(2, f"{long} x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    met = []

    def spy(df, run, schema):
        if schema == "a bigint, b bigint":
            met.append(df.count())
        return map_batches(df, run, schema)

    monkeypatch.setattr(minhash_dedup, "map_batches", spy)
    monkeypatch.setattr(minhash_dedup, "FEW_NODES", few, raising=False)
    out = near_duplicates(docs, Near(width=4)).collect()
    assert len(out) == len(rows) and {r.component_id for r in out} == {1}
    assert met == [23]


@pytest.fixture(scope="module")
def family(spark):
    """A family of edited copies, a chain of them, exact copies and strangers."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    base = [word() for _ in range(60)]
    rows = []
    for k in range(60):
        text = list(base)
        for _ in range(rng.randint(0, 4)):
            text[rng.randrange(60)] = word()
        rows.append((1000 - k, " ".join(text)))
    chain = [word() for _ in range(80)]
    for k in range(12):
        rows.append((2000 + k, "\n".join(chain[k : k + 60])))
    rows += [(3000 + k, "An exact  copy of some words\tfor all " * 3) for k in range(20)]
    rows += [(4000 + k, " ".join(word() for _ in range(30))) for k in range(20)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "doc_id bigint, text string"), rows


@pytest.mark.parametrize("width", [4, 5])
@pytest.mark.parametrize("block", [1_000_000, 700])
def test_components_are_those_of_all_pairs(family, width, block):
    df, rows = family
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(df, Near(width=width, block=block)).collect()}
    assert got == brute(rows, width)


def test_whole_table(documents):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    got = near_duplicates(documents, Near(width=4)).collect()
    want = brute(rows, 4)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    kept = {r.doc_id for r in without_near_duplicates(documents).collect()}
    assert kept == {k for k, (_, c) in brute(rows, 5).items() if k == c}


def test_odd_rows(odd):
    got = near_duplicates(odd).collect()
    assert len(got) == odd.count()
    by_id = defaultdict(list)
    for r in got:
        by_id[r.doc_id].append(r)
    for k in (1, 2, 3):
        assert [(r.n_shingles, r.component_id, r.kept) for r in by_id[k]] == [(0, k, True)]
    assert [(r.component_id, r.kept) for r in by_id[4]] == [(4, True)] * 2
    assert by_id[6][0].component_id == 5 and not by_id[6][0].kept
    assert sorted((str(r.component_id), r.kept) for r in by_id[None]) == [("5", False), ("None", False), ("None", False)]
    out = without_near_duplicates(odd)
    assert out.columns == odd.columns
    assert sorted(str(r.doc_id) for r in out.collect()) == ["1", "2", "3", "4", "5", "7", "8", "None", "None"]


def test_empty_table(empty):
    assert near_duplicates(empty).collect() == []
    assert without_near_duplicates(empty).collect() == []


def test_components_of_chains_and_stars(spark):
    links = [(k, k + 1) for k in range(200)] + [(1000, 1001 + k) for k in range(300)] + [(5000, 5000)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert len({got[k] for k in range(201)}) == 1 and len({got[1000 + k] for k in range(301)}) == 1
    assert got[0] != got[1000] and 5000 not in got


def test_sql_says_the_same(spark, documents):
    from civicflow.llm.queries import ORACLES

    duck = duckdb.connect()
    duck.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    want = {tuple(r) for r in duck.execute(ORACLES["op9_minhash_near_dedup"]).fetchall()}
    assert {tuple(r) for r in near_duplicates(documents, Near(width=4)).collect()} == want
