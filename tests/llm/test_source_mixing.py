from __future__ import annotations

import hashlib
from collections import Counter, defaultdict

import duckdb
import pytest

from civicflow.llm.queries import MIX, ORACLES, op3_source_mixing
from civicflow.llm.source_mixing import Mix, budgets, mixed
from tests.llm.conftest import SF, WORD


def pour(budget: int, children: list[tuple]) -> dict:
    """Budgets of children (name, weight, supply), filled up one by one."""
    out, left = {}, list(children)
    while left:
        total = sum(w for _, w, _ in left)
        full = [c for c in left if c[2] * total <= c[1] * budget]
        if not full:
            return out | {n: w * budget // total if total else 0 for n, w, _ in left}
        first = min(full, key=lambda c: c[2] / c[1] if c[1] else 0)
        out[first[0]] = first[2]
        budget -= first[2]
        left.remove(first)
    return out


def brute(rows: list, m: Mix) -> Counter:
    """(doc_id, source) of every copy."""
    leaves = defaultdict(list)
    for r in rows:
        leaf = (m.domains.get(r.source, "other"), r.lang, r.source)
        leaves[leaf].append((r.doc_id, len(WORD.findall(r.text or ""))))
    tokens = {k: sum(n for _, n in v) for k, v in leaves.items()}
    given = {(): sum(tokens.values()) * m.percent // 100}
    for level, weights in enumerate((m.domain_weights, m.lang_weights, m.source_weights)):
        below = {}
        for parent in given:
            names = {k[: level + 1] for k in leaves if k[:level] == parent}
            supply = {n: m.epochs * sum(t for k, t in tokens.items() if k[: level + 1] == n) for n in names}
            ordered = sorted(names, key=lambda n: (n[-1] is not None, n[-1] or ""))
            below |= pour(given[parent], [(n, weights.get(n[-1], 1), supply[n]) for n in ordered])
        given = below
    out: Counter = Counter()
    for leaf, docs in leaves.items():
        epochs = given[leaf] // tokens[leaf] if tokens[leaf] else 0
        rest = given[leaf] - epochs * tokens[leaf]
        place = lambda d: hashlib.md5(":".join([str(m.seed), str(epochs)] + ([] if d is None else [str(d)])).encode()).hexdigest()  # noqa: B023, E731, E501
        by_place = defaultdict(list)
        for doc_id, n in docs:
            by_place[place(doc_id)].append((doc_id, n))
        through, copies = 0, {}
        for at in sorted(by_place):
            through += sum(n for _, n in by_place[at])
            copies[at] = epochs + (through <= rest)
        for doc_id, _ in docs:
            out[doc_id, leaf[2]] += copies[place(doc_id)]
    return +out


MIXES = [
    MIX,
    Mix(percent=30),
    Mix(percent=150, epochs=3, lang_weights={"en": 1, "de": 9, "fr": 0}, source_weights={"src3": 40}),
    Mix(percent=500, epochs=2),
    Mix(domains={"src1": "a", "src2": "a"}, domain_weights={"a": 100, "other": 1}, percent=60, seed=5),
]


@pytest.mark.parametrize("m", MIXES)
def test_whole_table(documents, m):
    want = brute(documents.collect(), m)
    assert Counter((r.doc_id, r.source) for r in mixed(documents, m).collect()) == want


def test_odd_rows(odd, empty):
    for m in MIXES:
        out = mixed(odd, m)
        assert out.columns == odd.columns
        assert Counter((r.doc_id, r.source) for r in out.collect()) == brute(odd.collect(), m)
        assert mixed(empty, m).collect() == []


def test_shortages_go_to_siblings_first(spark):
    rows = [("a", "x", "s1", 10), ("a", "x", "s2", 1000), ("a", "y", "s3", 1000), ("b", "x", "s4", 1000)]
    leaves = spark.createDataFrame(rows, "_domain string, _lang string, _source string, tokens bigint")
    got = {r._source: r.budget for r in budgets(leaves, Mix(percent=20, epochs=1)).collect()}
    assert got == {"s1": 10, "s2": 140, "s3": 150, "s4": 301}  # s1's shortage stays in its language


def test_children_without_weight_are_no_supply(spark):
    rows = [("a", "x", "s1", 1000), ("a", "x", "s2", 10), ("a", "y", "s3", 1000), ("b", "x", "s1", 500), ("b", "x", "s4", 1000)]
    leaves = spark.createDataFrame(rows, "_domain string, _lang string, _source string, tokens bigint")
    got = lambda m: {(r._domain, r._lang, r._source): r.budget for r in budgets(leaves, m).collect()}
    a1, a2, a3, b1, b4 = (r[:3] for r in rows)
    m = Mix(percent=20, epochs=1, source_weights={"s1": 0})
    assert got(m) == {a1: 0, a2: 10, a3: 341, b1: 0, b4: 351}  # to the sibling language
    m = Mix(percent=20, epochs=1, lang_weights={"y": 0}, source_weights={"s1": 0})
    assert got(m) == {a1: 0, a2: 10, a3: 0, b1: 0, b4: 692}  # and up to the other domain


def test_sql_says_the_same(spark):
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    got = op3_source_mixing(spark, SF)
    names = ", ".join(got.columns)
    want = duck.execute(f"SELECT {names} FROM ({ORACLES['op3_source_mixing']})").fetchall()
    assert Counter(map(tuple, got.collect())) == Counter(want)
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString()
