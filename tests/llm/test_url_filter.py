from __future__ import annotations

import pytest

from civicflow.llm.queries import URL_RULES, op10_url_logistic
from civicflow.llm.url_filter import fit, judge
from tests.llm.conftest import SF


def by_hand(url: str | None) -> tuple[str, str, str | None]:
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", "", None
    cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:].split("?")[0].split("#")[0]
    fits = []
    for rule in URL_RULES:
        of_host, _, of_path = rule.partition("/")
        if (host == of_host or host.endswith("." + of_host)) and path.startswith("/" + of_path):
            fits.append(rule)
    return host, path, max(fits, key=len, default=None)


URLS = [
    None, "", "no mark", "http://", "http://ORG", "http://org/", "https://a.Example.org/es/1?x#y", "http://example.org/es",
    "http://example.org/en/12", "http://notexample.org/en/1", "x://com/fr/?q", "x://b.com/de/#f", "x://com.de/de/",
    "x://example.com?u=http://org/", "x://É.org/", "x://org:80/", "a://b://c.org/",
]


@pytest.fixture(scope="module")
def model(spark):
    rows = [(f"http://site{k}.com/shop/buy{k}", 1) for k in range(40)] + [(f"http://h{k}.net/wiki/{k}", 0) for k in range(40)]
    return fit(spark.createDataFrame(rows + [(None, None)], "url string, block int"))


def test_rules(spark, model):
    df = spark.createDataFrame([(k, u) for k, u in enumerate(URLS)], "page_id int, url string")
    got = judge(df, URL_RULES, model).collect()
    for r in got:
        host, path, rule = by_hand(URLS[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == (URL_RULES[rule] if rule else "block" if r.block_score >= 0.5 else "allow")


def test_held_out_urls(spark, model):
    rows = [(k, f"https://other{k}.com/shop/buy{k}x") for k in range(30)] + [(100 + k, f"https://n{k}.net/wiki/z{k}") for k in range(30)]
    got = judge(spark.createDataFrame(rows, "page_id int, url string"), {}, model).collect()
    assert all(r.rule is None and r.verdict == ("block" if r.page_id < 100 else "allow") for r in got)


def test_whole_table(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    got = {r.page_id: r for r in op10_url_logistic(spark, SF).collect()}
    assert len(got) == len(pages)
    for p in pages:
        r = got[p.page_id]
        assert (r.host, r.path, r.rule) == by_hand(p.url) and 0 <= r.block_score <= 1


def test_odd_tables(spark, model):
    df = spark.createDataFrame([(None, None), (1, "x://" + "a" * 50000), (1, "x://" + "a" * 50000)], "page_id int, url string")
    df = df.selectExpr("*", "'h' AS host", "'r' AS rule", "'p' AS path")
    got = judge(df, URL_RULES, model).collect()
    assert len(got) == 3 and got[1].block_score == got[2].block_score
    assert judge(df.limit(0), URL_RULES, model).collect() == []
    for rows, verdict in (([], "allow"), ([("x://a", 1)], "block"), ([("x://a", 0), ("x://b", 5)], "allow")):
        only = fit(spark.createDataFrame(rows, "url string, block int"))
        assert {r.verdict for r in judge(df, {}, only).collect()} == {verdict}
