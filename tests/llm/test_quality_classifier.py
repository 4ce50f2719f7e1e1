from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from civicflow.llm.quality_classifier import Settings, _descend, classify, collected, fit, place_sets, sample
from civicflow.llm.queries import op1_naive_bayes_svm

SF = "/root/testdata/sf0.01"


def auc(score: list[float], label: list[int]) -> float:
    good = [s for s, y in zip(score, label) if y]
    bad = [s for s, y in zip(score, label) if not y]
    return np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])


def test_held_out_accuracy(spark):
    rows = {r.doc_id: r for r in op1_naive_bayes_svm(spark, SF).collect()}
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    labels = spark.read.parquet(f"{SF}/labels.parquet").collect()
    held = [(rows[r.doc_id], r.quality) for r in labels if rows[r.doc_id].held_out]
    assert auc([r.score for r, _ in held], [y for _, y in held]) > 0.97
    assert np.mean([r.predicted == y for r, y in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows.values())


def test_labels_of_held_out_rows_have_no_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2
    one = labels.where(~held).select("doc_id", F.col("quality").alias("label"))
    model = fit(docs, one)
    again = fit(docs.repartition(5), one.repartition(3))
    assert np.array_equal(model.weights, again.weights) and model.slope == again.slope


def test_odd_rows(spark, odd, empty):
    rows = [(5, 1), (6, 1), (4, 0), (8, 0), (7, 0), (None, 1), (1, None), (2, 7)]
    labels = spark.createDataFrame(rows, "doc_id bigint, label int")
    got = classify(odd, labels).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id in (1, 2)}) == 1
    assert len({r.score for r in got if r.doc_id == 4}) == 1
    assert classify(empty, labels).collect() == []
    for few, score in (([], 0.5), ([(5, 1), (6, 1)], 1.0), ([(5, 0), (6, 0)], 0.0)):
        got = classify(odd, spark.createDataFrame(few, "doc_id bigint, label int")).collect()
        assert all(abs(r.score - score) < 1e-3 for r in got)


def test_places_are_distinct_and_the_whole_text_counts():
    text = "abc " * 10
    one, two, three = place_sets(pa.array([text, text + "z" * 3000 + "!", None]), 3, 17)
    assert len(set(one.tolist())) == len(one)
    assert set(one.tolist()) - set(two.tolist()) == set() and len(two) > len(one)
    assert len(three) == 0


@pytest.mark.parametrize("cost", [0.1, 10.0])
def test_descent_reaches_the_least_loss(cost):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 5))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = np.where(x[:, 0] + 0.3 * rng.normal(size=60) > 0, 1.0, -1.0)
    w, b = _descend([(np.arange(5), row) for row in x], y, np.full(60, cost), 5, 4000)

    def loss(w, b):
        return 0.5 * (w @ w + b * b) + cost * np.maximum(0, 1 - y * (x @ w + b)).sum()

    best = loss(w, b)
    for _ in range(300):
        assert best <= loss(w + 0.01 * rng.normal(size=5), b + 0.01 * rng.normal()) * (1 + 1e-5)


def test_sample_is_bounded(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    from civicflow.llm.quality_classifier import sample

    counts = sample(docs, labels, Settings(sample=7)).groupBy("label").count().collect()
    assert {r.label: r["count"] for r in counts} == {0: 7, 1: 7}


def test_one_row_counts_for_an_id_that_is_repeated(spark):
    rows = [(1, f"text number {k} of one id") for k in range(500)] + [(k, f"other text {k}") for k in range(2, 9)]
    docs = spark.createDataFrame(rows, "doc_id int, text string").repartition(5)
    labels = spark.createDataFrame([(k, k % 2) for k in range(1, 9)], "doc_id int, label int")
    found = sample(docs, labels, Settings(sample=2)).collect()
    assert sorted(r.label for r in found) == [0, 0, 1, 1]
    whole = sample(docs, labels, Settings()).collect()
    assert len(whole) == 8
    again = sample(docs.repartition(3), labels, Settings()).collect()
    assert sorted(map(tuple, whole)) == sorted(map(tuple, again))


def test_bitmaps_are_compressed_on_their_way_to_the_driver(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    own, came = type(docs).collect, []

    def collect(df):
        came.extend(rows := own(df))
        return rows

    monkeypatch.setattr(type(docs), "collect", collect)
    model = fit(docs, labels)
    sizes = [len(r.bits) for r in came if "bits" in r]
    assert sizes and sum(sizes) < len(sizes) * (1 << model.bits) / 8 / 2


def test_sampled_sets_are_whole(spark):
    texts = {k: f"text {k} of some words " * k for k in range(1, 9)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id int, text string").repartition(3)
    labels = spark.createDataFrame([(k, k % 2) for k in texts], "doc_id int, label int")
    s = Settings()
    sets, y = collected(sample(docs, labels, s))
    want = place_sets(pa.array(texts.values()), s.longest, s.bits)
    found = sorted((side, tuple(x)) for x, side in zip(sets, y))
    assert found == sorted((1.0 if k % 2 else -1.0, tuple(sorted(x))) for k, x in zip(texts, want))
