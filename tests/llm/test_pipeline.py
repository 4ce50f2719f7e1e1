from __future__ import annotations

from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken

import corpus_pipeline
from civicflow.llm import quality_classifier
from civicflow.llm.byte_bpe import Encoder
from civicflow.llm.queries import MIX, byte_ranks, quality_labels
from civicflow.llm.repetition_rules import Limits
from tests.llm import test_near_duplicates, test_repetition_rules, test_source_mixing
from tests.llm.conftest import SF


def test_stages_are_in_order():
    assert [f.__name__ for _, f in corpus_pipeline.STAGES] == [
        "good_quality", "little_repetition", "no_near_duplicates", "target_mix", "to_tokens",
    ]


def test_each_stage_by_brute_force(spark, documents):
    docs = documents
    model = quality_classifier.fit(docs, quality_labels(spark, SF))
    steps = {}
    for (_, stage), name in zip(corpus_pipeline.STAGES, "abcde"):
        out = stage(spark, docs, SF)
        if name != "e":
            assert out.columns == documents.columns
        steps[name] = (docs.collect(), out.collect())
        docs = spark.createDataFrame(steps[name][1], out.schema)

    before, after = steps["a"]
    score = model.scores(pa.array([r.text for r in before]))
    assert Counter(after) == Counter(r for r, s in zip(before, score) if s >= 0.7)
    before, after = steps["b"]
    verdict = [test_repetition_rules.verdict(test_repetition_rules.brute(r.text, Limits()), Limits())[1] for r in before]
    assert Counter(after) == Counter(r for r, v in zip(before, verdict) if v)
    before, after = steps["c"]
    groups = test_near_duplicates.brute([(r.doc_id, r.text) for r in before], 5)
    assert {r.doc_id for r in after} == {k for k, (_, c) in groups.items() if k == c} and len(after) < len(before)
    before, after = steps["d"]
    assert Counter((r.doc_id, r.source) for r in after) == test_source_mixing.brute(before, MIX)
    before, after = steps["e"]
    own = Encoder(byte_ranks(), public_tokenizers.PATTERN)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own.rank, special_tokens={})
    want = Counter((r.doc_id, np.array(library.encode_ordinary(r.text), "<u4").tobytes()) for r in before)
    assert Counter((r.doc_id, bytes(r.ids)) for r in after) == want
    assert all(r.decodes and r.decoded_sha256 == r.text_sha256 for r in after)
    assert Counter((r.doc_id, bytes(r.ids)) for r in corpus_pipeline.run(spark, SF).collect()) == want


def test_clean_documents_stay(spark, documents):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    good = corpus_pipeline.good_quality(spark, documents, SF)
    kept = {r.doc_id for r in good.collect()}
    clean = [k for k, q in labels.items() if q == 1]
    assert len(kept.intersection(clean)) > 0.95 * len(clean)
    assert len(kept.intersection(k for k, q in labels.items() if q == 0)) < 0.3 * (len(labels) - len(clean))


def test_odd_and_empty_documents_pass_every_stage(spark, odd, empty):
    for docs in (odd, empty):
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, SF)
            if k < 4:
                assert out.columns == docs.columns
            assert out.count() <= 2 * docs.count()
