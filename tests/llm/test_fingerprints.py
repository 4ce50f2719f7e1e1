from __future__ import annotations

from hashlib import sha256

import pytest

from civicflow.llm.order_minhash import Sketch, as_hex, edited, fingerprint, fingerprints, from_hex, likeness


def brute(rows: list[tuple]) -> list[tuple]:
    rows = sorted(((k, t or "") for k, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    out = []
    for k, (doc_id, text) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        new = text[: len(text) - len(text) // 2] + after[: len(text) // 2]
        a, b, c = fingerprint(text), fingerprint(new), fingerprint(after)
        sha = sha256(new.encode()).hexdigest()
        out.append((doc_id, len(text), sha, as_hex(a), as_hex(b), likeness(a, b), likeness(a, c)))
    return sorted(out, key=str)


@pytest.mark.parametrize("buckets", [1, 3, 40])
def test_next_and_edited_texts(documents, buckets):
    got = sorted(map(tuple, fingerprints(documents, buckets=buckets).collect()), key=str)
    assert got == brute([(r.doc_id, r.text) for r in documents.collect()])


def test_odd_rows(odd, empty, spark):
    got = sorted(map(tuple, fingerprints(odd).collect()), key=str)
    assert got == brute([(r.doc_id, r.text) for r in odd.collect()])
    assert fingerprints(empty).collect() == []
    one = fingerprints(spark.createDataFrame([(9, "abcdef")], "doc_id int, text string")).collect()
    assert [(r.n_chars, r.near_next) for r in one] == [(6, 1.0)]
    none = spark.createDataFrame([(None, "b"), (None, "a")], "doc_id bigint, text string")
    assert [r.n_chars for r in fingerprints(none).collect()] == [1, 1]


def test_likeness_feels_order():
    text = " ".join(f"word{k}" for k in range(400))
    words = text.split()
    s = Sketch()
    same = fingerprint(text, s)
    near = fingerprint(" ".join(words[:200] + ["other"] + words[201:]), s)
    swapped = fingerprint(" ".join(words[200:] + words[:200]), s)
    other = fingerprint(" ".join(f"term{k}" for k in range(400, 800)), s)
    assert likeness(same, same) == 1.0
    assert likeness(same, near) > likeness(same, swapped) > likeness(same, other)
    assert likeness(same, near) > 0.8 and likeness(same, other) < 0.1
    assert likeness(fingerprint(""), fingerprint("")) == 1.0 and likeness(fingerprint(""), same) == 0.0
    assert (from_hex(as_hex(same)) == same).all()
    assert edited("abcde", "x") == "abcx" and edited("", "x") == ""
