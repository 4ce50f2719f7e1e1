from __future__ import annotations

from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from civicflow.llm.token_shards import Layout, permute, read_slots, write_shards, write_shuffled


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 1000])
def test_permutation(n):
    for key in (1, 2, 2**70):
        assert sorted(permute(np.arange(n), n, key).tolist()) == list(range(n))
    if n > 60:
        assert permute(np.arange(n), n, 1).tolist() != permute(np.arange(n), n, 2).tolist()
        assert abs(np.corrcoef(np.arange(n), permute(np.arange(n), n, 1))[0, 1]) < 0.4


def back(rows: list, p: Layout, manifest: list) -> list[bytes]:
    """The documents' ids, by undoing the permutation of each shard and cutting at the end ids."""
    kind = np.dtype(f"<u{p.width}")
    by_shard = defaultdict(dict)
    for r in rows:
        by_shard[r.shard][r.slot] = bytes(r.ids)
    out = []
    for m in manifest:
        held = by_shard[m.shard]
        at = m.first_slot + permute(np.arange(m.n_sequences), m.n_sequences, p.key + m.shard)
        stream = np.frombuffer(b"".join(held[s] for s in at.tolist()), kind)
        assert (stream[m.n_ids :] == p.pad).all()
        cuts = np.flatnonzero(stream[: m.n_ids] == p.end)
        assert len(cuts) == m.n_docs and cuts[-1] == m.n_ids - 1
        out += [part.tobytes() for part in np.split(stream[: m.n_ids], cuts + 1)[:-1]]
    return out


@pytest.mark.parametrize("p", [Layout(), Layout(length=64, shard_bytes=20_000), Layout(length=10, shard_bytes=50_000, key=3)])
def test_round_trip(tmp_path, spark, documents, p):
    path = str(tmp_path / "out")
    manifest = sorted(write_shards(documents, F.col("text").cast("binary"), path, p).collect())
    rows = read_slots(spark, path, p).collect()
    assert sorted(r.slot for r in rows) == list(range(len(rows)))
    assert [m.first_slot for m in manifest] == np.cumsum([0] + [m.n_sequences for m in manifest])[:-1].tolist()
    want = sorted(r.text.encode() + b"\xff" for r in documents.collect())
    assert sorted(back(rows, p, manifest)) == want
    files = sorted((tmp_path / "out" / "shards").glob("part-*"))
    assert [f.stat().st_size for f in files] == [m.n_sequences * p.stride for m in manifest]
    some = read_slots(spark, path, p, first=3, last=9).collect()
    assert {r.slot: bytes(r.ids) for r in some} == {r.slot: bytes(r.ids) for r in rows if 3 <= r.slot < 9}


def test_same_slots_whatever_the_partitions(tmp_path, spark, documents):
    p, found = Layout(length=100, shard_bytes=30_000), []
    for k, df in enumerate((documents, documents.repartition(7, "lang"))):
        write_shards(df, F.col("text").cast("binary"), str(tmp_path / str(k)), p)
        found.append(sorted(map(tuple, read_slots(spark, str(tmp_path / str(k)), p).collect())))
    assert found[0] == found[1]


def test_odd_rows_and_wide_ids(tmp_path, spark, odd, empty):
    p = Layout(length=50, shard_bytes=4000)
    manifest = sorted(write_shards(odd, F.col("text").cast("binary"), str(tmp_path / "odd"), p).collect())
    rows = read_slots(spark, str(tmp_path / "odd"), p).collect()
    assert sorted(back(rows, p, manifest)) == sorted((r.text or "").encode() + b"\xff" for r in odd.collect())
    assert write_shards(empty, F.col("text").cast("binary"), str(tmp_path / "none"), p).collect() == []
    assert read_slots(spark, str(tmp_path / "none"), p).collect() == []
    wide = spark.createDataFrame([(1, bytes(range(1, 9)) * 30), (2, b"")], "doc_id int, ids binary")
    q = Layout(length=7, width=4, end=50256, pad=50257, shard_bytes=64)
    manifest = sorted(write_shards(wide, F.col("ids"), str(tmp_path / "wide"), q).collect())
    got = back(read_slots(spark, str(tmp_path / "wide"), q).collect(), q, manifest)
    end = (50256).to_bytes(4, "little")
    assert sorted(got) == sorted([bytes(range(1, 9)) * 30 + end, end])


def test_an_id_on_half_of_the_rows_fills_no_shard(tmp_path, spark, documents, monkeypatch):
    from civicflow.llm import token_shards

    monkeypatch.setattr(token_shards, "GROUP", 3)
    text = F.concat("text", F.lit(" of one id, "), F.col("doc_id").cast("string"))
    one = documents.select(F.lit(1).cast("bigint").alias("doc_id"), F.substring(text, -900, 900).alias("text"))
    docs = documents.select("doc_id", F.substring("text", 1, 900).alias("text")).union(one)
    p = Layout(length=100, shard_bytes=20_000)
    manifest = sorted(write_shards(docs, F.col("text").cast("binary"), str(tmp_path / "a"), p).collect())
    assert max(m.n_ids for m in manifest) <= 2 * p.shard_bytes and len(manifest) > 6
    assert [m.first_slot for m in manifest] == np.cumsum([0] + [m.n_sequences for m in manifest])[:-1].tolist()
    rows = read_slots(spark, str(tmp_path / "a"), p).collect()
    assert sorted(back(rows, p, manifest)) == sorted(r.text.encode() + b"\xff" for r in docs.collect())


def test_settings_of_the_session_do_not_split_shards(tmp_path, spark, documents):
    p = Layout(length=64, shard_bytes=20_000)
    spark.conf.set("spark.sql.files.maxRecordsPerFile", "50")
    try:
        manifest = write_shards(documents, F.col("text").cast("binary"), str(tmp_path / "a"), p).collect()
        rows = read_slots(spark, str(tmp_path / "a"), p).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")
    assert len(rows) == sum(m.n_sequences for m in manifest) and min(len(r.ids) for r in rows) == 64
    file = next((tmp_path / "a" / "shards").glob("part-*"))
    file.write_bytes(file.read_bytes()[:-65])
    (tmp_path / "a" / "shards" / f".{file.name}.crc").unlink()
    with pytest.raises(Exception, match="does not hold its shard"):
        read_slots(spark, str(tmp_path / "a"), p).collect()


def plain_permute(index: int, n: int, key: int, rounds: int = 6) -> int:
    """The permutation of one number, in whole numbers of Python."""
    mask64 = 2**64 - 1

    def mixed(x: int) -> int:
        x = (x ^ x >> 33) * 0xFF51AFD7ED558CCD & mask64
        x = (x ^ x >> 33) * 0xC4CEB9FE1A85EC53 & mask64
        return x ^ x >> 33

    half = max(1, ((n - 1).bit_length() + 1) // 2)
    keys = [mixed((k + key * 0x9E3779B97F4A7C15) & mask64) for k in range(1, rounds + 1)]
    while True:
        left, right = index >> half, index & ((1 << half) - 1)
        for k in keys:
            left, right = right, left ^ mixed(right ^ k) & ((1 << half) - 1)
        index = left << half | right
        if index < n:
            return index


def test_permutation_against_plain_arithmetic():
    for n, key in ((1, 4), (10, 4), (1000, 20240501), (5000, 2**65 + 3)):
        assert permute(np.arange(n), n, key).tolist() == [plain_permute(k, n, key) for k in range(n)]


def unshuffled(spark, path: str, rows: list, p: Layout) -> list[bytes]:
    """The documents' ids, by undoing one permutation of all slots, in plain arithmetic."""
    kind, by_slot, out = np.dtype(f"<u{p.width}"), {r.slot: bytes(r.ids) for r in rows}, []
    for m in sorted(spark.read.parquet(f"{path}/ranges").collect()):
        numbers = range(m.first_slot, m.first_slot + m.n_sequences)
        stream = np.frombuffer(b"".join(by_slot[plain_permute(k, len(rows), p.key)] for k in numbers), kind)
        assert (stream[m.n_ids :] == p.pad).all()
        cuts = np.flatnonzero(stream[: m.n_ids] == p.end)
        assert len(cuts) == m.n_docs and cuts[-1] == m.n_ids - 1
        out += [part.tobytes() for part in np.split(stream[: m.n_ids], cuts + 1)[:-1]]
    return out


def test_one_permutation_over_all_shards(tmp_path, spark, documents):
    p = Layout(length=100, shard_bytes=20_000)
    found = []
    for k, df in enumerate((documents, documents.repartition(7, "lang"))):
        path = str(tmp_path / str(k))
        manifest = sorted(write_shuffled(df, F.col("text").cast("binary"), path, p).collect())
        rows = read_slots(spark, path, p).collect()
        assert sorted(r.slot for r in rows) == list(range(len(rows)))
        assert all(r.shard == r.slot // 200 for r in rows)
        assert [m.n_sequences for m in manifest[:-1]] == [200] * (len(manifest) - 1) and len(manifest) > 10
        assert sorted(unshuffled(spark, path, rows, p)) == sorted(r.text.encode() + b"\xff" for r in documents.collect())
        sizes = sorted(f.stat().st_size for f in (tmp_path / str(k) / "shards").glob("*/part-*"))
        assert sizes == sorted(m.n_sequences * p.stride for m in manifest)
        found.append(sorted(map(tuple, rows)))
        some = read_slots(spark, path, p, first=190, last=410).collect()
        assert sorted(map(tuple, some)) == found[0][190:410]
    assert found[0] == found[1]
    # A range's sequences, and so a long document's, are in shards all over, not in one.
    first = min(spark.read.parquet(f"{tmp_path}/0/ranges").collect())
    assert len({plain_permute(k, len(found[0]), p.key) // 200 for k in range(first.n_sequences)}) > 10


def test_odd_rows_and_wide_ids_over_all_shards(tmp_path, spark, odd, empty):
    p = Layout(length=50, shard_bytes=4000)
    write_shuffled(odd, F.col("text").cast("binary"), str(tmp_path / "odd"), p)
    rows = read_slots(spark, str(tmp_path / "odd"), p).collect()
    want = sorted((r.text or "").encode() + b"\xff" for r in odd.collect())
    assert sorted(unshuffled(spark, str(tmp_path / "odd"), rows, p)) == want
    assert write_shuffled(empty, F.col("text").cast("binary"), str(tmp_path / "none"), p).collect() == []
    assert read_slots(spark, str(tmp_path / "none"), p).collect() == []
    wide = spark.createDataFrame([(1, bytes(range(1, 9)) * 30), (2, b"")], "doc_id int, ids binary")
    q = Layout(length=7, width=4, end=50256, pad=50257, shard_bytes=64)
    write_shuffled(wide, F.col("ids"), str(tmp_path / "wide"), q)
    got = unshuffled(spark, str(tmp_path / "wide"), read_slots(spark, str(tmp_path / "wide"), q).collect(), q)
    end = (50256).to_bytes(4, "little")
    assert sorted(got) == sorted([bytes(range(1, 9)) * 30 + end, end])
