"""Joins, reshaping, deduplication and geocoding."""

from __future__ import annotations

import random
from collections import Counter
from itertools import groupby

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from civicflow.operators import relate
from civicflow.operators.dedup import adjacent_runs_best, latest_per_key
from civicflow.operators.geocode import drop_outside_city, geocode, place_result, use_manual_position
from civicflow.operators.reshape import pivot_single, pivot_sum, share, unpivot


@pytest.mark.parametrize(
    "right, answers",
    [
        ([], {1: True, 3: True, None: True}),
        ([1, 2], {1: False, 3: True, None: None}),
        ([1, None], {1: False, 3: None, None: None}),
        ([None], {1: None, 3: None, None: None}),
    ],
)
def test_not_in_three_valued(spark, right, answers):
    left = spark.createDataFrame([(1,), (3,), (None,)], "k int")
    other = spark.createDataFrame([(v,) for v in right], "r int")
    mine = relate.not_in(left, F.col("k"), other, F.col("r"), "absent")
    assert {r.k: r.absent for r in mine.collect()} == answers
    kept = spark.sql("SELECT k FROM {l} WHERE k NOT IN (SELECT r FROM {o})", l=left, o=other)
    assert sorted(mine.filter("absent").select("k").collect(), key=str) == sorted(kept.collect(), key=str)


def test_null_safe_left_matches_nulls_and_keeps_duplicates(spark):
    left = spark.createDataFrame([("a", None), ("a", "x"), (None, None)], "k string, l string")
    right = spark.createDataFrame([("a", None, 1), ("a", None, 2), (None, None, 3)], "k string, l string, v int")
    out = relate.null_safe_left(left, right, ["k", "l"])
    want = {("a", None, 1), ("a", None, 2), ("a", "x", None), (None, None, 3)}
    assert {(r.k, r.l, r.v) for r in out.collect()} == want


def test_lookup_spread_equals_lookup_left(spark):
    left = spark.createDataFrame([(1, "a"), (2, None), (3, None), (4, "b"), (5, "z")], "i int, k string")
    right = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), (None, 9)], "k string, v int")
    plain = relate.lookup_left(left, right, "k").select("i", "k", "v")
    spread = relate.lookup_spread(left, right, ["k"]).select("i", "k", "v")
    assert sorted(plain.collect(), key=str) == sorted(spread.collect(), key=str)


def test_full_outer_equals_sparks(spark):
    left = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "n")], "k int, l string")
    right = spark.createDataFrame([(1, "x"), (1, "y"), (3, "z"), (None, "m")], "k int, r string")
    mine = relate.full_outer(left, right, ["k"]).select("k", "l", "r")
    theirs = left.join(right, ["k"], "outer").select("k", "l", "r")
    assert sorted(mine.collect(), key=str) == sorted(theirs.collect(), key=str)


def test_override_last_correction_wins(spark):
    df = spark.createDataFrame([("a", "old"), ("b", "old"), (None, "old")], "k string, v string")
    fixes = spark.createDataFrame([("a", "one", 1), ("a", "two", 2), (None, "no", 3)], "s string, n string, line int")
    out = relate.override_by_key(df, "k", "v", fixes, "s", F.col("n"), F.col("line"))
    assert {(r.k, r.v) for r in out.collect()} == {("a", "two"), ("b", "old"), (None, "old")}


def test_known_or_blank(spark):
    df = spark.createDataFrame(
        [("A", "9"), ("Z", "1"), ("Z", "9"), ("", "9"), ("Z", ""), (None, None), ("Z", None)], "city string, zip string"
    )
    known = spark.createDataFrame([("A", "1"), ("A", "2"), (None, None)], "city string, zip string")
    out = relate.known_or_blank(df, [("city", known, "city"), ("zip", known, "zip")])
    assert {tuple(r) for r in out.collect()} == {("A", "9"), ("Z", "1"), ("", "9"), ("Z", "")}


def test_null_tolerant_difference(spark):
    df = spark.createDataFrame([("75",), ("7",), (None,)], "d string")
    assert {r.d for r in df.filter(relate.differs(F.col("d"), "75")).collect()} == {"7", None}


def test_computed_replaces_and_adds(spark):
    df = spark.sql("SELECT 1 AS a, 2 AS b")
    out = relate.computed(df, {"a": F.col("a") + 10, "c": F.col("a") + F.col("b")})
    assert out.first().asDict() == {"a": 11, "b": 2, "c": 3}


def test_latest_per_key(spark):
    rows = [("a", 1, 5), ("a", 2, 3), ("a", 2, 4), ("b", None, 1), ("b", None, 0), (None, 3, 7), (None, 2, 8)]
    df = spark.createDataFrame(rows, "k string, d int, id int")
    out = latest_per_key(df, [F.col("k")], F.col("d"), [F.col("id")])
    assert {tuple(r) for r in out.collect()} == {("a", 2, 3), ("b", None, 0), (None, 3, 7)}


@pytest.mark.parametrize("seed", range(4))
def test_adjacent_runs_against_groupby(spark, seed):
    rng = random.Random(seed)
    rows = [
        (k, t, i, rng.choice(["x", "y", None]), rng.randint(0, 3))
        for i, (k, t) in enumerate((rng.choice("ab"), rng.randint(0, 40)) for _ in range(300))
    ]
    df = spark.createDataFrame(rows, "k string, t int, id int, v string, w int").repartition(3)
    slices = [F.floor(F.col("t") / 16), F.floor(F.col("t") / 4), F.col("t")]
    out = adjacent_runs_best(df, ["k"], slices, ["t", "id"], F.col("v"), F.col("w"))
    want = set()
    for k in "ab":
        mine = sorted((r for r in rows if r[0] == k), key=lambda r: (r[1], r[2]))
        for _, run in groupby(mine, key=lambda r: r[3]):
            want.add(min(run, key=lambda r: (r[4], r[1], r[2])))
    assert {tuple(r) for r in out.collect()} == want


def test_adjacent_runs_cross_the_whole_order(spark):
    df = spark.range(100).select(F.col("id").alias("t"), F.lit("same").alias("v"))
    slices = [F.floor(F.col("t") / 10), F.col("t")]
    out = adjacent_runs_best(df, [], slices, ["t"], F.col("v"), -F.col("t"))
    assert [r.t for r in out.collect()] == [99]


def test_pivot_fills_and_unpivot_densifies(spark):
    df = spark.createDataFrame([("g", "a", 1.0), ("g", "b", None), ("h", "a", 2.0), (None, "a", 5.0)], "k string, c string, v double")
    wide = pivot_single(df, ["k"], "c", ["a", "b", "z"], {"v": F.col("v")})
    assert {(r.k, r.a.v, r.b.v, r.z.v) for r in wide.collect()} == {("g", 1.0, 0.0, 0.0), ("h", 2.0, 0.0, 0.0)}
    sums = pivot_sum(df, ["k"], "c", {"a": "a", "b": "b"}, F.col("v"))
    long = unpivot(sums, ["k"], ["a", "b"], "c", "v")
    assert {tuple(r) for r in long.collect()} == {("g", "a", 1.0), ("g", "b", 0.0), ("h", "a", 2.0), ("h", "b", 0.0)}


def test_pivot_refuses_duplicates(spark):
    df = spark.createDataFrame([("g", "a", 1.0), ("g", "a", 2.0)], "k string, c string, v double")
    with pytest.raises(PySparkException, match="duplicate c a"):
        pivot_single(df, ["k"], "c", ["a"], {"v": F.col("v")}).collect()


def test_share_counts_null_as_no(spark):
    df = spark.createDataFrame([(1,), (None,), (0,), (2,)], "v int")
    assert share(df, F.col("v") > 0, "s").first().s == 0.5


POINTS = "house string, street string, borough string, zipcode string, lon double, lat double, xy_coord string, bbl string, bin string, norm_house string, norm_street string, is_pending boolean, return_code string"


def _geocoded(spark, rows):
    points = spark.createDataFrame(
        [
            ("1", "ELM ST", "Bronx", "1", -73.0, 40.0, None, "5", "6", "1", "ELM ST", False, None),
            ("2", "ELM ST", "Bronx", "1", -73.1, 40.1, None, "5", "6", "2", "ELM ST", True, None),
            ("3", "ELM ST", "Bronx", "1", -73.2, 40.2, None, "5", "6", "3", "ELM ST", False, "71"),
        ],
        POINTS,
    )
    places = spark.createDataFrame(
        [("9", "MUSEUM", "1", -73.9, 40.9, "7", "8")],
        "house string, street string, zipcode string, lon double, lat double, bbl string, bin string",
    )
    pairs = spark.createDataFrame(
        [("OAK ST", "ELM ST", "Bronx", "984250", "0")],
        "street_a string, street_b string, borough string, x string, y string",
    )
    df = spark.createDataFrame(rows, "i int, h string, s string, zip string, s1 string, s2 string, borough string")
    return geocode(
        df.withColumnRenamed("zip", "zipcode"),
        points,
        pairs,
        house="h",
        street="s",
        area="zipcode",
        places=places,
        street_1="s1",
        street_2="s2",
    )


def test_geocode_order_of_lookups(spark):
    out = _geocoded(
        spark,
        [
            (1, "1", "elm  st", "1", "", "", "Bronx"),
            (2, "2", "ELM ST", "1", "", "", "Bronx"),
            (3, "3", "ELM ST", "1", "", "", "Bronx"),
            (4, "9", "MUSEUM", "1", "", "", "Bronx"),
            (5, None, "nothing", "1", "elm st", "oak st", "BRONX"),
            (6, "", "", "", "elm st", "no st", "Bronx"),
            (7, "1", "ELM ST", "2", None, None, None),
            (8, "1", "ELM ST", "1", "elm st", "oak st", "Bronx"),
        ],
    )
    got = {r.i: (r.geo_function, r.geo_grc, r.geo_message) for r in out.collect()}
    assert got == {
        1: ("1B", "00", ""),
        2: ("1B-tpad", "00", ""),
        3: ("", "71", "NOT FOUND"),
        4: ("AP", "00", ""),
        5: ("Intersection", "00", ""),
        6: ("", "EE", "NOT FOUND"),
        7: ("", "EE", "NOT FOUND"),
        8: ("1B", "00", ""),
    }
    assert drop_outside_city(out).count() == 7
    placed = {r.i: r for r in place_result(out).collect()}
    assert placed[1].geom == "POINT (-73 40)" and placed[1].geo_address == "1 ELM ST"
    assert placed[5].geom.startswith("POINT (-74 40.1666666666") and placed[5].geo_address is None
    assert placed[6].geom is None and placed[6].geo_x_coord is None


def test_manual_position_only_where_nothing_was_found(spark):
    out = _geocoded(spark, [(1, "1", "ELM ST", "1", "", "", "Bronx"), (2, "x", "y", "1", "", "", "Bronx")])
    out = place_result(use_manual_position(out.withColumn("longitude", F.lit("-70")).withColumn("latitude", F.lit("41"))))
    got = {r.i: (r.geo_function, r.geom, r.geo_longitude) for r in out.collect()}
    assert got == {1: ("1B", "POINT (-73 40)", -73.0), 2: ("DCP_Manual", "POINT (-70 41)", None)}


@pytest.mark.parametrize("how", ["inner", "left"])
def test_hot_keys_on_both_sides(spark, how):
    rows = [(k, "hot" if k % 2 else (None if k % 10 == 0 else f"k{k % 7}")) for k in range(4000)]
    other = [("hot", j) for j in range(3)] + [("k1", 10), ("k1", 11), (None, 12), ("none", 13)]
    df = spark.createDataFrame(rows, "i int, k string").repartition(8)
    dim = spark.createDataFrame(other, "k string, v int")
    got = Counter(map(tuple, relate.join_hot_key(df, dim, ["k"], how).select("i", "k", "v").collect()))
    assert got == Counter(map(tuple, df.join(dim, "k", how).select("i", "k", "v").collect()))


def test_a_hot_key_fills_no_task(spark):
    rows = spark.range(100_000).select(F.col("id").alias("i"), F.when(F.col("id") % 2 == 0, 1).otherwise(F.col("id")).alias("k"))
    dim = spark.range(200_000).select(F.when(F.col("id") < 5, 1).otherwise(F.col("id")).alias("k"), F.col("id").alias("v"))
    settings = {"spark.sql.shuffle.partitions": "50", "spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        joined = relate.join_hot_key(rows, dim.filter("k > 1"), ["k"], "left")
        sizes = sorted(r["count"] for r in joined.groupBy(F.spark_partition_id().alias("task")).count().collect())
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(sizes) == 50 and sizes[-1] < 3 * sizes[25]


def test_a_frame_read_twice_is_worked_out_once(spark):
    df = spark.range(200).select("id", F.concat(F.lit("k"), F.col("id") % 7).alias("k"), (F.col("id") * 2).alias("v"))
    moved = relate.moved_once(relate.computed(df, {"w": F.sqrt("v")}))
    both = moved.join(moved.groupBy("k").agg(F.max("w").alias("most")), "k")
    rows = both.collect()
    plan = both._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "ReusedExchange" in plan and plan.count("REPARTITION_BY_COL") == 1 + plan.count("ReusedExchange")
    want = {k: max((2 * i) ** 0.5 for i in range(200) if i % 7 == k) for k in range(7)}
    assert sorted(tuple(r) for r in rows) == sorted((f"k{i % 7}", i, 2 * i, (2 * i) ** 0.5, want[i % 7]) for i in range(200))
