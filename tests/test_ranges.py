"""Houses placed between the ends of a street side."""

from __future__ import annotations

import random

from civicflow.operators.ranges import house_in_block, place_in_ranges, range_book

RANGES = "id int, street string, area string, low int, high int, from_lon double, from_lat double, to_lon double, to_lat double"


def placed(spark, houses, ranges):
    asked = spark.createDataFrame([(i, *h) for i, h in enumerate(houses)], "i int, house string, street string, area string")
    df = place_in_ranges(asked, spark.createDataFrame(ranges, RANGES), house="house", street="street", area="area")
    return [tuple(r)[4:] for r in sorted(df.collect())]


def test_sides_ends_and_overlaps(spark):
    ranges = [
        (1, "Main  St", "Bronx", 1, 101, 0.0, 0.0, 100.0, 50.0),
        (2, "MAIN ST", "BRONX", 102, 2, 10.0, 0.0, 0.0, 0.0),  # the wrong way round
        (3, "main st", "bronx", 11, 21, 500.0, 0.0, 600.0, 0.0),  # shorter than 1
        (4, "main st", "bronx", 11, 21, 0.0, 0.0, 0.0, 0.0),  # as 3, with a larger id
        (5, "main st", "queens", 7, 7, 1.0, 1.0, 3.0, 3.0),
        (6, None, "bronx", 1, 9, 0.0, 0.0, 0.0, 0.0),
        (7, "main st", "bronx", None, 9, 0.0, 0.0, 0.0, 0.0),
    ]
    houses = [("51", "main st", "bronx"), ("52A", "main st", "bronx"), ("2", "main st", "bronx"), ("11 1/2", "Main St", "BRONX"),
              ("103", "main st", "bronx"), ("7", "main st", "queens"), ("x", "main st", "bronx"), (None, None, None),
              ("51", "main st", ""), ("99999999999", "main st", "bronx"), ("51", "main st", "bronx")]
    got = placed(spark, houses, ranges)
    nothing = (None, None, None)
    assert got == [(1, 50.0, 25.0), (2, 5.0, 0.0), (2, 0.0, 0.0), (3, 500.0, 0.0), nothing, (5, 2.0, 2.0)] + [nothing] * 4 + [(1, 50.0, 25.0)]


def test_against_all_pairs(spark):
    rng = random.Random(3)
    ranges = []
    for k in range(120):
        low = rng.randint(0, 3000)
        ranges.append((k, rng.choice("ab"), "x", low, low + rng.choice([0, 1, 9, 64, 200, 2500]), float(k), 0.0, float(k + 64), 1.0))
    houses = [(str(rng.randint(0, 4000)), rng.choice("ab"), "x") for _ in range(400)]
    for (house, street, _), got in zip(houses, placed(spark, houses, ranges)):
        n = int(house)
        fits = [r for r in ranges if r[1] == street and r[3] <= n <= r[4] and r[3] % 2 == n % 2]
        best = min(fits, key=lambda r: (r[4] - r[3], r[3], r[0]), default=None)
        assert got[0] == (best[0] if best else None)
        if best:
            along = (n - best[3]) / (best[4] - best[3]) if best[4] > best[3] else 0.5
            assert got[1:] == (best[5] + along * 64.0, along)


def test_numbers_of_houses(values):
    assert values(house_in_block("c"), ["12", " 43-10", "7A 1/2", "A7", "", None, "99999999999"]) == [12, 43, 7, None, None, None, None]


def test_a_bin_holds_no_more_ranges_than_its_numbers_tell_apart(spark):
    rng = random.Random(5)
    ranges = []
    for k in range(4000):
        low = rng.randint(0, 140)
        ranges.append((k, "a", "x", low, low + rng.choice([0, 1, 2, 9, 40, 200]), float(k), 0.0, float(k + 64), 1.0))
    book = range_book(spark.createDataFrame(ranges, RANGES), "area").groupBy("_street", "_area", "_odd", "_bin").count().collect()
    assert max(r["count"] for r in book) <= 528 and len(ranges) > 528
    houses = [(str(n), "a", "x") for n in range(0, 360)]
    for n, got in enumerate(placed(spark, houses, ranges)):
        fits = [r for r in ranges if r[3] <= n <= r[4] and r[3] % 2 == n % 2]
        best = min(fits, key=lambda r: (r[4] - r[3], r[3], r[0]), default=None)
        assert got[0] == (best[0] if best else None)
