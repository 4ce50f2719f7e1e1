"""Geometry and spatial join, against hand-worked values and brute force."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from civicflow.functions.geometry import (
    centroid,
    ewkt,
    midpoint,
    packed_xy,
    parse_lines,
    parse_polygons,
    point_wkt,
)
from civicflow.functions.projection import to_lon_lat
from civicflow.operators.spatial import meets_any


def test_point_text(spark):
    df = spark.createDataFrame([("-74.5", "40"), ("x", "40"), (None, "1"), ("", "1")], "lon string, lat string")
    wkt = df.select(point_wkt("lon", "lat").alias("w"))
    assert [r.w for r in wkt.collect()] == ["POINT (-74.5 40)", None, None, None]
    assert [r.e for r in wkt.select(ewkt("w").alias("e")).collect()] == ["SRID=4326;POINT (-74.5 40)", "", "", ""]


@pytest.mark.parametrize(
    "wkt, lon, lat",
    [
        ("POLYGON ((0 0, 2 0, 2 2, 0 2, 0 0))", 1.0, 1.0),
        ("POLYGON ((0 0, 0 2, 2 2, 2 0, 0 0))", 1.0, 1.0),
        ("POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0), (1 1, 1 2, 2 2, 2 1, 1 1))", (32 - 1.5) / 15, (32 - 1.5) / 15),
        ("MULTIPOLYGON (((0 0, 2 0, 2 2, 0 2, 0 0)), ((10 0, 12 0, 12 2, 10 2, 10 0)))", 6.0, 1.0),
        ("POLYGON ((0 0, 1 1, 2 2, 0 0))", 0.75, 0.75),
    ],
)
def test_centroid(spark, wkt, lon, lat):
    row = spark.range(1).select(centroid(parse_polygons(F.lit(wkt))).alias("c")).first().c
    assert (row.lon, row.lat) == pytest.approx((lon, lat), abs=1e-12)


def test_centroid_of_missing_geometry(spark):
    row = spark.range(1).select(centroid(parse_polygons(F.lit(None).cast("string"))).alias("c")).first()
    assert row.c is None


@pytest.mark.parametrize(
    "x, y, lon, lat",
    [
        (984250.0, 0.0, -74.0, 40.16666667),
        (988215.0, 211950.0, -73.98569002, 40.74842943),
        (1000000.0, 200000.0, -73.94318507, 40.71561648),
    ],
)
def test_reprojection_anchors(spark, x, y, lon, lat):
    row = spark.createDataFrame([(x, y)], "x double, y double").select(to_lon_lat("x", "y").alias("p")).first().p
    assert (row.lon, row.lat) == pytest.approx((lon, lat), abs=1e-8)


def test_packed_and_middle(spark):
    df = spark.sql("SELECT '10000000200000' AS p").select(packed_xy("p").alias("h"))
    assert tuple(df.first().h) == (1000000.0, 200000.0)
    row = spark.range(1).select(midpoint(F.lit(0.0), F.lit(1.0), F.lit(2.0), F.lit(3.0)).alias("m")).first().m
    assert tuple(row) == (1.0, 2.0)


def _inside(rings, x, y):
    odd = False
    for ring in rings:
        for (x1, y1), (x2, y2) in zip(ring, ring[1:]):
            if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
                odd = not odd
    return odd


def _cross(a, b, p):
    return (b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0])


def _sign(v):
    return (v > 0) - (v < 0)


def _meet(a, b, c, d):
    boxes = all(
        max(a[i], b[i]) >= min(c[i], d[i]) and max(c[i], d[i]) >= min(a[i], b[i]) for i in (0, 1)
    )
    return (
        boxes
        and _sign(_cross(c, d, a)) * _sign(_cross(c, d, b)) <= 0
        and _sign(_cross(a, b, c)) * _sign(_cross(a, b, d)) <= 0
    )


def _brute(line, rings):
    if _inside(rings, *line[0]):
        return True
    return any(
        _meet(p, q, r, s) for p, q in zip(line, line[1:]) for ring in rings for r, s in zip(ring, ring[1:])
    )


@pytest.mark.parametrize("size", [0.7, 3.0, 40.0])
def test_spatial_join_against_brute_force(spark, size):
    rng = random.Random(7)
    areas = []
    for _ in range(6):
        # A star-shaped area with a hole about its centre.
        cx, cy = rng.uniform(-20, 20), rng.uniform(-20, 20)
        spokes = [(0.5 + rng.random(), i) for i in range(9)]
        shell = [
            (cx + 5 * r * math.cos(i * 0.69813), cy + 5 * r * math.sin(i * 0.69813)) for r, i in spokes
        ]
        hole = [(cx + dx, cy + dy) for dx, dy in [(-1, -1), (1, -1), (1, 1), (-1, 1)]]
        areas.append([shell + shell[:1], hole + hole[:1]])
    lines = []
    for _ in range(400):
        x, y = rng.uniform(-28, 28), rng.uniform(-28, 28)
        line = [(x, y)]
        for _ in range(rng.randint(1, 3)):
            x, y = x + rng.uniform(-4, 4), y + rng.uniform(-4, 4)
            line.append((x, y))
        lines.append(line)

    def text(points):
        return ", ".join(f"{px!r} {py!r}" for px, py in points)

    line_rows = [(i, f"LINESTRING ({text(line)})") for i, line in enumerate(lines)]
    area_rows = [(f"POLYGON ({', '.join('(' + text(r) + ')' for r in rings)})",) for rings in areas]
    line_df = spark.createDataFrame(line_rows, "id int, g string").repartition(3)
    area_df = spark.createDataFrame(area_rows, "g string")
    found = meets_any(line_df, "id", parse_lines("g"), area_df, parse_polygons("g"), size)
    want = {i for i, line in enumerate(lines) if any(_brute(line, rings) for rings in areas)}
    assert {r.id for r in found.collect()} == want
    assert 0 < len(want) < len(lines)


def test_touching_lines_and_multilines(spark):
    area = spark.sql("SELECT 'POLYGON ((0 0, 2 0, 2 2, 0 2, 0 0))' AS g")
    lines = spark.createDataFrame(
        [
            (1, "LINESTRING (2 1, 3 1)"),
            (2, "LINESTRING (2.1 1, 3 1)"),
            (3, "MULTILINESTRING ((5 5, 6 6), (0.5 0.5, 0.6 0.6))"),
            (4, "LINESTRING (-1 1, 3 1)"),
            (5, None),
            (6, "LINESTRING (-1 2, 3 2)"),
            (3, "LINESTRING (9 9, 9 8)"),
        ],
        "id int, g string",
    )
    found = meets_any(lines, "id", parse_lines("g"), area, parse_polygons("g"), 0.5)
    # Membership goes by id, so both rows with id 3 stay.
    assert sorted(r.id for r in found.collect()) == [1, 3, 3, 4, 6]
