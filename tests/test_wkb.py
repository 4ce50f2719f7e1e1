"""Binary geometry against an encoder of its own."""

from __future__ import annotations

import math
import random
import struct

import pytest
from pyspark.sql import functions as F

from civicflow.functions.wkb import bits_to_double, lines_of, points_of, polygons_of, with_geometry, wkt_of
from civicflow.sources.publish import parse_ddl

KIND = {"POINT": 1, "LINESTRING": 2, "POLYGON": 3, "MULTIPOINT": 4, "MULTILINESTRING": 5, "MULTIPOLYGON": 6}
SINGLE = {"MULTIPOINT": "POINT", "MULTILINESTRING": "LINESTRING", "MULTIPOLYGON": "POLYGON"}


def encode(kind, shape, order="<", srid=None, dims=2, iso=False, inner=None) -> bytes:
    """Binary geometry; ``inner`` picks the byte order of each part."""
    code = 7 if kind == "COLLECTION" else KIND[kind]
    flags = {2: 0, 3: 0x80000000, 4: 0xC0000000}[dims]
    code = code + {2: 0, 3: 1000, 4: 3000}[dims] if iso else code | flags
    head = struct.pack(order + "I", code | (0x20000000 if srid is not None else 0))
    out = (b"\x01" if order == "<" else b"\x00") + head + (struct.pack(order + "I", srid) if srid is not None else b"")
    more = [float(9 + k) for k in range(dims - 2)]
    point = lambda p: struct.pack(f"{order}{dims}d", *p, *more)
    count = lambda xs: struct.pack(order + "I", len(xs))
    ring = lambda ps: count(ps) + b"".join(map(point, ps))
    if kind == "POINT":
        return out + point(shape or (math.nan, math.nan))
    if kind == "LINESTRING":
        return out + ring(shape)
    if kind == "POLYGON":
        return out + count(shape) + b"".join(map(ring, shape))
    orders = inner or [order]
    if kind == "COLLECTION":
        parts = [encode(k, s, orders[i % len(orders)], None, dims, iso) for i, (k, s) in enumerate(shape)]
    else:
        parts = [encode(SINGLE[kind], s, orders[i % len(orders)], None, dims, iso) for i, s in enumerate(shape)]
    return out + count(shape) + b"".join(parts)


SQUARE = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.5), (0.0, 0.0)]
HOLE = [(1.0, 1.0), (1.0, 2.0), (2.0, 1.0), (1.0, 1.0)]
SHAPES = [
    ("POINT", (-73.9857, 40.7484), "POINT (-73.9857 40.7484)"),
    ("POINT", None, "POINT EMPTY"),
    ("LINESTRING", [(0.1, -0.2), (1e-9, 1e20)], "LINESTRING (0.1 -0.2, 1.0E-9 1.0E20)"),
    ("LINESTRING", [], "LINESTRING EMPTY"),
    ("POLYGON", [SQUARE, HOLE], "POLYGON ((0 0, 4 0, 4 4.5, 0 0), (1 1, 1 2, 2 1, 1 1))"),
    ("POLYGON", [], "POLYGON EMPTY"),
    ("MULTIPOINT", [(1.0, 2.0), (3.0, 4.0)], "MULTIPOINT ((1 2), (3 4))"),
    ("MULTILINESTRING", [[(0.0, 0.0), (1.0, 1.0)], [(2.0, 2.0)]], "MULTILINESTRING ((0 0, 1 1), (2 2))"),
    ("MULTIPOLYGON", [[SQUARE], [HOLE, SQUARE]], "MULTIPOLYGON (((0 0, 4 0, 4 4.5, 0 0)), ((1 1, 1 2, 2 1, 1 1), (0 0, 4 0, 4 4.5, 0 0)))"),
    ("MULTIPOLYGON", [], "MULTIPOLYGON EMPTY"),
    ("COLLECTION", [("POINT", (1.0, 2.0)), ("MULTILINESTRING", [[(0.0, 0.0)], [(1.0, 1.0)]]), ("POLYGON", [HOLE])],
     "GEOMETRYCOLLECTION (POINT (1 2), LINESTRING (0 0), LINESTRING (1 1), POLYGON ((1 1, 1 2, 2 1, 1 1)))"),
]
WAYS = [dict(order=o, srid=s, dims=d, iso=i, inner=n) for o in "<>" for s in (None, 4326) for d, i, n in
        ((2, False, None), (3, False, "<>"), (4, False, ">"), (3, True, "<"), (4, True, "><"))]


def decoded(spark, values, binary):
    df = spark.createDataFrame(list(enumerate(values)), f"i int, g {'binary' if binary else 'string'}")
    g = F.col("shape")
    columns = [wkt_of(g).alias("wkt"), g["srid"].alias("srid"), points_of(g).alias("points"), lines_of(g).alias("lines"),
               polygons_of(g).alias("polygons")]
    return with_geometry(df, "g", "shape").select("i", *columns).orderBy("i").collect()


@pytest.mark.parametrize("kind,shape,text", SHAPES)
def test_every_kind_in_every_encoding(spark, kind, shape, text):
    raw = [encode(kind, shape, **way) for way in WAYS]
    rows = decoded(spark, raw, True)
    assert [r.wkt for r in rows] == [text] * len(WAYS)
    assert [r.srid for r in rows] == [way["srid"] for way in WAYS]
    hexed = [b.hex() if k % 3 else ("\\x", "0x", " ")[k % 9 // 3] + b.hex().upper() for k, b in enumerate(raw)]
    assert [r.wkt for r in decoded(spark, hexed, False)] == [text] * len(WAYS)
    if kind == "MULTIPOLYGON":
        assert [[[tuple(p) for p in ring] for ring in poly] for poly in rows[0].polygons] == shape
    if kind == "MULTILINESTRING":
        assert [[tuple(p) for p in line] for line in rows[3].lines] == shape
    if kind == "MULTIPOINT":
        assert [tuple(p) for p in rows[5].points] == shape


def test_damaged_values_are_null(spark):
    whole = encode("MULTIPOLYGON", [[SQUARE, HOLE], [SQUARE]], srid=4326)
    cut = [whole[:k] for k in range(0, len(whole), 7)]
    huge = [whole[:9] + b"\xff\xff\xff\x7f" + whole[13:], b"\x01\x02\x00\x00\x00\xff\xff\xff\xff", b"\x02" + whole[1:]]
    odd = [whole + b"\x00", encode("POINT", (1.0, 2.0)).replace(b"\x01\x01", b"\x01\x09", 1), b"", None]
    assert [r.wkt for r in decoded(spark, cut + huge + odd, True)] == [None] * len(cut + huge + odd)
    assert [r.wkt for r in decoded(spark, ["", "0", "zz", "POINT (1 2)", None, "01"], False)] == [None] * 6


def test_bits_of_doubles(values):
    rng = random.Random(9)
    numbers = [0.0, 1.0, -1.5, 5e-324, -2.2250738585072014e-308, 1.7976931348623157e308, 0.1, math.pi, 2.0**-1022, 4e-310]
    numbers += [rng.uniform(-180, 180) for _ in range(200)] + [rng.lognormvariate(0, 200) for _ in range(200)]
    bits = [struct.unpack("<q", struct.pack("<d", x))[0] for x in numbers]
    assert values(bits_to_double(F.col("c")), bits, "bigint") == numbers
    nothing = [struct.unpack("<q", struct.pack("<d", x))[0] for x in (math.inf, -math.inf, math.nan)]
    assert values(bits_to_double(F.col("c")), nothing, "bigint") == [None] * 3


def test_many_vertices(spark):
    ring = [(math.cos(k / 5000) * 3, math.sin(k / 5000) * 3) for k in range(31_416)] + [(3.0, 0.0)]
    row = decoded(spark, [encode("POLYGON", [ring], ">")], True)[0]
    assert [tuple(p) for p in row.polygons[0][0]] == ring


def test_road_lines_are_told_by_their_shapes_and_only_found_ones_become_text(spark, monkeypatch):
    from civicflow.plans import JOBS, job, roads

    line = lambda x, order: encode("LINESTRING", [(x, 1.0), (x + 0.5, 1.0)], order, 4326).hex()
    drawn = [(1, line(1.0, "<")), (2, line(9.0, "<")), (3, "SRID=4326;LINESTRING (2 2, 3 2)"), (3, None), (4, "0102"), (5, line(2.0, ">"))]
    box = encode("MULTIPOLYGON", [[[(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0), (0.0, 0.0)]]], ">").hex()
    declared = [c for c in parse_ddl(JOBS["functional_class"].outputs["functional_class"]) if c not in ("geom", "objectid", "borough")]
    lines = spark.createDataFrame([(k, str(k), g) for k, g in drawn], "ogc_fid int, objectid string, wkb_geometry string")
    lines = lines.select("*", *[F.lit(None).cast("string").alias(c) for c in {*declared, "municipality_desc"}])
    areas = spark.createDataFrame([(box,)], "wkb_geometry string")
    own, read = job.scan_geometry, []

    def scan(df, *a):
        if "ogc_fid" in df.columns:
            read.append(df.count())
        return own(df, *a)

    monkeypatch.setattr(job, "scan_geometry", scan)
    monkeypatch.setattr(roads, "scan_geometry", scan, raising=False)
    found = JOBS["functional_class"].run({"road_lines": lines, "boundaries": areas})["functional_class"]
    want = {1: "LINESTRING (1 1, 1.5 1)", 3: "LINESTRING (2 2, 3 2)", 5: "LINESTRING (2 1, 2.5 1)"}
    assert {r.objectid: r.geom for r in found.collect()} == {k: f"SRID=4326;{v}" for k, v in want.items()}
    assert found.count() == 3 and read == [4]
