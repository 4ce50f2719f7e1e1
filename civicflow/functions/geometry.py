"""Geometry in plain columns.

A point is two doubles, a line an array of (x, y), a polygon an array of
rings, a multipolygon an array of polygons.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from civicflow.functions.numbers import to_number
from civicflow.functions.text import col, empty_to_null, let


def coordinate_text(c) -> Column:
    """Coordinate as text, whole numbers without a fraction."""
    whole = lambda t: F.when(t.endswith(".0"), F.left(t, F.length(t) - 2)).otherwise(t)
    return let(col(c).cast("string"), whole)


def point_wkt(lon, lat) -> Column:
    """'POINT (x y)'; NULL unless both are numbers (G1)."""
    return point_wkt_of(F.struct(to_number(lon).alias("lon"), to_number(lat).alias("lat")))


def point_wkt_of(point) -> Column:
    """'POINT (x y)' of a numeric (lon, lat) pair, NULL when either is missing (G1)."""

    def text(p: Column) -> Column:
        pair = F.concat(
            F.lit("POINT ("), coordinate_text(p["lon"]), F.lit(" "), coordinate_text(p["lat"]), F.lit(")")
        )
        return F.when(p["lon"].isNotNull() & p["lat"].isNotNull(), pair)

    return let(col(point), text)


def ewkt(wkt, srid: int = 4326) -> Column:
    """'SRID=4326;POINT (x y)'; blank when there is no geometry."""
    return F.when(empty_to_null(wkt).isNotNull(), F.concat(F.lit(f"SRID={srid};"), col(wkt))).otherwise("")


def midpoint(ax, ay, bx, by) -> Column:
    """Point half way between two points."""
    return F.struct(((col(ax) + col(bx)) / 2).alias("lon"), ((col(ay) + col(by)) / 2).alias("lat"))


def packed_xy(c) -> Column:
    """The two seven-digit halves of a packed coordinate as numbers."""
    text = col(c)
    return F.struct(to_number(F.substring(text, 1, 7)).alias("x"), to_number(F.right(text, F.lit(7))).alias("y"))


def parse_points(text) -> Column:
    """'0 0, 1 1' as an array of (x, y)."""

    def read(pair: Column) -> Column:
        xy = F.split(F.trim(pair), r"\s+")
        return F.struct(
            F.get(xy, F.lit(0)).try_cast("double").alias("x"), F.get(xy, F.lit(1)).try_cast("double").alias("y")
        )

    return F.transform(F.split(col(text), ","), read)


def parse_lines(wkt) -> Column:
    """LINESTRING or MULTILINESTRING text as an array of lines."""
    text = col(wkt)
    bodies = F.regexp_extract_all(text, F.lit(r"\(([^()]+)\)"), F.lit(1))
    return F.when(F.upper(text).rlike(r"LINESTRING"), F.transform(bodies, parse_points))


def parse_polygons(wkt) -> Column:
    """POLYGON or MULTIPOLYGON text as an array of polygons."""
    text = col(wkt)
    polygons = F.split(text, r"\)\s*\)\s*,")

    def rings(polygon: Column) -> Column:
        closed = F.concat(polygon, F.lit("))"))
        return F.transform(F.regexp_extract_all(closed, F.lit(r"\(([^()]+)\)"), F.lit(1)), parse_points)

    return F.when(F.upper(text).rlike(r"POLYGON"), F.transform(polygons, rings))


def edges(ring) -> Column:
    """Consecutive point pairs of a ring or line as (x1, y1, x2, y2)."""
    ring = col(ring)
    n = F.size(ring) - 1
    return F.zip_with(
        F.slice(ring, F.lit(1), n),
        F.slice(ring, F.lit(2), n),
        lambda a, b: F.struct(a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2")),
    )


def _moments(polygons: Column, origin: Column) -> Column:
    """(area, sum x*area, sum y*area) about the origin, holes negative."""
    zero = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("mx"), F.lit(0.0).alias("my"))

    def add(total: Column, edge: Column) -> Column:
        x1, y1 = edge["x1"] - origin["x"], edge["y1"] - origin["y"]
        x2, y2 = edge["x2"] - origin["x"], edge["y2"] - origin["y"]
        cross = x1 * y2 - x2 * y1
        return F.struct(
            (total["a"] + cross / 2).alias("a"),
            (total["mx"] + (x1 + x2) * cross / 6).alias("mx"),
            (total["my"] + (y1 + y2) * cross / 6).alias("my"),
        )

    def ring(points: Column, index: Column) -> Column:
        # Whatever way a ring winds, the shell counts plus and a hole minus.
        side = F.when(index == 0, 1.0).otherwise(-1.0)

        def signed(m: Column) -> Column:
            sign = side * F.signum(m["a"])
            return F.struct((m["a"] * sign).alias("a"), (m["mx"] * sign).alias("mx"), (m["my"] * sign).alias("my"))

        return F.aggregate(edges(points), zero, add, signed)

    rings = F.flatten(F.transform(polygons, lambda p: F.transform(p, ring)))
    return F.aggregate(
        rings,
        zero,
        lambda t, m: F.struct(
            (t["a"] + m["a"]).alias("a"), (t["mx"] + m["mx"]).alias("mx"), (t["my"] + m["my"]).alias("my")
        ),
    )


def centroid(polygons) -> Column:
    """Area-weighted centre of a multipolygon as (lon, lat).

    A multipolygon without area gives the mean of its vertices.
    """

    def mean(vertices: Column) -> Column:
        zero = F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
        n = F.size(vertices)
        return F.aggregate(
            vertices,
            zero,
            lambda t, v: F.struct((t["x"] + v["x"]).alias("x"), (t["y"] + v["y"]).alias("y")),
            lambda t: F.struct((t["x"] / n).alias("lon"), (t["y"] / n).alias("lat")),
        )

    def centre(p: Column, origin: Column, m: Column) -> Column:
        return F.when(m["a"] == 0, mean(F.flatten(F.flatten(p)))).otherwise(
            F.struct(
                (origin["x"] + F.try_divide(m["mx"], m["a"])).alias("lon"),
                (origin["y"] + F.try_divide(m["my"], m["a"])).alias("lat"),
            )
        )

    def of(p: Column) -> Column:
        return let(p[0][0][0], lambda origin: let(_moments(p, origin), lambda m: centre(p, origin, m)))

    return let(col(polygons), lambda p: F.when(F.size(F.flatten(F.flatten(p))) > 0, of(p)))
