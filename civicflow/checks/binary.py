"""Binary geometry made from the driver's tables, and the scan that reads it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from civicflow.checks.registry import check, shaped
from civicflow.functions.wkb import lines_of, nibbles_swapped, points_of, polygons_of
from civicflow.operators.relate import computed
from civicflow.sources.shapes import SHAPE, scan_geometry


def _ordered(bits: Column, little: Column) -> Column:
    digits = lambda c: F.lpad(F.hex(c), 16, "0")
    return F.when(little, F.reverse(digits(nibbles_swapped(bits)))).otherwise(digits(bits))


def uint_hex(n: int, little: Column) -> Column:
    """Four bytes of a whole number as hex."""
    return F.when(little, F.lit(n.to_bytes(4, "little").hex().upper())).otherwise(F.lit(n.to_bytes(4, "big").hex().upper()))


def double_hex(c: Column, little: Column) -> Column:
    """Eight bytes of a number, which is a whole multiple of a power of two, as hex."""
    power = F.floor(F.log2(F.abs(c)))
    fraction = ((F.abs(c) / F.pow(F.lit(2.0), power) - 1) * (1 << 52)).cast("bigint")
    bits = F.shiftleft((power + 1023).cast("bigint"), 52) + fraction + F.when(c < 0, F.lit(-(1 << 63))).otherwise(F.lit(0))
    return _ordered(F.when(c == 0, F.lit(0)).otherwise(bits), little)


class Encoder:
    """Hex of shapes in the byte order that ``little`` tells, with a third coordinate where ``deep`` holds.

    Coordinates are given as their own hex, worked out once a row.
    """

    def __init__(self, little: Column, deep: Column, srid: Column | None = None):
        self.little, self.deep, self.srid = little, deep, srid

    def head(self, kind: int, outer: bool = False) -> Column:
        order = F.when(self.little, F.lit("01")).otherwise(F.lit("00"))
        code = lambda flag: F.when(self.deep, uint_hex(kind | 0x80000000 | flag, self.little)).otherwise(
            uint_hex(kind | flag, self.little)
        )
        if not outer or self.srid is None:
            return F.concat(order, code(0))
        tagged = F.concat(order, code(0x20000000), uint_hex(4326, self.little))
        return F.when(self.srid, tagged).otherwise(F.concat(order, code(0)))

    def points(self, pairs: list[tuple[Column, Column]]) -> Column:
        high = F.when(self.deep, F.when(self.little, F.lit("0000000000001C40")).otherwise(F.lit("401C000000000000")))
        return F.concat(*[v for x, y in pairs for v in (x, y, F.coalesce(high, F.lit("")))])

    def counted(self, parts: list[Column]) -> Column:
        return F.concat(uint_hex(len(parts), self.little), *parts)

    def ring(self, pairs: list[tuple[Column, Column]]) -> Column:
        return F.concat(uint_hex(len(pairs), self.little), self.points(pairs))

    def point(self, pair: tuple[Column, Column], outer: bool = False) -> Column:
        return F.concat(self.head(1, outer), self.points([pair]))

    def line(self, pairs: list[tuple[Column, Column]], outer: bool = False) -> Column:
        return F.concat(self.head(2, outer), self.ring(pairs))

    def polygon(self, rings: list[list[tuple[Column, Column]]], outer: bool = False) -> Column:
        return F.concat(self.head(3, outer), self.counted([self.ring(r) for r in rings]))

    def many(self, kind: int, parts: list[Column]) -> Column:
        return F.concat(self.head(kind, True), self.counted(parts))


SHAPES = """
SELECT o_orderkey AS id, o_orderkey % 8 AS kind, o_custkey % 2 AS little, o_custkey % 3 AS deep, o_orderkey % 5 AS tagged,
  CAST(o_orderkey % 96 AS DOUBLE) / 32 - 75 AS x, CAST(o_custkey % 96 AS DOUBLE) / 32 + 40 AS y,
  CAST(o_orderkey % 96 AS DOUBLE) / 32 - 74.9375 AS x1, CAST(o_custkey % 96 AS DOUBLE) / 32 + 40.0625 AS y1
FROM {orders}
"""
_N = {c: f"regexp_replace(CAST({c} AS VARCHAR), '\\.0$', '')" for c in ("x", "y", "x1", "y1")}


def _pairs(*names: str) -> str:
    return " || ', ' || ".join(f"{_N[n.split()[0]]} || ' ' || {_N[n.split()[1]]}" for n in names)


_BOX = _pairs("x y", "x1 y", "x1 y1", "x y")
_HOLE = _pairs("x y", "x1 y1", "x y1", "x y")


@check(
    "wkb_scan",
    f"""
SELECT id, CASE WHEN kind < 7 THEN CAST(kind + 1 AS BIGINT) END AS kind, kind = 7 AS unreadable,
  CASE WHEN tagged = 0 AND kind < 7 THEN CAST(4326 AS BIGINT) END AS srid,
  CASE kind WHEN 0 THEN 'POINT (' || {_pairs("x y")} || ')' WHEN 1 THEN 'LINESTRING (' || {_pairs("x y", "x1 y1")} || ')'
    WHEN 2 THEN 'POLYGON ((' || {_BOX} || '), (' || {_HOLE} || '))'
    WHEN 3 THEN 'MULTIPOINT ((' || {_pairs("x y")} || '), (' || {_pairs("x1 y1")} || '))'
    WHEN 4 THEN 'MULTILINESTRING ((' || {_pairs("x y", "x1 y")} || '), (' || {_pairs("x y1", "x1 y1", "x y")} || '))'
    WHEN 5 THEN 'MULTIPOLYGON (((' || {_BOX} || ')), ((' || {_HOLE} || '), (' || {_BOX} || ')))'
    WHEN 6 THEN 'GEOMETRYCOLLECTION (POINT (' || {_pairs("x y")} || '), LINESTRING (' || {_pairs("x y", "x1 y1")} || '))'
    END AS geom,
  CASE kind WHEN 0 THEN 1 WHEN 3 THEN 2 WHEN 6 THEN 1 WHEN 7 THEN NULL ELSE 0 END AS n_points,
  CASE kind WHEN 1 THEN 1 WHEN 4 THEN 2 WHEN 6 THEN 1 WHEN 7 THEN NULL ELSE 0 END AS n_lines,
  CASE kind WHEN 2 THEN 1 WHEN 5 THEN 2 WHEN 7 THEN NULL ELSE 0 END AS n_polygons
FROM ({SHAPES})
""",
)
def wkb_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every kind of binary geometry, of both byte orders and with further dimensions, as text."""
    c = F.col
    df = shaped(spark, sf_dir, SHAPES)
    df = computed(df, {name: double_hex(c(name), c("little") == 1) for name in ("x", "y", "x1", "y1")})
    e = Encoder(c("little") == 1, c("deep") == 0, c("tagged") == 0)
    a, b, d, f = (c("x"), c("y")), (c("x1"), c("y")), (c("x1"), c("y1")), (c("x"), c("y1"))
    box, hole = [a, b, d, a], [a, d, f, a]
    forms = [
        e.point(a, True),
        e.line([a, d], True),
        e.polygon([box, hole], True),
        e.many(4, [e.point(a), e.point(d)]),
        e.many(5, [e.line([a, b]), e.line([f, d, a])]),
        e.many(6, [e.polygon([box]), e.polygon([hole, box])]),
        e.many(7, [e.point(a), e.line([a, d])]),
        F.substring(e.many(6, [e.polygon([box])]), 1, 100),
    ]
    digits = F.element_at(F.array(*[F.when(c("kind") == k, form) for k, form in enumerate(forms)]), (c("kind") + 1).cast("int"))
    stored = computed(df, {"wkb_geometry": F.unhex(digits)}).select("id", "wkb_geometry")
    shape = F.col(SHAPE)
    return scan_geometry(stored).select(
        "id",
        shape["kind"].alias("kind"),
        F.col("geom").isNull().alias("unreadable"),
        shape["srid"].alias("srid"),
        "geom",
        F.when(shape.isNotNull(), F.size(points_of(shape))).alias("n_points"),
        F.when(shape.isNotNull(), F.size(lines_of(shape))).alias("n_lines"),
        F.when(shape.isNotNull(), F.size(polygons_of(shape))).alias("n_polygons"),
    )
