"""Binary geometry as column expressions.

Reads well-known binary, plain or with a reference system (EWKB), of either byte order, as bytes or as hex text:
points, lines, polygons, their multi forms and collections of these, with or without further dimensions.  The bytes
are kept forwards and backwards, so a number of either byte order is one piece of one of them.  A cursor runs over
members, parts and rings and notes where each ring's coordinates lie; only then are these read, as the sign,
exponent and fraction bits of a double.  Counts are held against the bytes that are left, so that a damaged value
cannot ask for more than it has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from civicflow.functions.geometry import coordinate_text
from civicflow.functions.text import col, let
from civicflow.operators.relate import computed

# Fixed values of the format: kinds of geometry, and the flags of its extended form.
POINT, LINE, POLYGON, MULTIPOINT, MULTILINE, MULTIPOLYGON, COLLECTION = range(1, 8)
HAS_Z, HAS_M, HAS_SRID = 0x80000000, 0x40000000, 0x20000000

_FRACTION = (1 << 52) - 1


def wkb_hex(c, binary: bool = False) -> Column:
    """Upper-case hex digits of a value, given as bytes or as hex text with or without a ``\\x`` or ``0x`` before it."""
    if binary:
        return F.hex(col(c))
    text = F.upper(F.regexp_replace(F.trim(col(c)), r"^(?:\\x|\\X|0x|0X)", ""))
    return F.when(text.rlike("^(?:[0-9A-F]{2})+$"), text)


def nibbles_swapped(c: Column) -> Column:
    """A 64-bit number with the two hex digits of each byte changed over."""
    low = F.lit(0x0F0F0F0F0F0F0F0F)
    return F.shiftleft(c.bitwiseAND(low), 4).bitwiseOR(F.shiftrightunsigned(c, 4).bitwiseAND(low))


def _number(b: Column, at: Column, width: int, little: Column) -> Column:
    """The bytes from an offset on as a whole number; NULL if they are not all there."""
    start = F.when(little, b["n"] - at - width).otherwise(at)
    held = F.when(little, b["back"]).otherwise(b["there"])
    inside = (at >= 0) & (at + width <= b["n"])
    digits = F.when(inside, F.hex(F.substring(held, (start + 1).cast("int"), F.lit(width))))
    value = F.conv(digits, 16, -10).cast("bigint")
    return let(value, lambda v: F.when(little, nibbles_swapped(v)).otherwise(v))


def _uint(b: Column, at: Column, little: Column) -> Column:
    return _number(b, at, 4, little)


def bits_to_double(bits: Column) -> Column:
    """The double with these 64 bits; NULL for infinities and for what is not a number."""
    fraction = bits.bitwiseAND(F.lit(_FRACTION))

    def size(exponent: Column) -> Column:
        return F.when(exponent == 0, fraction * F.pow(F.lit(2.0), F.lit(-1074.0))).when(
            exponent < 2047, (fraction + (1 << 52)) * F.pow(F.lit(2.0), exponent - 1075.0)
        )

    exponent = F.shiftright(bits, 52).bitwiseAND(F.lit(2047))
    return let(let(exponent, size), lambda s: F.when(bits < 0, -s).otherwise(s))


def _double(b: Column, at: Column, little: Column) -> Column:
    return let(_number(b, at, 8, little), bits_to_double)


def _header(b: Column, at: Column, outer: bool = False) -> Column:
    """(kind, stride, little, body, srid) of the geometry at an offset; ``kind`` is NULL if it is none.

    The reference system is read of the outer geometry alone.
    """
    order = F.substring(b["there"], (at + 1).cast("int"), F.lit(1))
    big = order == F.lit(bytearray(b"\x00"))

    def read(little: Column, code: Column) -> Column:
        flag = lambda f: code.bitwiseAND(F.lit(f)) != 0
        plain = code.bitwiseAND(F.lit(0x0FFFFFFF))
        family = F.floor(plain / 1000)
        z = flag(HAS_Z) | family.isin(1, 3)
        m = flag(HAS_M) | family.isin(2, 3)
        known = (little | big) & (plain % 1000).between(POINT, COLLECTION) & (family <= 3)
        srid = F.when(flag(HAS_SRID), _uint(b, at + 5, little)) if outer else F.lit(None).cast("bigint")
        return F.struct(
            F.when(known, plain % 1000).alias("kind"),
            (F.lit(16) + F.when(z, 8).otherwise(0) + F.when(m, 8).otherwise(0)).cast("bigint").alias("stride"),
            little.alias("little"),
            (at + 5 + F.when(flag(HAS_SRID), 4).otherwise(0)).cast("bigint").alias("body"),
            srid.alias("srid"),
        )

    little = F.coalesce(order == F.lit(bytearray(b"\x01")), F.lit(False))
    return let(little, lambda x: let(_uint(b, at + 1, x), lambda code: read(x, code)))


_RING = "struct<member:bigint,part:bigint,kind:bigint,at:bigint,n:bigint,stride:bigint,little:boolean>"
_STATE = f"struct<at:bigint,part:bigint,rings:array<{_RING}>>"


def _state(at: Column, part: Column, rings: Column) -> Column:
    return F.struct(at.alias("at"), part.alias("part"), rings.alias("rings")).cast(_STATE)


def _steps(n: Column) -> Column:
    """As many steps as a count says; none for a count that is missing."""
    return F.when(n > 0, F.sequence(F.lit(1).cast("bigint"), n)).otherwise(F.array().cast("array<bigint>"))


def _count(b: Column, at: Column, little: Column, least: Column) -> Column:
    """A count, if the bytes that are left can hold so many things of the least size."""
    return let(_uint(b, at, little), lambda n: F.when(n * least <= b["n"] - at - 4, n))


def _ring(member: Column, s: Column, h: Column, at: Column, n: Column) -> Column:
    values = {"member": member, "part": s["part"], "kind": h["kind"], "at": at, "n": n, "stride": h["stride"], "little": h["little"]}
    return F.array(F.struct(*[v.alias(k) for k, v in values.items()]).cast(_RING))


def _part(b: Column, member: Column, s: Column) -> Column:
    """The state after one point, line or polygon; its offset is NULL from the first damage on."""

    def read(h: Column) -> Column:
        body = h["body"]
        point = F.when(body + h["stride"] <= b["n"], _state(body + h["stride"], s["part"] + 1, F.concat(s["rings"], _ring(member, s, h, body, F.lit(1)))))

        def run(state: Column, _step: Column) -> Column:
            def over(n: Column) -> Column:
                there = state["at"] + 4
                more = _ring(member, s, h, there, n)
                return _state(there + n * h["stride"], state["part"], F.when(n.isNotNull(), F.concat(state["rings"], more)).otherwise(state["rings"]))

            return let(_count(b, state["at"], h["little"], h["stride"]), over)

        rings = F.when(h["kind"] == LINE, F.lit(1).cast("bigint")).when(
            h["kind"] == POLYGON, _count(b, body, h["little"], F.lit(4))
        )
        start = F.when(h["kind"] == LINE, body).when(rings.isNotNull(), body + 4)
        # A polygon without rings leaves a mark, so that it is not lost among the parts.
        mark = F.concat(s["rings"], _ring(member, s, h, body, F.lit(-1)))
        begin = _state(start, s["part"], F.when(rings == 0, mark).otherwise(s["rings"]))
        many = F.aggregate(_steps(rings), begin, run, lambda t: _state(t["at"], t["part"] + 1, t["rings"]))
        damaged = _state(F.lit(None).cast("bigint"), s["part"], s["rings"])
        return F.coalesce(F.when(h["kind"] == POINT, point).when(h["kind"].isin(LINE, POLYGON), many), damaged)

    return let(_header(b, s["at"]), read)


def _member(b: Column, member: Column, s: Column, head: Column) -> Column:
    """The state after one geometry that is no collection, of which the header is given."""

    def read(h: Column) -> Column:
        single = h["kind"].isin(POINT, LINE, POLYGON)
        n = F.when(single, F.lit(1).cast("bigint")).when(
            h["kind"].isin(MULTIPOINT, MULTILINE, MULTIPOLYGON), _count(b, h["body"], h["little"], F.lit(9))
        )
        start = F.when(single, s["at"]).when(n.isNotNull(), h["body"] + 4)
        return F.aggregate(_steps(n), _state(start, s["part"], s["rings"]), lambda t, _: _part(b, member, t))

    return let(head, read)


def with_geometry(df: DataFrame, column: str, to: str) -> DataFrame:
    """The frame with binary geometry read as ``to``: (kind, srid, parts); NULL if it cannot be read to its last byte.

    The column holds bytes or hex text.  ``parts`` has (member, kind, rings) for each point, line and polygon, in
    order; a ring is an array of (x, y), and further dimensions are left out.  A point without coordinates has an
    (x, y) of NULLs.  Each step is a column of its own: written into one another they would be too deep to analyse.
    """
    digits = wkb_hex(f"`{column}`", isinstance(df.schema[column].dataType, T.BinaryType))
    b, h, t = F.col("_wkb"), F.col("_wkb_head"), F.col("_wkb_rings")
    zero = F.lit(0).cast("bigint")

    def ends(h: Column) -> Column:
        n = F.floor(F.octet_length(h) / 2).cast("bigint")
        # Backwards, the digits of a byte are changed over too; a number read there has them changed back.
        return F.when(h.isNotNull(), F.struct(F.unhex(h).alias("there"), F.unhex(F.reverse(h)).alias("back"), n.alias("n")))

    whole = h["kind"] == COLLECTION
    n = F.when(whole, _count(b, h["body"], h["little"], F.lit(9))).when(h["kind"].isNotNull(), F.lit(1).cast("bigint"))
    start = F.when(whole, h["body"] + 4).otherwise(zero)
    state = _state(F.when(n.isNotNull(), start), zero, F.array().cast(f"array<{_RING}>"))
    read = F.aggregate(_steps(n), state, lambda s, k: _member(b, k, s, F.when(whole, _header(b, s["at"])).otherwise(h)))
    geometry = F.when(t["at"] == b["n"], _geometry(b, h, t["rings"], t["part"]))
    out = computed(df, {"_wkb": let(digits, ends)})
    out = computed(out, {"_wkb_head": _header(b, zero, True)})
    out = computed(out, {"_wkb_rings": read})
    return computed(out, {to: geometry}).drop("_wkb", "_wkb_head", "_wkb_rings")


def _geometry(b: Column, h: Column, rings: Column, parts: Column) -> Column:
    def points(r: Column) -> Column:
        def point(k: Column) -> Column:
            at = r["at"] + (k - 1) * r["stride"]
            return F.struct(_double(b, at, r["little"]).alias("x"), _double(b, at + 8, r["little"]).alias("y"))

        return F.transform(_steps(r["n"]), point)

    def part(own: Column) -> Column:
        drawn = F.transform(F.filter(own, lambda r: r["n"] >= 0), points)
        first = F.get(own, F.lit(0))
        return F.struct(first["member"].alias("member"), first["kind"].alias("kind"), drawn.alias("rings"))

    def kth(k: Column) -> Column:
        return let(F.filter(rings, lambda r: r["part"] == k - 1), part)

    return F.struct(h["kind"].alias("kind"), h["srid"].alias("srid"), F.transform(_steps(parts), kth).alias("parts"))


def _of_kind(geometry: Column, kind: int) -> Column:
    return F.filter(geometry["parts"], lambda p: p["kind"] == kind)


def points_of(geometry: Column) -> Column:
    """The points of a decoded geometry that are no part of a line or polygon."""
    return F.transform(_of_kind(geometry, POINT), lambda p: F.get(p["rings"][0], F.lit(0)))


def lines_of(geometry: Column) -> Column:
    """The lines of a decoded geometry, each an array of (x, y)."""
    return F.transform(_of_kind(geometry, LINE), lambda p: p["rings"][0])


def polygons_of(geometry: Column) -> Column:
    """The polygons of a decoded geometry, each an array of rings."""
    return F.transform(_of_kind(geometry, POLYGON), lambda p: p["rings"])


def _ring_text(ring: Column) -> Column:
    pair = lambda p: F.concat(coordinate_text(p["x"]), F.lit(" "), coordinate_text(p["y"]))
    return F.concat(F.lit("("), F.array_join(F.transform(ring, pair), ", "), F.lit(")"))


def _polygon_text(part: Column) -> Column:
    return F.concat(F.lit("("), F.array_join(F.transform(part["rings"], _ring_text), ", "), F.lit(")"))


def wkt_of(geometry: Column) -> Column:
    """Text of a decoded geometry, such as ``MULTILINESTRING ((0 0, 1 1))``; empty parts are written EMPTY.

    A collection is written with its members' parts one by one.
    """

    def named(name: str, body: Column, there: Column) -> Column:
        return F.when(there, F.concat(F.lit(f"{name} "), body)).otherwise(F.lit(f"{name} EMPTY"))

    def single(part: Column) -> Column:
        ring = F.get(part["rings"], F.lit(0))
        drawn = F.coalesce(F.get(ring, F.lit(0))["x"].isNotNull(), F.lit(False))
        return (
            F.when(part["kind"] == POINT, named("POINT", _ring_text(ring), drawn))
            .when(part["kind"] == LINE, named("LINESTRING", _ring_text(ring), F.size(ring) > 0))
            .otherwise(named("POLYGON", _polygon_text(part), F.size(part["rings"]) > 0))
        )

    def text(g: Column) -> Column:
        parts = g["parts"]
        some = F.size(parts) > 0
        joined = lambda each: F.concat(F.lit("("), F.array_join(F.transform(parts, each), ", "), F.lit(")"))
        ring = lambda p: _ring_text(p["rings"][0])
        return (
            F.when(g["kind"] <= POLYGON, single(F.get(parts, F.lit(0))))
            .when(g["kind"] == MULTIPOINT, named("MULTIPOINT", joined(ring), some))
            .when(g["kind"] == MULTILINE, named("MULTILINESTRING", joined(ring), some))
            .when(g["kind"] == MULTIPOLYGON, named("MULTIPOLYGON", joined(_polygon_text), some))
            .when(g["kind"] == COLLECTION, named("GEOMETRYCOLLECTION", joined(single), some))
        )

    return let(geometry, text)
