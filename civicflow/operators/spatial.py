"""Lines that meet polygons, as a grid join.

A connected line meets an area exactly when its first vertex lies in it or one
of its segments meets the outline.  The outlines are laid on a grid edge by
edge; a scan along each band of cells finds those wholly inside and, for the
others, on which side they begin.  Both tests then run on one equal-key join by
cell, against single edges, and are summed up by line.  A union of the areas is
not needed: meeting any of them is the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from civicflow.functions.geometry import edges
from civicflow.operators.relate import computed

# Slack, in cells, so that rounding never drops a cell that is only touched.
_SLACK = 1e-9


def _cell(c: Column, size: float) -> Column:
    return F.floor(c / F.lit(size)).cast("long")


def _span(low: Column, high: Column, size: float) -> Column:
    return F.sequence(_cell(low - size * _SLACK, size), _cell(high + size * _SLACK, size))


def _clipped(low: Column, high: Column, least: Column, most: Column, size: float) -> Column:
    """The cells of a span that lie in the box; none where it lies beside it."""
    low, high = F.greatest(low, least), F.least(high, most)
    return F.when(low <= high + 2 * size * _SLACK, _span(low, F.greatest(low, high), size))


def _x_at(e: Column, y: Column) -> Column:
    """Where an edge, drawn on without end, is at a height."""
    rise = e["y2"] - e["y1"]
    return (e["x2"] - e["x1"]) * (y - e["y1"]) / F.when(rise != 0, rise) + e["x1"]


def _cross(ax, ay, bx, by, px, py) -> Column:
    return (bx - ax) * (py - ay) - (by - ay) * (px - ax)


def segments_meet(a: Column, b: Column) -> Column:
    """Whether two segments share a point, end points included."""
    d1 = _cross(b["x1"], b["y1"], b["x2"], b["y2"], a["x1"], a["y1"])
    d2 = _cross(b["x1"], b["y1"], b["x2"], b["y2"], a["x2"], a["y2"])
    d3 = _cross(a["x1"], a["y1"], a["x2"], a["y2"], b["x1"], b["y1"])
    d4 = _cross(a["x1"], a["y1"], a["x2"], a["y2"], b["x2"], b["y2"])
    boxes = (
        (F.greatest(a["x1"], a["x2"]) >= F.least(b["x1"], b["x2"]))
        & (F.greatest(b["x1"], b["x2"]) >= F.least(a["x1"], a["x2"]))
        & (F.greatest(a["y1"], a["y2"]) >= F.least(b["y1"], b["y2"]))
        & (F.greatest(b["y1"], b["y2"]) >= F.least(a["y1"], a["y2"]))
    )
    sides = (F.signum(d1) * F.signum(d2) <= 0) & (F.signum(d3) * F.signum(d4) <= 0)
    return boxes & sides


def _low(e: Column, axis: str) -> Column:
    return F.least(e[f"{axis}1"], e[f"{axis}2"])


def _high(e: Column, axis: str) -> Column:
    return F.greatest(e[f"{axis}1"], e[f"{axis}2"])


def traced(df: DataFrame, e: Column, size: float, box: Column | None = None) -> DataFrame:
    """The cells (cx, cy) that each row's segment runs through, band by band.

    With a box, what sticks out of it is left off before it is laid on the grid.
    """

    def laid(low: Column, high: Column, axis: str) -> Column:
        if box is None:
            return _span(low, high, size)
        return _clipped(low, high, box[f"{axis}0"], box[f"{axis}1"], size)

    # Each step is a column of its own below an explode, so it is worked out once a row.
    kept = df.columns
    rise = e["y2"] - e["y1"]
    sloped = df.select("*", F.when(rise == 0, 0.0).otherwise((e["x2"] - e["x1"]) / F.when(rise != 0, rise)).alias("_slope"))
    bands = sloped.select("*", F.explode(laid(_low(e, "y"), _high(e, "y"), "y")).alias("cy"))
    # x at the lower and upper border of the band, kept within the segment.
    bottom, top = F.col("cy") * F.lit(size), (F.col("cy") + 1) * F.lit(size)

    def at(y: Column) -> Column:
        return e["x1"] + F.col("_slope") * (F.greatest(F.least(y, _high(e, "y")), _low(e, "y")) - e["y1"])

    reach = bands.select("*", at(bottom).alias("_at0"), at(top).alias("_at1"))
    level = rise == 0
    low = F.when(level, _low(e, "x")).otherwise(F.least("_at0", "_at1"))
    high = F.when(level, _high(e, "x")).otherwise(F.greatest("_at0", "_at1"))
    spans = reach.select(*kept, "cy", low.alias("_low"), high.alias("_high"))
    return spans.select(*kept, "cy", F.explode(laid(F.col("_low"), F.col("_high"), "x")).alias("cx"))


def edge_cells(areas: DataFrame, polygons: Column, size: float) -> DataFrame:
    """Each outline edge in each cell it runs through: (area, e, cx, cy, crosses).

    ``crosses`` tells whether the edge crosses the middle of the band in this
    cell; whatever way it runs, it does so in one cell only.  An outline is
    taken apart here, so from here on no row holds more than one edge.
    """
    # Areas that occur twice are one; what a copy would add to a parity cancels out.
    rows = areas.select(F.xxhash64(polygons).alias("area"), polygons.alias("polygons")).dropDuplicates(["area"])
    outline = F.flatten(F.transform(F.flatten(F.col("polygons")), edges))
    e = F.col("e")
    cells = traced(rows.select("area", F.explode(outline).alias("e")), e, size)
    middle = (F.col("cy") + 0.5) * F.lit(size)
    crosses = ((e["y1"] > middle) != (e["y2"] > middle)) & (_cell(_x_at(e, middle), size) == F.col("cx"))
    return cells.select("area", "e", "cx", "cy", F.coalesce(crosses, F.lit(False)).alias("crosses"))


def raster(cells: DataFrame) -> DataFrame:
    """What the cells of areas hold: (area, cx, cy, e, odd), from ``edge_cells``.

    One row for each edge in a cell, one without an edge for each cell that
    edges run through, whose ``odd`` tells whether the area lies left of the
    cell on the middle of its band, and one with ``odd`` and no edge for each
    cell wholly inside.  A scan along each band finds both: its state is the
    number of crossings so far, a running sum.
    """
    met = cells.groupBy("area", "cy", "cx").agg(F.sum(F.col("crosses").cast("int")).alias("n"))
    along = Window.partitionBy("area", "cy").orderBy("cx")
    through = F.sum("n").over(along.rowsBetween(Window.unboundedPreceding, 0))
    scan = met.select("area", "cy", "cx", "n", through.alias("through"), F.lead("cx").over(along).alias("next"))
    no_edge = F.lit(None).cast(cells.schema["e"].dataType)
    crossed = scan.select(
        "area", "cx", "cy", no_edge.alias("e"), ((F.col("through") - F.col("n")) % 2 == 1).alias("odd")
    )
    gap = scan.filter((F.col("through") % 2 == 1) & (F.col("next") > F.col("cx") + 1))
    whole = gap.select("area", F.explode(F.sequence(F.col("cx") + 1, F.col("next") - 1)).alias("cx"), "cy")
    whole = whole.select("area", "cx", "cy", no_edge.alias("e"), F.lit(True).alias("odd"))
    edge = cells.select("area", "cx", "cy", "e", F.lit(False).alias("odd"))
    return edge.unionByName(crossed.filter("odd")).unionByName(whole)


def passed(e: Column, x: Column, y: Column, cx: Column, cy: Column, size: float) -> Column:
    """How often a path from the left border of a cell, on the middle of its band, to (x, y) in it crosses an edge.

    The path runs along the middle and then straight up or down.  It is taken
    to lie a trace to the right and, by much less, above, so that it never runs
    through a vertex; both halves follow that one rule.
    """
    middle = (cy + 0.5) * F.lit(size)
    at = _x_at(e, middle)
    along = ((e["y1"] > middle) != (e["y2"] > middle)) & (_cell(at, size) == cx) & (at <= x)
    run = e["x2"] - e["x1"]
    slope = (e["y2"] - e["y1"]) / F.when(run != 0, run)
    height = e["y1"] + slope * (x - e["x1"])
    above = lambda level: (height > level) | ((height == level) & (slope > 0))
    upright = ((e["x1"] > x) != (e["x2"] > x)) & (above(middle) != above(y))
    return F.coalesce(along, F.lit(False)).cast("int") + F.coalesce(upright, F.lit(False)).cast("int")


def extent(areas: DataFrame, polygons: Column) -> Column:
    """Bounding box of all areas as (x0, x1, y0, y1), worked out once."""
    points = F.flatten(F.flatten(polygons))
    sides = areas.select(
        F.transform(points, lambda p: p["x"]).alias("x"), F.transform(points, lambda p: p["y"]).alias("y")
    ).agg(
        F.struct(
            F.min(F.array_min("x")).alias("x0"),
            F.max(F.array_max("x")).alias("x1"),
            F.min(F.array_min("y")).alias("y0"),
            F.max(F.array_max("y")).alias("y1"),
        )
    )
    return sides.scalar()


def segment_cells(lines: DataFrame, id_column: str, parts: Column, box: Column, size: float) -> DataFrame:
    """Cells each segment of each line runs through: (_id, row, part, e, first, cy, cx).

    ``row`` and ``part`` tell lines and their parts apart.  Segments outside the
    box are dropped, and what sticks out of it is left off, before they are
    laid on the grid: one stray vertex far away makes no more cells than the
    box has.
    """

    s = lines.select(F.col(id_column).alias("_id"), F.monotonically_increasing_id().alias("row"), F.posexplode(parts).alias("part", "p"))
    # Without lambdas, so that all of it is compiled.
    n = F.size("p") - 1
    ends = F.arrays_zip(F.slice("p", F.lit(1), F.greatest(n, F.lit(1))).alias("a"), F.slice("p", F.least(n + 1, F.lit(2)), F.greatest(n, F.lit(1))).alias("b"))
    s = s.filter(F.size("p") > 0).select("_id", "row", "part", F.posexplode(ends).alias("k", "s"))
    across = ["x", "y"]
    low = {c: F.least(F.col(f"s.a.{c}"), F.col(f"s.b.{c}")) for c in across}
    high = {c: F.greatest(F.col(f"s.a.{c}"), F.col(f"s.b.{c}")) for c in across}
    s = s.filter(
        (high["x"] >= box["x0"]) & (low["x"] <= box["x1"]) & (high["y"] >= box["y0"]) & (low["y"] <= box["y1"])
    )
    whole = [F.col(f"s.{end}.{c}").alias(f"{c}{i}") for i, end in ((1, "a"), (2, "b")) for c in across]
    s = s.select("_id", "row", "part", F.struct(*whole).alias("e"), (F.col("k") == 0).alias("first"))
    e = F.col("e")
    return traced(s, e, size, box)


def meets_any(
    lines: DataFrame, id_column: str, parts: Column, areas: DataFrame, polygons: Column, size: float
) -> DataFrame:
    """Lines whose id belongs to a line meeting any of the areas (J10); arguments as for ``ids_meeting``."""
    hit = ids_meeting(lines, id_column, parts, areas, polygons, size)
    return lines.join(hit, F.col(id_column) == F.col("_id"), "left_semi")


def ids_meeting(
    lines: DataFrame, id_column: str, parts: Column, areas: DataFrame, polygons: Column, size: float
) -> DataFrame:
    """The ids (_id), each once, of lines meeting any of the areas.

    ``parts`` gives an array of lines and ``polygons`` an array of polygons;
    ``size`` is the side of a grid cell in the units of the coordinates.
    Areas are even-odd over all their rings, so holes count.
    """
    near = segment_cells(lines, id_column, parts, extent(areas, polygons), size)
    cells = raster(edge_cells(areas, polygons, size)).withColumnRenamed("e", "edge")
    e, edge = F.col("e"), F.col("edge")
    here = F.col("first") & (_cell(e["x1"], size) == F.col("cx")) & (_cell(e["y1"], size) == F.col("cy"))
    met = F.coalesce(segments_meet(edge, e), F.lit(False))
    turns = F.when(F.col("odd"), 1).otherwise(passed(edge, e["x1"], e["y1"], F.col("cx"), F.col("cy"), size))
    joined = computed(near.join(cells, ["cx", "cy"]), {"met": met, "turns": F.when(here, turns).otherwise(0)})
    # An edge of several cells is met in each, but a start is in one cell only.
    groups = joined.filter(F.col("met") | (F.col("turns") > 0)).groupBy("_id", "row", "part", "area")
    hit = groups.agg(F.max("met").alias("met"), F.sum("turns").alias("turns")).filter(
        F.col("met") | (F.col("turns") % 2 == 1)
    )
    return hit.select("_id").distinct()
