"""Roadways off grade, roads in the city and traffic counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from civicflow.functions.codes import label
from civicflow.functions.geometry import parse_lines, parse_polygons
from civicflow.functions.text import blank, blank_to_null, stripped
from civicflow.functions.wkb import lines_of, polygons_of
from civicflow.operators.relate import lookup_left
from civicflow.operators.spatial import ids_meeting
from civicflow.plans import schemas
from civicflow.plans.fixed_values import BOROCODE_BY_COUNTY_CODE
from civicflow.plans.job import Frames, JobSpec
from civicflow.sources.shapes import SHAPE, decoded_geometry, scan_geometry

# Node levels at grade, and bike lanes that are paths of their own.
GRADE_LEVELS = ["M", "*", "$"]
BIKE_PATHS = ["1", "2", "4", "9"]


def build_atypical_roadways(inputs: Frames) -> Frames:
    """Roadways with an end above or below grade, without paths.

    A NULL level, direction, feature type or bike lane fails its test, as in
    SQL; a NULL number of lanes passes.
    """
    lines = inputs["street_lines"]
    lanes = blank_to_null("number_total_lanes").try_cast("decimal(38,10)")
    bikelane = F.trim("bikelane")
    kept = lines.filter(
        (~F.col("nodelevelf").isin(*GRADE_LEVELS) | ~F.col("nodelevelt").isin(*GRADE_LEVELS))
        & (F.col("trafdir") != "P")
        & (F.col("featuretyp") != "1")
        & ((lanes != 1) | lanes.isNull())
        & ~bikelane.isin(*BIKE_PATHS)
    )
    out = kept.select(
        F.col("street").alias("streetname"),
        "segmentid",
        "streetwidth_min",
        "streetwidth_max",
        F.col("lzip").alias("left_zipcode"),
        F.col("rzip").alias("right_zipcode"),
        F.left("streetcode", F.lit(1)).alias("borocode"),
        "nodelevelf",
        "nodelevelt",
        "featuretyp",
        "trafdir",
        # Published as the text of a float, such as 2.0.
        lanes.cast("double").cast("string").alias("number_total_lanes"),
        bikelane.alias("bikelane"),
        "geom",
    )
    return {"atypical_roadways": out}


ATYPICAL_ROADWAYS = JobSpec(
    "atypical_roadways",
    ["street_lines"],
    {"atypical_roadways": schemas.ATYPICAL_ROADWAYS},
    build_atypical_roadways,
)

# Side of a grid cell in degrees, about a kilometre.
GRID = 0.01


def build_functional_class(inputs: Frames) -> Frames:
    """Road lines that meet any borough boundary's area.

    Which lines do is told from their shapes alone; their text is made of the found ones only.
    """
    lines, areas = decoded_geometry(inputs["road_lines"]), inputs["boundaries"]
    parts, polygons = parse_lines("geom"), parse_polygons("geom")
    if SHAPE in lines.columns:
        parts = F.coalesce(lines_of(F.col(SHAPE)), parts)
    if SHAPE in areas.columns:
        polygons = F.coalesce(polygons_of(F.col(SHAPE)), polygons)
    met = ids_meeting(lines, "ogc_fid", parts, areas, polygons, GRID)
    found = inputs["road_lines"].join(met, F.col("ogc_fid") == F.col("_id"), "left_semi")
    found = scan_geometry(found).filter(F.col("geom").isNotNull())
    return {"functional_class": found.withColumn("borough", F.col("municipality_desc"))}


FUNCTIONAL_CLASS = JobSpec(
    "functional_class",
    ["road_lines", "boundaries"],
    {"functional_class": schemas.FUNCTIONAL_CLASS},
    build_functional_class,
    late=frozenset(["road_lines"]),
)


def build_traffic_counts(inputs: Frames) -> Frames:
    """Counts of the five counties with the geometry of their station."""
    counts = inputs["traffic_counts"].filter(F.col("cou").isin(*BOROCODE_BY_COUNTY_CODE))
    counts = counts.withColumn("borocode", label("cou", BOROCODE_BY_COUNTY_CODE)).withColumn(
        "rc_station", stripped("rc_station")
    )
    lines = inputs["traffic_lines"].select(F.col("rc_id").alias("rc_station"), "geom")
    return {"traffic_counts": lookup_left(counts, lines, "rc_station").withColumn("geom", blank("geom"))}


TRAFFIC_COUNTS = JobSpec(
    "traffic_counts",
    ["traffic_counts", "traffic_lines"],
    {"traffic_counts": schemas.TRAFFIC_COUNTS},
    build_traffic_counts,
)
