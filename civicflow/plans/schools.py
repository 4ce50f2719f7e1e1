"""School buildings from the blue book and the school list (R2)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civicflow.functions.codes import last_match
from civicflow.functions.geometry import point_wkt
from civicflow.functions.numbers import allocate, percent_share, to_exact
from civicflow.functions.text import blank, stripped
from civicflow.operators.relate import exists_flag, not_in
from civicflow.plans import schemas
from civicflow.plans.fixed_values import (
    COMPETITIVE_HIGH_SCHOOLS,
    GIFTED_SCHOOLS,
    OTHER_SCHOOLS,
    RESTART_SCHOOLS,
)
from civicflow.plans.job import Frames, JobSpec, Share, as_is


def _like(c: str, text: str) -> Column:
    return F.col(c).rlike(f"(?i){text}")


def blue_book_exclusion() -> Column:
    """Why a blue-book row is left out; the last reason that holds."""
    level, school, name = F.col("org_level"), F.col("org_id"), "organization_name"
    return last_match(
        [
            (school.isNull(), "no school id"),
            (level.isNull() | level.isin("SPED", "OTHER"), "level not served"),
            (F.col("charter").isNotNull(), "charter"),
            (
                _like(name, "ALC") | _like(name, "ALTERNATIVE LEARNING") | school.isin(*RESTART_SCHOOLS),
                "alternative or restart",
            ),
            (_like(name, "Adult") | _like(name, "pre-k"), "adult or pre-k"),
            (school.isin(*COMPETITIVE_HIGH_SCHOOLS), "competitive"),
            (school.isin(*GIFTED_SCHOOLS), "gifted"),
            (school.isin(*OTHER_SCHOOLS), "other school"),
        ]
    )


def school_list_exclusion() -> Column:
    """Why a school-list row is left out; the last reason that holds."""
    category, kind = F.col("location_category_description"), F.col("location_type_description")
    school, building = F.col("location_code"), "building_name"
    return last_match(
        [
            (category.isNull() | (category == "Ungraded"), "ungraded"),
            (F.col("managed_by_name") != "DOE", "managed by others"),
            (
                kind.isin("Special Education", "Home School"),
                "special or home school",
            ),
            (school.isin(*COMPETITIVE_HIGH_SCHOOLS), "competitive"),
            (school.isin(*GIFTED_SCHOOLS), "gifted"),
            (
                _like(building, " AF") | _like(building, "GYM") | _like(building, " FARM "),
                "not a classroom building",
            ),
            (school.isin(*OTHER_SCHOOLS), "other school"),
        ]
    )


def tagged_school_list(inputs: Frames) -> tuple[DataFrame, DataFrame]:
    """(blue book, school list) with ``excluded`` and the list's ``match``."""
    renamed = {"ps_%": "ps_per", "ms_%": "ms_per", "hs_%": "hs_per", "bldg_excl.": "bldg_excl"}
    book = inputs["blue_book"].withColumnsRenamed(renamed).withColumn("excluded", blue_book_exclusion())
    schools = inputs["school_list"].withColumn("excluded", school_list_exclusion())

    # Rows not in the blue book; a NULL key on either side tags nothing.
    included = book.filter(F.col("excluded").isNull())
    key = F.concat("location_code", "building_code")
    schools = not_in(schools, key, included, F.concat("org_id", "bldg_id"), "_absent")
    absent = F.col("_absent") & F.col("excluded").isNull()
    schools = schools.withColumn("match", F.when(absent, F.lit("not in blue book"))).drop("_absent")

    # Minis and portables beside another structure of the school on the lot.
    solid = inputs["school_list"].filter(~_like("building_name", "PORTABLE") & ~_like("building_name", "MINI"))
    lot = F.concat("location_code", "borough_block_lot")
    schools = exists_flag(schools, lot, solid, lot, "_beside")
    mini = (
        F.col("_beside")
        & (_like("building_name", "PORTABLE") | _like("building_name", "MINI"))
        & F.col("excluded").isNull()
        & F.col("match").isNotNull()
    )
    tag = F.when(mini, F.lit("annex of another building")).otherwise(F.col("excluded"))
    return book, schools.withColumn("excluded", tag).drop("_beside")


# Columns a researcher fills in for unmatched schools.
RESEARCH_COLUMNS = [
    "district",
    "subdistrict",
    "org_level",
    "org_e",
    "pc",
    "ic",
    "hc",
    "ps_per",
    "ms_per",
    "hs_per",
]


def research_list(schools: DataFrame) -> DataFrame:
    """Included rows that are not in the blue book, with blanks to fill."""
    open_rows = schools.filter(F.col("excluded").isNull() & F.col("match").isNotNull())
    return open_rows.select("*", *[F.lit(None).cast("string").alias(c) for c in RESEARCH_COLUMNS])


def unmatched_blue_book(inputs: Frames) -> DataFrame:
    """Blue-book rows tagged when they are not in the school list."""
    book = inputs["blue_book"].withColumn("excluded", blue_book_exclusion())
    included = inputs["school_list"].filter(school_list_exclusion().isNull())
    key = F.concat("org_id", "bldg_id")
    tagged = not_in(book, key, included, F.concat("location_code", "building_code"), "_absent")
    absent = F.col("_absent") & F.col("excluded").isNull()
    return tagged.withColumn("match", F.when(absent, F.lit("not in lcgms"))).drop("_absent")


def build_school_buildings(inputs: Frames, share: Share = as_is) -> Frames:
    """Listed buildings with the blue book's enrolment and capacity (R2)."""
    book, schools = tagged_school_list(inputs)
    schools = share(schools, "school_list")
    a = schools.filter(F.col("excluded").isNull() & F.col("match").isNull()).alias("a")
    b = book.filter(F.col("excluded").isNull()).alias("b")
    same = (F.col("a.location_code") == F.col("b.org_id")) & (F.col("a.building_code") == F.col("b.bldg_id"))

    def whole(value: Column, *sources: str) -> Column:
        """The whole number as text, 0 where a source is missing, and else what cannot be read or does not fit.

        Publishing counts such text as unreadable, so it is not mistaken for 0 (T19).
        """
        missing = reduce(lambda x, y: x | y, [stripped(blank(c)) == "" for c in sources])
        text = F.coalesce(value.cast("string"), *[F.when(to_exact(bare(c)).isNull(), F.col(c)) for c in sources], F.lit("too large"))
        return F.when(missing, F.lit("0")).otherwise(text)

    def bare(c: str) -> Column:
        return F.replace(F.col(c), F.lit("%"), F.lit(""))

    def capacity(c: str) -> Column:
        return whole(F.floor(to_exact(c)), c)

    def enrolment(share: str) -> Column:
        return whole(allocate(to_exact("b.org_e"), percent_share(share)), "b.org_e", share)

    def coordinate(c: str) -> Column:
        return stripped(F.replace(F.col(c), F.lit("NULL"), F.lit("0"))).try_cast("double")

    out = a.join(b, same, "left").select(
        "b.district",
        "b.subdistrict",
        F.left("a.borough_block_lot", F.lit(1)).alias("borocode"),
        F.col("a.building_name").alias("bldg_name"),
        F.col("b.bldg_excl").alias("excluded"),
        F.col("a.building_code").alias("bldg_id"),
        F.col("a.location_code").alias("org_id"),
        "b.org_level",
        F.col("a.location_name").alias("name"),
        F.col("a.address_line_1").alias("address"),
        capacity("b.pc").alias("pc"),
        enrolment("b.ps_per").alias("pe"),
        capacity("b.ic").alias("ic"),
        enrolment("b.ms_per").alias("ie"),
        capacity("b.hc").alias("hc"),
        enrolment("b.hs_per").alias("he"),
        point_wkt(coordinate("a.longitude"), coordinate("a.latitude")).alias("geom"),
    )
    return {"school_buildings": out, "school_research": research_list(schools)}


# The research list is a working table without a fixed schema; its columns are
# those of the source and the ones to fill in.
RESEARCH_SCHEMA = "\n".join(
    f"{c} text"
    for c in [
        "location_code",
        "building_code",
        "location_name",
        "building_name",
        "address_line_1",
        "borough_block_lot",
        "longitude",
        "latitude",
        "location_category_description",
        "location_type_description",
        "managed_by_name",
        "match",
        *RESEARCH_COLUMNS,
    ]
)

SCHOOL_BUILDINGS = JobSpec(
    "school_buildings",
    ["blue_book", "school_list"],
    {"school_buildings": schemas.SCHOOL_BUILDINGS, "school_research": RESEARCH_SCHEMA},
    build_school_buildings,
    shares=True,
)
