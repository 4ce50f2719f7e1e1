"""Enrolment projections by borough and by subdistrict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civicflow.functions.codes import range_label
from civicflow.functions.numbers import allocate, to_count, to_number, to_whole
from civicflow.operators.reshape import group_sum, pivot_sum, unpivot, unpivot_structs
from civicflow.plans import schemas
from civicflow.plans.fixed_values import (
    BOROUGH_BY_DISTRICT,
    HIGH_SCHOOL_GRADES,
    MIDDLE_GRADES,
    PRIMARY_GRADES,
)
from civicflow.plans.job import Frames, JobSpec

_NOT_YEARS = {"ogc_fid", "district", "projected"}


def year_columns(projections: DataFrame) -> list[str]:
    """The columns that hold one school year each."""
    return [c for c in projections.columns if c not in _NOT_YEARS]


def _pupils(year: str) -> Column:
    """Whole number with thousands commas (trap T22)."""
    return to_count(f"`{year}`")


def build_by_boro(inputs: Frames) -> Frames:
    """High-school enrolment by borough and year.

    Sums over districts and then over boroughs are one sum over boroughs, so
    the borough is looked up first and the rows are shuffled once.
    """
    projections = inputs["projections"]
    years = year_columns(projections)
    grades = projections.filter(F.col("projected").isin(*HIGH_SCHOOL_GRADES)).select(
        range_label(to_whole("district"), BOROUGH_BY_DISTRICT).alias("borough"),
        *[_pupils(y).alias(y) for y in years],
    )
    sums = group_sum(grades, ["borough"], years, "bigint")
    long = unpivot(sums, ["borough"], years, "school_year", "hs")
    return {"projections_by_boro": long.withColumn("year", F.left("school_year", F.lit(4)))}


PROJECTIONS_BY_BORO = JobSpec(
    "projections_by_boro",
    ["projections"],
    {"projections_by_boro": schemas.PROJECTIONS_BY_BORO},
    build_by_boro,
)


def district_levels(projections: DataFrame) -> DataFrame:
    """Primary and middle enrolment by district and year, side by side.

    Districts lacking either level are left out, as in a join of the two.
    """
    years = year_columns(projections)
    primary, middle = F.col("projected").isin(*PRIMARY_GRADES), F.col("projected").isin(*MIDDLE_GRADES)

    def both(year: str) -> Column:
        pupils = _pupils(year)
        return F.struct(
            F.sum(F.when(primary, pupils)).alias("ps"), F.sum(F.when(middle, pupils)).alias("is")
        ).alias(year)

    kept = projections.filter((primary | middle) & F.col("district").isNotNull())
    sums = kept.groupBy("district").agg(
        F.bool_or(primary).alias("_has_ps"), F.bool_or(middle).alias("_has_is"), *[both(y) for y in years]
    )
    sums = sums.filter("_has_ps AND _has_is")
    return unpivot_structs(sums, ["district"], years, "school_year", ["ps", "is"])


def subdistrict_shares(split_pct: DataFrame) -> DataFrame:
    """Primary and middle multiplier by subdistrict, 0 where none is given."""
    rows = split_pct.withColumn("multiplier", to_number("multiplier"))
    levels = {"PS": "ps_multiplier", "MS": "is_multiplier"}
    return pivot_sum(rows.dropna(subset=["level"]), ["district", "subdistrict"], "level", levels, F.col("multiplier"))


def build_by_sd(inputs: Frames) -> Frames:
    """Enrolment shared out to subdistricts, rounded up.

    Only districts on both sides are published (trap T17); the others are the
    second result.  Shares stay doubles here (trap T6).
    """
    shares = subdistrict_shares(inputs["split_pct"])
    levels = district_levels(inputs["projections"])
    out = shares.join(levels, "district").select(
        F.left("school_year", F.lit(4)).alias("school_year"),
        "district",
        "subdistrict",
        allocate(F.col("ps").cast("double"), "ps_multiplier").alias("ps"),
        allocate(F.col("is").cast("double"), "is_multiplier").alias("is"),
    )
    return {"projections_by_sd": out, "projections_by_sd_unmatched": unmatched_districts(inputs)}


def unmatched_districts(inputs: Frames) -> DataFrame:
    """Districts with shares but no projection, or the other way round."""
    shares = subdistrict_shares(inputs["split_pct"]).select("district").distinct()
    levels = district_levels(inputs["projections"]).select("district").distinct()
    return (
        shares.join(levels, "district", "left_anti")
        .withColumn("missing", F.lit("projections"))
        .unionByName(levels.join(shares, "district", "left_anti").withColumn("missing", F.lit("split_pct")))
    )


PROJECTIONS_BY_SD = JobSpec(
    "projections_by_sd",
    ["split_pct", "projections"],
    {
        "projections_by_sd": schemas.PROJECTIONS_BY_SD,
        "projections_by_sd_unmatched": "district text\nmissing text",
    },
    build_by_sd,
)
