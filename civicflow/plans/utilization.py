"""School utilization changes and the meeting pages they refer to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civicflow.functions.dates import date_from, school_year, us_date
from civicflow.functions.links import explode_anchors, first_date_in_path, path_part, readable
from civicflow.functions.numbers import range_end
from civicflow.functions.text import blank, display_key
from civicflow.operators.dedup import adjacent_runs_best
from civicflow.operators.relate import full_outer
from civicflow.plans import schemas
from civicflow.plans.fixed_values import FIRST_MEETING_DAY
from civicflow.plans.job import Frames, JobSpec

# What marks a meeting folder, what rules it out, and where the
# school year stands in its path.
SHARED_FOLDER = "sharepoint"
NOT_A_MEETING = "Contracts"
YEAR_POSITION = 11


def meeting_urls(pages: DataFrame, resolved: DataFrame | None = None) -> DataFrame:
    """Meeting folders linked from stored pages, one for each run (R8 feeder).

    ``pages`` holds a numeric page_id, source ('current' or 'archive') and html;
    pages and links keep their order, current pages first.  ``resolved`` may hold (href,
    target) where a link leads elsewhere.  Links without a date are kept on
    archive pages only (G-BLANK); of neighbours with the same date and school
    year the shortest address stays (A7).
    """
    links = explode_anchors(pages, keep=["source", "page_id"]).filter(F.col("href").contains(SHARED_FOLDER))
    if resolved is not None:
        links = links.join(resolved.select("href", "target"), "href", "left")
        target = F.coalesce("target", "href")
    else:
        target = F.col("href")
    day = first_date_in_path("readable_url")
    links = (
        links.withColumn("readable_url", readable(target))
        .filter(~F.col("readable_url").contains(NOT_A_MEETING))
        .select(
            F.when(F.col("source") == "current", 0).otherwise(1).alias("_rank"),
            "page_id",
            "pos",
            F.col("href").alias("url"),
            path_part("readable_url", YEAR_POSITION).alias("school_year"),
            "readable_url",
            blank(F.date_format(day, "yyyy-MM-dd")).alias("date"),
            "source",
        )
        .filter(F.col("school_year").isNotNull() & ((F.col("date") != "") | (F.col("source") != "current")))
    )
    best = adjacent_runs_best(
        links,
        [],
        # Page numbers by their first 16 bits, 32, 48, and one by one: whatever
        # the numbers, no piece has more than 2 * 65,536 pieces of the next level.
        [
            F.struct("_rank", F.shiftright(F.col("page_id").cast("bigint"), 48)),
            F.shiftright(F.col("page_id").cast("bigint"), 32),
            F.shiftright(F.col("page_id").cast("bigint"), 16),
            F.col("page_id"),
        ],
        ["_rank", "page_id", "pos"],
        F.struct("date", "school_year"),
        F.length("readable_url"),
    )
    return best.select("url", "school_year", "readable_url", "date")


MEETING_URLS = JobSpec(
    "meeting_urls",
    ["meeting_pages"],
    {"meeting_urls": schemas.MEETING_URLS},
    lambda inputs: {"meeting_urls": meeting_urls(inputs["meeting_pages"])},
    keep_empty=frozenset(["meeting_urls"]),
)


def approved_proposals(proposals: DataFrame) -> DataFrame:
    """Approved proposals with enrolment, vote date and meeting key."""
    vote = us_date("pep_vote")
    return proposals.filter(F.col("approved") == "Approved").select(
        F.col("main_building_id").alias("bldg_id"),
        F.right("dbn", F.lit(4)).alias("org_id"),
        F.col("other_impacted_building").alias("bldg_id_additional"),
        F.col("proposal_title").alias("title"),
        "at_scale_year",
        range_end("at_scale_school_enrollment").alias("at_scale_enroll"),
        F.col("pep_vote").alias("vote_date"),
        display_key(school_year(vote), date_from("pep_vote", FIRST_MEETING_DAY)).alias("join_key"),
    )


def build_utilization_changes(inputs: Frames) -> Frames:
    """Approved proposals beside their meeting's folder, both sides kept."""
    urls = inputs["meeting_urls"].select("url", display_key("school_year", "date").alias("join_key"))
    return {"utilization_changes": full_outer(approved_proposals(inputs["proposals"]), urls, ["join_key"])}


UTILIZATION_CHANGES = JobSpec(
    "utilization_changes",
    ["proposals", "meeting_urls"],
    {"utilization_changes": schemas.UTILIZATION_CHANGES},
    build_utilization_changes,
    keep_empty=frozenset(["utilization_changes"]),
)
