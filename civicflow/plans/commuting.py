"""Census-tract centroids, travel modes and commute flows."""

from __future__ import annotations

from pyspark.sql import functions as F

from civicflow.functions.codes import label
from civicflow.functions.geometry import centroid, parse_polygons, point_wkt_of
from civicflow.functions.numbers import to_count, to_number, to_number_marked, truncated
from civicflow.functions.text import nth_part
from civicflow.operators.relate import distinct_ids, union_missing
from civicflow.operators.reshape import pivot_single, root_sum_squares, total, unpivot_structs
from civicflow.plans import schemas
from civicflow.plans.fixed_values import (
    AUTO,
    CARPOOL,
    CITY_COUNTIES,
    PUBLIC,
    TRAVEL_LABELS,
    TRAVEL_VARIABLES,
    WORKPLACE_COUNTIES,
)
from civicflow.plans.job import Frames, JobSpec


def build_centroids(inputs: Frames) -> Frames:
    """Centre of every tract that occurs in the commute flows."""
    tracts = union_missing(inputs["tracts_a"], inputs["tracts_b"], inputs["tracts_c"])
    ids = distinct_ids(inputs["journey_to_work"], ["residential_geoid", "work_geoid"], "geoid")
    placed = ids.join(tracts.select(F.col("GEOID").alias("geoid"), "geom"), "geoid")
    return {
        "censustract_centroids": placed.withColumn("geom", point_wkt_of(centroid(parse_polygons("geom"))))
    }


CENTROIDS = JobSpec(
    "censustract_centroids",
    ["tracts_a", "tracts_b", "tracts_c", "journey_to_work"],
    {"censustract_centroids": schemas.CENSUSTRACT_CENTROIDS},
    build_centroids,
)


def travel_variables(mode_split, compat: bool = False):
    """Estimate and margin of error by tract and travel mode, with totals.

    A tract's margins are rolled up as the root of the sum of squares of their
    own group.  ``compat`` gives the totals of the published table instead: its
    auto and public margins are further roots of the carpool margin (trap T1).
    """
    modes = list(TRAVEL_VARIABLES.values())
    tail = nth_part("geoid", "US", 1)
    rows = mode_split.select(
        F.right(tail, F.lit(12)).alias("geoid"),
        label("lineno", TRAVEL_VARIABLES, "").alias("variable"),
        to_count("est").alias("value"),
        to_number_marked("moe").alias("moe"),
    ).filter(
        # A tract id is the county followed by six digits.  Unknown modes are in
        # no column of the pivot, but a tract with no others stays, with zeros
        # (trap T2).
        F.left("geoid", F.greatest(F.length("geoid") - 6, F.lit(0))).isin(*CITY_COUNTIES)
    )
    values = {"value": F.col("value").cast("double"), "moe": F.col("moe")}
    wide = pivot_single(rows, ["geoid"], "variable", modes, values)

    def entry(names: list[str], margin=None):
        value = total([F.col(f"{n}.value") for n in names])
        margin = root_sum_squares([F.col(f"{n}.moe") for n in names]) if margin is None else margin
        return F.struct(value.alias("value"), margin.alias("moe"))

    carpool = root_sum_squares([F.col(f"{n}.moe") for n in CARPOOL])
    published = F.sqrt(carpool) if compat else None
    wide = wide.withColumns(
        {
            "trans_auto_carpool_total": entry(CARPOOL),
            "trans_auto_total": entry(AUTO, published),
            "trans_public_total": entry(PUBLIC, published),
        }
    )
    totals = ["trans_auto_carpool_total", "trans_auto_total", "trans_public_total"]
    long = unpivot_structs(wide, ["geoid"], modes + totals, "variable", ["value", "moe"])
    return long.withColumn("value", truncated("value")).withColumn("moe", truncated("moe"))


def build_variables(inputs: Frames) -> Frames:
    return {"censustract_variables": travel_variables(inputs["mode_split"])}


VARIABLES = JobSpec(
    "censustract_variables",
    ["mode_split"],
    {"censustract_variables": schemas.CENSUSTRACT_VARIABLES},
    build_variables,
)


def build_journey_to_work(inputs: Frames) -> Frames:
    """Flows to the 31 counties with the mode spelled out.

    The code column is replaced, not kept beside the label: names differ only
    in case (trap T18).
    """
    flows = inputs["commute_flows"].filter(F.col("workplace_state_county").isin(*WORKPLACE_COUNTIES))
    out = flows.select(
        F.col("res_tract").alias("residential_geoid"),
        F.col("work_tract").alias("work_geoid"),
        label("mode", TRAVEL_LABELS, "").alias("MODE"),
        truncated(to_number("`totwork_16+`"), "bigint").alias("count"),
        to_number("standard_error").alias("standard_error"),
    )
    return {"journey_to_work": out}


JOURNEY_TO_WORK = JobSpec(
    "journey_to_work",
    ["commute_flows"],
    {"journey_to_work": schemas.JOURNEY_TO_WORK},
    build_journey_to_work,
)
