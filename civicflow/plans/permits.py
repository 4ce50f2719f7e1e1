"""Boiler permits and facility permits, geocoded."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civicflow.functions.address import house_number, street_name
from civicflow.functions.dates import iso_date, us_date
from civicflow.functions.links import cell_anchor
from civicflow.functions.text import (
    AIRPORT_MARK,
    CROSSING_NARROW,
    CROSSING_WIDE,
    before,
    blank,
    clean_borough,
    clean_house,
    clean_street,
    crossing_part,
    cut_at_first,
    empty_to_null,
    prefer,
    replace_if_different,
    sentinel_to_null,
    spaced,
    stripped,
)
from civicflow.operators.dedup import latest_per_key
from civicflow.operators.geocode import drop_outside_city, geocode, place_result, use_manual_position
from civicflow.operators.relate import computed, known_or_blank, lookup_left, null_safe_left
from civicflow.plans import schemas
from civicflow.plans.fixed_values import PERMIT_URL_PREFIX, REGISTRATION_TYPES, REVIEW_REPORT
from civicflow.plans.job import Frames, JobSpec, Share, as_is
from civicflow.sources.publish import split_by

NO_PARCEL = "0000000000"


def wanted_boiler_permits(permits: DataFrame) -> DataFrame:
    """Live permits that are no mere registrations.

    As in SQL, a NULL status, id or (for ids starting with P) request type
    leaves the row out.
    """
    kind = F.left("applicationid", F.lit(1))
    registration = (kind == "P") & F.col("requesttype").isin(*REGISTRATION_TYPES)
    return permits.filter((F.trim("status") != "CANCELLED") & (kind != "G") & (kind != "C") & ~registration)


def addressed_boiler_permits(permits: DataFrame) -> DataFrame:
    """Permits with clean borough, house, streets and address."""
    renamed = permits.withColumnsRenamed(
        {"house": "housenum", "street": "streetname", "issuedate": "issue_date", "expirationdate": "expiration_date"}
    )
    borough = clean_borough("borough")
    at_airport = F.coalesce(F.col("streetname").contains(AIRPORT_MARK), F.lit(False))
    cleaned = {
        # Permits at the airport without a borough are in Queens (trap T3).
        "borough": F.when(at_airport & borough.isNull(), F.lit("Queens")).otherwise(borough),
        "address": spaced(clean_house("housenum", blank_leading_zero=True), clean_street("streetname")),
        "status": stripped("status"),
    }
    parts = {
        "hnum": house_number("address"),
        "sname": street_name("address"),
        "streetname_1": street_name(crossing_part("address", CROSSING_WIDE, first=True)),
        "streetname_2": street_name(crossing_part("address", CROSSING_WIDE, first=False)),
    }
    return computed(computed(renamed, cleaned), parts)


def build_boiler_permits(inputs: Frames, share: Share = as_is) -> Frames:
    """Boiler permits placed on the map, and those that could not be."""
    permits = addressed_boiler_permits(wanted_boiler_permits(inputs["boiler_permits"]))
    placed = geocode(
        permits, inputs["address_points"], inputs["intersections"], house="hnum", street="sname", area="borough"
    )
    placed = place_result(drop_outside_city(placed), empty_as_null=False)
    placed = placed.withColumn("geo_bbl", empty_to_null(sentinel_to_null("geo_bbl", NO_PARCEL)))
    accepted, rejected = split_by(share(placed, "cats_permits"), F.col("geom").isNotNull())
    return {"cats_permits": accepted, "cats_permits_rejects": rejected}


BOILER_PERMITS = JobSpec(
    "cats_permits",
    ["boiler_permits", "address_points", "intersections"],
    {"cats_permits": schemas.CATS_PERMITS, "cats_permits_rejects": schemas.CATS_PERMITS_REJECTS},
    build_boiler_permits,
    keep_empty=frozenset(["cats_permits", "cats_permits_rejects"]),
    shares=True,
)


def _corrected(permits: DataFrame, inputs: Frames, source: str) -> DataFrame:
    """City permits with borough, researched correction and address parts."""
    corrections = (
        inputs["corrections"]
        .filter(F.col("datasource") == source)
        .select(
            F.col("id").alias("permit_id"),
            F.col("location").alias("facility_location"),
            F.col("city").alias("facility_city"),
            "correction",
            "latitude",
            "longitude",
        )
    )
    cities = inputs["zip_city"].select("zipcode", F.upper("city").alias("city"))
    joined = lookup_left(
        permits.withColumn("facility_city", F.upper("facility_city")),
        inputs["zip_borough"].select("zipcode", "borough"),
        "zipcode",
    )
    joined = null_safe_left(joined, corrections, ["permit_id", "facility_location", "facility_city"])
    joined = joined.withColumns({c: blank(c) for c in ["correction", "latitude", "longitude", "facility_city"]})
    kept = known_or_blank(joined, [("facility_city", cities, "city"), ("zipcode", cities, "zipcode")])
    addressed = computed(kept, {"address": prefer("correction", cut_at_first("facility_location"))})
    return computed(
        addressed,
        {
            "housenum": before(house_number("address"), "/"),
            "streetname": street_name("address"),
            "streetname_1": street_name(crossing_part("facility_location", CROSSING_NARROW, first=True)),
            "streetname_2": street_name(crossing_part("facility_location", CROSSING_NARROW, first=False)),
        },
    )


def _located(permits: DataFrame, inputs: Frames, places: DataFrame | None) -> DataFrame:
    found = geocode(
        permits,
        inputs["address_points"],
        inputs["intersections"],
        house="housenum",
        street="streetname",
        area="zipcode",
        places=places,
    )
    return place_result(use_manual_position(drop_outside_city(found)))


def newest_permits(permits: DataFrame) -> DataFrame:
    """One permit by facility and address: newest issue, then lowest id.

    Facilities without a name or address form groups of their own (trap T11).
    """
    issued = F.coalesce(iso_date("issue_date"), us_date("issue_date"))
    keys = [empty_to_null("facility_name"), empty_to_null("address")]
    # Ids are not unique and lookups may double a row, so every other column settles what is left.
    first = ["permit_id", "facility_location", "zipcode", "borough", "expiration_date"]
    rest = [c for c in sorted(permits.columns) if c not in first]
    return latest_per_key(permits, keys, issued, [F.col(f"`{c}`") for c in [*first, *rest]])


def _accept(permits: DataFrame, name: str, share: Share) -> Frames:
    accepted, rejected = split_by(share(newest_permits(permits), name), F.col("geom").isNotNull())
    return {name: accepted, f"{name}_rejects": rejected}


_PERMIT_INPUTS = ["zip_city", "zip_borough", "corrections", "address_points", "intersections"]
# How the corrections name the two permit tables.
STATE_SOURCE = "nysdec_state_facility_permits"
TITLE_V_SOURCE = "nysdec_title_v_facility_permits"


def build_state_permits(inputs: Frames, share: Share = as_is) -> Frames:
    """State facility permits, placed and newest only."""
    permits = inputs["state_permits"].withColumnsRenamed({"facility_zip": "zipcode", "expire_date": "expiration_date"})
    permits = _corrected(permits.withColumn("permit_id", stripped("permit_id")), inputs, STATE_SOURCE)
    return _accept(_located(permits, inputs, inputs["place_names"]), "state_facility_permits", share)


STATE_PERMITS = JobSpec(
    "state_facility_permits",
    ["state_permits", *_PERMIT_INPUTS, "place_names"],
    {
        "state_facility_permits": schemas.FACILITY_PERMITS,
        "state_facility_permits_rejects": schemas.FACILITY_PERMITS_REJECTS,
    },
    build_state_permits,
    shares=True,
)


def permit_links(pages: DataFrame) -> DataFrame:
    """Permit id and address of its text, from stored listing pages (G-HTML)."""
    found = pages.select(F.explode(cell_anchor("html")).alias("a")).filter(F.col("a.text") != REVIEW_REPORT)
    return found.select(
        F.col("a.text").alias("permit_id"), F.concat(F.lit(PERMIT_URL_PREFIX), F.col("a.href")).alias("_url")
    )


def build_title_v_permits(inputs: Frames, share: Share = as_is) -> Frames:
    """Title V facility permits, with links to their text."""
    permits = inputs["title_v_permits"].withColumnsRenamed({"facility_zip": "zipcode"})
    number = stripped(F.replace(F.col("permit_id"), F.lit(")"), F.lit("")))
    permits = _corrected(permits.withColumn("permit_id", number), inputs, TITLE_V_SOURCE)
    located = _located(permits, inputs, None)
    linked = lookup_left(located, permit_links(inputs["permit_pages"]), "permit_id")
    linked = linked.withColumn("url_to_permit_text", replace_if_different("url_to_permit_text", "_url")).drop("_url")
    return _accept(linked, "title_v_facility_permits", share)


TITLE_V_PERMITS = JobSpec(
    "title_v_facility_permits",
    ["title_v_permits", *_PERMIT_INPUTS, "permit_pages"],
    {
        "title_v_facility_permits": schemas.FACILITY_PERMITS,
        "title_v_facility_permits_rejects": schemas.FACILITY_PERMITS_REJECTS,
    },
    build_title_v_permits,
    shares=True,
)
