"""Garages and air monitoring stations."""

from __future__ import annotations

from pyspark.sql import functions as F

from civicflow.functions.codes import label
from civicflow.functions.geometry import point_wkt
from civicflow.functions.numbers import to_number
from civicflow.plans import schemas
from civicflow.plans.fixed_values import BOROCODE_BY_COUNTY
from civicflow.plans.job import Frames, JobSpec

# The kept domains, and the published names of source columns.
TRANSPORT_DOMAIN = "Core Infrastructure and Transportation"
GOVERNMENT_DOMAIN = "Administration of Government"
GARAGE_SUBGROUP = "Maintenance and Garages"
RENAMED = {
    "addressnum": "geo_housenum",
    "streetname": "geo_streetname",
    "address": "geo_address",
    "boro": "borough",
    "bin": "geo_bin",
    "bbl": "geo_bbl",
    "commboard": "geo_commboard",
    "nta": "geo_nta",
    "council": "geo_council",
    "schooldist": "geo_schooldist",
    "policeprct": "geo_policeprct",
    "censtract": "geo_censtract",
    "latitude": "geo_latitude",
    "longitude": "geo_longitude",
    "xcoord": "geo_xcoord",
    "ycoord": "geo_ycoord",
}


def build_garages(inputs: Frames) -> Frames:
    """Transport facilities and public garages, placed by their position."""
    domain = F.col("facdomain")
    kept = inputs["facilities"].filter(
        (domain == TRANSPORT_DOMAIN) | ((domain == GOVERNMENT_DOMAIN) & (F.col("facsubgrp") == GARAGE_SUBGROUP))
    )
    out = kept.withColumnsRenamed(RENAMED).withColumns(
        {
            "geo_longitude": to_number("geo_longitude"),
            "geo_latitude": to_number("geo_latitude"),
            "geom": point_wkt("geo_longitude", "geo_latitude"),
        }
    )
    return {"facilities_garages": out}


GARAGES = JobSpec(
    "facilities_garages", ["facilities"], {"facilities_garages": schemas.FACILITIES_GARAGES}, build_garages
)

# Fixed value: the state's region that is the city.
CITY_REGION = "2"


def build_air_stations(inputs: Frames) -> Frames:
    """Stations of the city's region with their borough code."""
    stations = inputs["air_stations"].filter(F.col("region") == CITY_REGION)
    return {"air_monitoring_stations": stations.withColumn("borocode", label("county", BOROCODE_BY_COUNTY))}


AIR_STATIONS = JobSpec(
    "air_monitoring_stations",
    ["air_stations"],
    {"air_monitoring_stations": schemas.AIR_MONITORING_STATIONS},
    build_air_stations,
)
