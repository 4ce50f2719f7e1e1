"""State-plane feet to longitude and latitude.

Inverse Lambert conformal conic projection with two standard parallels, as in
the EPSG guidance notes, for EPSG:2263 (NAD83 / New York Long Island, US survey
feet).  NAD83 is taken as WGS84.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from civicflow.functions.text import col

# Fixed values of EPSG:2263 on the GRS80 ellipsoid.
SEMI_MAJOR_AXIS = 6378137.0
INVERSE_FLATTENING = 298.257222101
PARALLEL_1 = 40 + 40 / 60
PARALLEL_2 = 41 + 2 / 60
ORIGIN_LATITUDE = 40 + 10 / 60
ORIGIN_LONGITUDE = -74.0
FALSE_EASTING_FEET = 984250.0
FALSE_NORTHING_FEET = 0.0
FOOT = 1200 / 3937
LATITUDE_STEPS = 5

_F = 1 / INVERSE_FLATTENING
_E = math.sqrt(2 * _F - _F * _F)


def _m(phi: float) -> float:
    return math.cos(phi) / math.sqrt(1 - (_E * math.sin(phi)) ** 2)


def _t(phi: float) -> float:
    s = _E * math.sin(phi)
    return math.tan(math.pi / 4 - phi / 2) / ((1 - s) / (1 + s)) ** (_E / 2)


_P1, _P2, _P0 = (math.radians(d) for d in (PARALLEL_1, PARALLEL_2, ORIGIN_LATITUDE))
CONE = math.log(_m(_P1) / _m(_P2)) / math.log(_t(_P1) / _t(_P2))
SCALE = _m(_P1) / (CONE * _t(_P1) ** CONE)
RHO_ORIGIN = SEMI_MAJOR_AXIS * SCALE * _t(_P0) ** CONE


def to_lon_lat(x_feet, y_feet) -> Column:
    """(lon, lat) in degrees of a point in state-plane feet.

    The inputs are used several times over, so they should be columns, not
    costly expressions.  Each step of the latitude uses the one before it just
    once, which keeps the expression short and inside generated code:
    ((1 - s) / (1 + s)) ** (e / 2) is exp(-e * atanh(s)).
    """
    x = (col(x_feet) - FALSE_EASTING_FEET) * FOOT
    y = F.lit(RHO_ORIGIN) - (col(y_feet) - FALSE_NORTHING_FEET) * FOOT
    t = F.pow(F.hypot(x, y) / (SEMI_MAJOR_AXIS * SCALE), F.lit(1 / CONE))
    lat = F.lit(math.pi / 2) - 2 * F.atan(t)
    for _ in range(LATITUDE_STEPS):
        lat = F.lit(math.pi / 2) - 2 * F.atan(t * F.exp(F.atanh(F.sin(lat) * _E) * -_E))
    lon = F.degrees(F.atan2(x, y) / CONE) + ORIGIN_LONGITUDE
    return F.struct(lon.alias("lon"), F.degrees(lat).alias("lat"))
