"""Checks of whole jobs on inputs shaped from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from civicflow.checks.binary import Encoder, double_hex
from civicflow.checks.geocoding import rounded_point
from civicflow.checks.registry import check, shaped
from civicflow.operators.relate import computed
from civicflow.plans import JOBS, schemas
from civicflow.plans.commuting import travel_variables
from civicflow.plans.enrolment import unmatched_districts
from civicflow.plans.fixed_values import (
    AUTO,
    CARPOOL,
    CITY_COUNTIES,
    PUBLIC,
    TRAVEL_LABELS,
    TRAVEL_VARIABLES,
    WORKPLACE_COUNTIES,
)
from civicflow.plans.schools import unmatched_blue_book
from civicflow.plans.utilization import meeting_urls
from civicflow.sources.publish import GEOMETRY, parse_ddl


def _list(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


def _case(c: str, mapping: dict, default: str = "NULL") -> str:
    whens = " ".join(f"WHEN '{k}' THEN {v if isinstance(v, int) else chr(39) + v + chr(39)}" for k, v in mapping.items())
    return f"CASE {c} {whens} ELSE {default} END"


_SQL_TYPES = {"text": "VARCHAR", "integer": "INTEGER", "bigint": "BIGINT", "double precision": "DOUBLE", "date": "DATE"}
_SQL_TYPES |= {"boolean": "BOOLEAN"}


def _rest(ddl: str, *shown: str) -> str:
    """The declared columns that a check's input leaves NULL, for its oracle."""
    left = {c: kind for c, kind in parse_ddl(ddl).items() if c not in shown}
    return "".join(f', CAST(NULL AS {_SQL_TYPES.get(kind, "VARCHAR")}) AS "{c}"' for c, kind in left.items())


# --- R19, R20: enrolment -----------------------------------------------------

PROJECTIONS = """
SELECT o_orderkey AS ogc_fid, CASE WHEN o_custkey % 41 = 0 THEN NULL ELSE CAST(o_custkey % 35 AS STRING) END AS district,
       CASE o_orderkey % 15 WHEN 0 THEN 'PK' WHEN 1 THEN 'K' WHEN 14 THEN 'GED' ELSE CAST(o_orderkey % 15 - 1 AS STRING) END AS projected,
       '1,' || lpad(CAST(o_orderkey % 1000 AS STRING), 3, '0') AS y2019,
       CAST(o_custkey % 500 AS STRING) AS y2020, CAST(month(o_orderdate) AS STRING) AS y2021
FROM {orders}
"""
YEARS = {"y2019": "2019-20", "y2020": "2020-21", "y2021": "2021-22"}
_PUPILS = """
p AS (SELECT TRY_CAST(district AS INTEGER) AS d, district, projected, unnest([2019, 2020, 2021]) AS year,
             unnest([CAST(replace(y2019, ',', '') AS BIGINT), CAST(y2020 AS BIGINT), CAST(y2021 AS BIGINT)]) AS n FROM src)
"""


@check(
    "recipe_enrolment",
    f"""
WITH src AS ({PROJECTIONS}), {_PUPILS},
     b AS (SELECT *, CASE WHEN d BETWEEN 1 AND 6 THEN 'Manhattan' WHEN d BETWEEN 7 AND 12 THEN 'Bronx'
             WHEN d BETWEEN 13 AND 23 OR d = 32 THEN 'Brooklyn' WHEN d BETWEEN 24 AND 30 THEN 'Queens'
             WHEN d = 31 THEN 'Staten Island' END AS borough FROM p WHERE projected IN ('9', '10', '11', '12'))
SELECT CAST(year AS INTEGER) AS year, borough, CAST(sum(n) AS INTEGER) AS hs FROM b WHERE borough IS NOT NULL GROUP BY 1, 2
""",
)
def recipe_enrolment(spark: SparkSession, sf_dir: str) -> DataFrame:
    projections = shaped(spark, sf_dir, PROJECTIONS).withColumnsRenamed(YEARS)
    return JOBS["projections_by_boro"].run({"projections": projections})["projections_by_boro"]


SPLIT_PCT = """
SELECT CASE WHEN p_partkey % 37 = 0 THEN NULL ELSE CAST(p_partkey % 40 AS STRING) END AS district,
       CAST(p_size AS STRING) AS subdistrict,
       CASE p_partkey % 3 WHEN 0 THEN 'PS' WHEN 1 THEN 'MS' ELSE NULL END AS level,
       '0.' || lpad(CAST(p_partkey % 100 AS STRING), 2, '0') AS multiplier
FROM {part}
"""


@check(
    "recipe_enrolment_subdistrict",
    f"""
WITH src AS ({PROJECTIONS}), {_PUPILS},
     l AS (SELECT district, year, CAST(sum(n) FILTER (projected IN ('PK','K','1','2','3','4','5')) AS DOUBLE) AS ps,
                  CAST(sum(n) FILTER (projected IN ('6','7','8')) AS DOUBLE) AS ms FROM p
           WHERE projected IN ('PK','K','1','2','3','4','5','6','7','8') AND district IS NOT NULL GROUP BY 1, 2),
     s AS (SELECT district, subdistrict, coalesce(sum(CAST(multiplier AS DOUBLE)) FILTER (level = 'PS'), 0) AS a,
                  coalesce(sum(CAST(multiplier AS DOUBLE)) FILTER (level = 'MS'), 0) AS b
           FROM ({SPLIT_PCT}) WHERE district IS NOT NULL AND level IS NOT NULL GROUP BY 1, 2)
SELECT CAST(year AS INTEGER) AS school_year, CAST(district AS INTEGER) AS district, CAST(subdistrict AS INTEGER) AS subdistrict,
       CAST(ceil(ps * a) AS INTEGER) AS ps, CAST(ceil(ms * b) AS INTEGER) AS "is"
FROM s JOIN l USING (district) WHERE ps IS NOT NULL AND ms IS NOT NULL
""",
)
def recipe_enrolment_subdistrict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return JOBS["projections_by_sd"].run(_projection_inputs(spark, sf_dir))["projections_by_sd"]


def _projection_inputs(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {
        "projections": shaped(spark, sf_dir, PROJECTIONS).withColumnsRenamed(YEARS),
        "split_pct": shaped(spark, sf_dir, SPLIT_PCT),
    }


@check(
    "unmatched_districts",
    f"""
WITH p AS (SELECT district FROM ({PROJECTIONS}) WHERE district IS NOT NULL GROUP BY 1
           HAVING bool_or(projected IN ('PK','K','1','2','3','4','5')) AND bool_or(projected IN ('6','7','8'))),
     s AS (SELECT DISTINCT district FROM ({SPLIT_PCT}) WHERE district IS NOT NULL AND level IS NOT NULL)
SELECT district, 'projections' AS missing FROM s WHERE district NOT IN (SELECT district FROM p)
UNION ALL SELECT district, 'split_pct' FROM p WHERE district NOT IN (SELECT district FROM s)
""",
)
def unmatched_districts_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unmatched_districts(_projection_inputs(spark, sf_dir))


# --- R1, R15, R16: roads -----------------------------------------------------

STREET_LINES = """
SELECT 'ST ' || CAST(o_custkey % 97 AS STRING) AS street, CAST(o_orderkey AS STRING) AS segmentid,
       CAST(o_custkey % 60 AS STRING) AS streetwidth_min, '' AS streetwidth_max,
       '1' || lpad(CAST(o_custkey % 10000 AS STRING), 4, '0') AS lzip, '10001' AS rzip,
       CAST(1 + o_custkey % 5 AS STRING) || lpad(CAST(o_custkey % 90000 AS STRING), 5, '0') AS streetcode,
       CASE o_orderkey % 6 WHEN 0 THEN 'M' WHEN 1 THEN '*' WHEN 2 THEN '$' WHEN 3 THEN NULL WHEN 4 THEN 'T' ELSE 'B' END AS nodelevelf,
       CASE o_custkey % 7 WHEN 0 THEN 'M' WHEN 1 THEN '*' WHEN 2 THEN NULL WHEN 3 THEN '$' ELSE 'C' END AS nodelevelt,
       CASE WHEN o_orderkey % 8 = 0 THEN '1' ELSE '0' END AS featuretyp,
       CASE o_orderkey % 9 WHEN 0 THEN 'P' WHEN 1 THEN NULL ELSE 'W' END AS trafdir,
       CASE o_custkey % 5 WHEN 0 THEN '  ' WHEN 1 THEN ' 1' WHEN 2 THEN NULL ELSE ' ' || CAST(o_custkey % 5 AS STRING) END AS number_total_lanes,
       CASE o_custkey % 6 WHEN 0 THEN ' 1' WHEN 1 THEN NULL WHEN 2 THEN '10' WHEN 3 THEN ' 4 ' ELSE '  ' END AS bikelane,
       'LINESTRING (0 0, 1 1)' AS geom
FROM {orders}
"""


@check(
    "recipe_atypical_roadways",
    f"""
SELECT street AS streetname, segmentid, streetwidth_min, nullif(streetwidth_max, '') AS streetwidth_max, rzip AS right_zipcode,
       lzip AS left_zipcode, CAST(left(streetcode, 1) AS INTEGER) AS borocode, nodelevelf, nodelevelt, featuretyp, trafdir,
       CAST(CAST(nullif(trim(number_total_lanes, ' '), '') AS DOUBLE) AS VARCHAR) AS number_total_lanes,
       nullif(trim(bikelane, ' '), '') AS bikelane, 'SRID=4326;' || geom AS geom
FROM ({STREET_LINES})
WHERE ((nodelevelf <> 'M' AND nodelevelf <> '*' AND nodelevelf <> '$') OR (nodelevelt <> 'M' AND nodelevelt <> '*' AND nodelevelt <> '$'))
  AND trafdir <> 'P' AND featuretyp <> '1'
  AND (CAST(nullif(number_total_lanes, '  ') AS INTEGER) <> 1 OR nullif(number_total_lanes, '  ') IS NULL)
  AND trim(bikelane, ' ') <> '1' AND trim(bikelane, ' ') <> '2' AND trim(bikelane, ' ') <> '4' AND trim(bikelane, ' ') <> '9'
""",
)
def recipe_atypical_roadways(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = {"street_lines": shaped(spark, sf_dir, STREET_LINES)}
    return JOBS["atypical_roadways"].run(lines)["atypical_roadways"]


# Vertical and horizontal lines, some in two parts, against boxes of 0.1 degree.
ROAD_LINES = """
SELECT o_orderkey AS ogc_fid, CAST(o_custkey AS STRING) AS objectid, 'Muni ' || CAST(o_custkey % 60 AS STRING) AS municipality_desc,
       x, y, CASE WHEN o_orderkey % 13 = 0 THEN NULL WHEN o_orderkey % 2 = 0 THEN
         'MULTILINESTRING ((' || CAST(x AS STRING) || ' ' || CAST(y AS STRING) || ', ' || CAST(x + 0.0625 AS STRING) || ' ' || CAST(y AS STRING)
           || '), (5 5, 5.0625 5))'
       ELSE 'LINESTRING (' || CAST(x AS STRING) || ' ' || CAST(y AS STRING) || ',' || CAST(x AS STRING) || ' ' || CAST(y + 0.0625 AS STRING) || ')'
       END AS geom
FROM (SELECT o_orderkey, o_custkey, CAST(o_orderkey % 96 AS DOUBLE) / 32 - 75 AS x, CAST(o_custkey % 96 AS DOUBLE) / 32 + 40 AS y FROM {orders})
"""
BOUNDARIES = """
SELECT bx, b0, 'MULTIPOLYGON (((' || CAST(bx AS STRING) || ' ' || CAST(b0 AS STRING) || ', ' || CAST(bx + 0.25 AS STRING) || ' ' || CAST(b0 AS STRING)
  || ', ' || CAST(bx + 0.25 AS STRING) || ' ' || CAST(b0 + 0.25 AS STRING) || ', ' || CAST(bx AS STRING) || ' ' || CAST(b0 + 0.25 AS STRING)
  || ', ' || CAST(bx AS STRING) || ' ' || CAST(b0 AS STRING) || ')))' AS geom
FROM (SELECT CAST(n_nationkey % 5 AS DOUBLE) / 2 - 74.75 AS bx, CAST(floor(n_nationkey / 5) AS DOUBLE) / 2 + 40.125 AS b0 FROM {nation})
"""


@check(
    "recipe_functional_class",
    f"""
WITH l AS ({ROAD_LINES}), b AS ({BOUNDARIES})
SELECT CAST(objectid AS INTEGER) AS objectid, municipality_desc AS borough, 'SRID=4326;' || geom AS geom
  {_rest(schemas.FUNCTIONAL_CLASS, "objectid", "borough", "geom")} FROM l
WHERE geom IS NOT NULL AND EXISTS (SELECT 1 FROM b WHERE
  x <= bx + 0.25 AND x + CASE WHEN ogc_fid % 2 = 0 THEN 0.0625 ELSE 0 END >= bx
  AND y <= b0 + 0.25 AND y + CASE WHEN ogc_fid % 2 = 0 THEN 0 ELSE 0.0625 END >= b0)
""",
)
def recipe_functional_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    job = JOBS["functional_class"]
    lines = _with_declared(shaped(spark, sf_dir, ROAD_LINES), job.outputs["functional_class"])
    inputs = {"road_lines": lines.drop("borough"), "boundaries": shaped(spark, sf_dir, BOUNDARIES)}
    return job.run(inputs)["functional_class"]


_PLAIN = {c: f"regexp_replace(CAST({c} AS VARCHAR), '\\.0$', '')" for c in ("x", "y", "x + 0.0625", "y + 0.0625")}


@check(
    "recipe_functional_class_binary",
    f"""
WITH l AS ({ROAD_LINES}), b AS ({BOUNDARIES})
SELECT CAST(objectid AS INTEGER) AS objectid, municipality_desc AS borough, 'SRID=4326;' ||
  CASE WHEN ogc_fid % 2 = 0 THEN 'MULTILINESTRING ((' || {_PLAIN["x"]} || ' ' || {_PLAIN["y"]} || ', ' || {_PLAIN["x + 0.0625"]} || ' '
    || {_PLAIN["y"]} || '), (5 5, 5.0625 5))'
  ELSE 'LINESTRING (' || {_PLAIN["x"]} || ' ' || {_PLAIN["y"]} || ', ' || {_PLAIN["x"]} || ' ' || {_PLAIN["y + 0.0625"]} || ')' END AS geom
  {_rest(schemas.FUNCTIONAL_CLASS, "objectid", "borough", "geom")} FROM l
WHERE geom IS NOT NULL AND EXISTS (SELECT 1 FROM b WHERE
  x <= bx + 0.25 AND x + CASE WHEN ogc_fid % 2 = 0 THEN 0.0625 ELSE 0 END >= bx
  AND y <= b0 + 0.25 AND y + CASE WHEN ogc_fid % 2 = 0 THEN 0 ELSE 0.0625 END >= b0)
""",
)
def recipe_functional_class_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same job on tables that hold binary geometry: lines as bytes, areas as hex text."""
    job = JOBS["functional_class"]
    c = F.col
    little = c("ogc_fid") % 3 == 0
    ends = {"x0": c("x"), "y0": c("y"), "x1": c("x") + 0.0625, "y1": c("y") + 0.0625, "a": F.lit(5.0), "b": F.lit(5.0625)}
    lines = _with_declared(shaped(spark, sf_dir, ROAD_LINES), job.outputs["functional_class"])
    lines = computed(lines, {f"_{name}": double_hex(value, little) for name, value in ends.items()})
    x0, y0, x1, y1, a, b = (c(f"_{name}") for name in ends)
    e = Encoder(little, F.lit(False), F.lit(True))
    two = e.many(5, [e.line([(x0, y0), (x1, y0)]), e.line([(a, a), (b, a)])])
    drawn = F.when(c("ogc_fid") % 2 == 0, two).otherwise(e.line([(x0, y0), (x0, y1)], True))
    lines = computed(lines, {"wkb_geometry": F.unhex(F.when(c("geom").isNotNull(), drawn))}).drop("borough", "geom")
    areas = shaped(spark, sf_dir, BOUNDARIES).drop("geom")
    sides = {"_x0": c("bx"), "_x1": c("bx") + 0.25, "_y0": c("b0"), "_y1": c("b0") + 0.25}
    areas = computed(areas, {name: double_hex(value, F.lit(True)) for name, value in sides.items()})
    x0, x1, y0, y1 = (c(name) for name in sides)
    box = [(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)]
    e = Encoder(F.lit(True), F.lit(False))
    areas = computed(areas, {"wkb_geometry": e.many(6, [e.polygon([box])])})
    return job.run({"road_lines": lines, "boundaries": areas})["functional_class"]


def _with_declared(df: DataFrame, ddl: str) -> DataFrame:
    """Give the frame the declared columns it does not have, as NULL text."""
    missing = [c for c in parse_ddl(ddl) if c.lower() not in {h.lower() for h in df.columns}]
    return df.select("*", *[F.lit(None).cast("string").alias(c) for c in missing])


TRAFFIC = """
SELECT CASE o_custkey % 7 WHEN 0 THEN '005' WHEN 1 THEN '047' WHEN 2 THEN '061' WHEN 3 THEN '081' WHEN 4 THEN '085'
       WHEN 5 THEN '001' ELSE NULL END AS cou, ' ' || CAST(o_custkey AS STRING) || chr(9) || ' ' AS rc_station,
       CAST(o_orderkey AS STRING) AS count_stats_id, o_orderpriority AS aadt
FROM {orders}
"""
STATIONS = """
SELECT CASE WHEN c_nationkey < 20 THEN CAST(c_custkey AS STRING) ELSE 'none ' || CAST(c_custkey AS STRING) END AS rc_id,
  'MULTILINESTRING ((0 0, 1 1))' AS geom FROM {customer}
UNION ALL SELECT CAST(s_suppkey AS STRING), 'MULTILINESTRING ((0 0, 2 2))' FROM {supplier}
"""


@check(
    "recipe_traffic_counts",
    f"""
SELECT trim(rc_station, ' ' || chr(9)) AS rc_station, count_stats_id, cou, aadt,
       CAST(CASE cou WHEN '061' THEN 1 WHEN '005' THEN 2 WHEN '047' THEN 3 WHEN '081' THEN 4 WHEN '085' THEN 5 END AS INTEGER) AS borocode,
       'SRID=4326;' || geom AS geom
       {_rest(schemas.TRAFFIC_COUNTS, "rc_station", "count_stats_id", "cou", "aadt", "borocode", "geom")}
FROM ({TRAFFIC}) LEFT JOIN ({STATIONS}) ON trim(rc_station, ' ' || chr(9)) = rc_id
WHERE cou IN ('005', '047', '061', '081', '085')
""",
)
def recipe_traffic_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    job = JOBS["traffic_counts"]
    counts = _with_declared(shaped(spark, sf_dir, TRAFFIC), job.outputs["traffic_counts"])
    inputs = {"traffic_counts": counts.drop("geom"), "traffic_lines": shaped(spark, sf_dir, STATIONS)}
    return job.run(inputs)["traffic_counts"]


# --- R3, R4, R5: commuting ---------------------------------------------------

TRACT = """
SELECT '{mark}' || CAST({key} AS STRING) AS GEOID, x, y, w,
  'MULTIPOLYGON (((' || CAST(x AS STRING) || ' ' || CAST(y AS STRING) || ', ' || CAST(x + w AS STRING) || ' ' || CAST(y AS STRING) || ', '
  || CAST(x AS STRING) || ' ' || CAST(y + 3 AS STRING) || ', ' || CAST(x AS STRING) || ' ' || CAST(y AS STRING) || ')))' AS geom
FROM (SELECT {key}, CAST({key} % 90 AS INT) AS x, CAST({key} % 80 AS INT) AS y, CAST(1 + {key} % 9 AS INT) AS w FROM {table})
"""


def _tract(table: str, key: str, mark: str) -> str:
    return TRACT.replace("{key}", key).replace("{table}", f"{{{table}}}").replace("{mark}", mark)


TRACTS = {
    "tracts_a": _tract("customer", "c_custkey", "C"),
    "tracts_b": _tract("supplier", "s_suppkey", "S"),
    "tracts_c": _tract("part", "p_partkey", "P"),
}
FLOWS = """
SELECT CASE WHEN o_custkey % 5 = 0 THEN 'S' ELSE 'C' END || CAST(o_custkey AS STRING) AS residential_geoid,
       CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE 'P' || CAST(o_orderkey AS STRING) END AS work_geoid FROM {orders}
"""


@check(
    "recipe_centroids",
    f"""
WITH t AS ({" UNION ALL ".join(TRACTS.values())}), f AS ({FLOWS}),
     g AS (SELECT residential_geoid AS geoid FROM f UNION SELECT work_geoid FROM f)
SELECT geoid, round(CAST(x + w / 3.0 AS DOUBLE), 6) AS lon, round(CAST(y + 1 AS DOUBLE), 6) AS lat FROM g JOIN t USING (geoid)
""",
)
def recipe_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    inputs = {name: shaped(spark, sf_dir, sql) for name, sql in TRACTS.items()}
    inputs["journey_to_work"] = shaped(spark, sf_dir, FLOWS)
    return rounded_point(JOBS["censustract_centroids"].run(inputs)["censustract_centroids"])


MODE_SPLIT = """
SELECT 'C3100US' || CASE floor(o_orderkey / 19) % 6 WHEN 0 THEN '36061' WHEN 1 THEN '36047' WHEN 2 THEN '36005'
         WHEN 3 THEN '36081' WHEN 4 THEN '36085' ELSE '36119' END || lpad(CAST(CAST(floor(o_orderkey / 19) AS INT) % 1000000 AS STRING), 6, '0') AS geoid,
       CASE WHEN o_custkey % 17 = 0 THEN '99' ELSE CAST(o_orderkey % 19 + 1 AS STRING) END AS lineno,
       CASE WHEN o_custkey % 4 = 0 THEN '1,' || lpad(CAST(o_custkey % 1000 AS STRING), 3, '0') ELSE CAST(o_custkey % 700 AS STRING) END AS est,
       CASE o_custkey % 6 WHEN 0 THEN ' ' WHEN 1 THEN '.5' WHEN 2 THEN NULL ELSE '+/-' || CAST(o_custkey % 300 AS STRING) END AS moe
FROM {orders}
"""


def _variables_oracle(auto: str, public: str) -> str:
    groups = [(v, v) for v in TRAVEL_VARIABLES.values()]
    groups += [(m, "trans_auto_carpool_total") for m in CARPOOL] + [(m, "trans_auto_total") for m in AUTO]
    groups += [(m, "trans_public_total") for m in PUBLIC]
    rows = ", ".join(f"('{m}', '{v}')" for m, v in groups)
    return f"""
WITH r AS (SELECT geoid[-11:] AS geoid, {_case("lineno", TRAVEL_VARIABLES)} AS mode,
                  CAST(replace(est, ',', '') AS INTEGER) AS value,
                  TRY_CAST(replace(moe, '+/-', '') AS DOUBLE) AS moe FROM ({MODE_SPLIT})
           WHERE geoid[8:12] IN ({_list(CITY_COUNTIES)})),
     g(mode, variable) AS (VALUES {rows}),
     k AS (SELECT DISTINCT geoid, variable FROM (SELECT DISTINCT geoid FROM r) CROSS JOIN g),
     s AS (SELECT geoid, variable, sum(value) AS value, sqrt(sum(moe * moe)) AS moe FROM r JOIN g USING (mode) GROUP BY 1, 2),
     c AS (SELECT geoid, moe AS carpool FROM s WHERE variable = 'trans_auto_carpool_total')
SELECT geoid, variable, CAST(coalesce(value, 0) AS INTEGER) AS value,
       CAST(trunc(coalesce(CASE variable WHEN 'trans_auto_total' THEN {auto} WHEN 'trans_public_total' THEN {public} ELSE moe END, 0)) AS INTEGER) AS moe
FROM k LEFT JOIN s USING (geoid, variable) LEFT JOIN c USING (geoid)
"""


@check("recipe_travel_variables", _variables_oracle("moe", "moe"))
def recipe_travel_variables(spark: SparkSession, sf_dir: str) -> DataFrame:
    inputs = {"mode_split": shaped(spark, sf_dir, MODE_SPLIT)}
    return JOBS["censustract_variables"].run(inputs)["censustract_variables"]


@check("recipe_travel_variables_as_published", _variables_oracle("sqrt(carpool)", "sqrt(carpool)"))
def recipe_travel_variables_as_published(spark: SparkSession, sf_dir: str) -> DataFrame:
    return travel_variables(shaped(spark, sf_dir, MODE_SPLIT), compat=True)


COMMUTE_FLOWS = """
SELECT CAST(l_orderkey AS STRING) AS res_tract, CAST(l_partkey AS STRING) AS work_tract, CAST(l_linenumber * 3 AS STRING) AS mode,
       CAST(CAST(l_quantity AS INT) AS STRING) AS total, CAST(l_discount AS STRING) AS standard_error,
       CASE WHEN l_suppkey % 4 = 0 THEN '36061' WHEN l_suppkey % 4 = 1 THEN '34003' WHEN l_suppkey % 4 = 2 THEN '36001' ELSE NULL END AS workplace_state_county
FROM {lineitem}
"""


@check(
    "recipe_journey_to_work",
    f"""
SELECT res_tract AS residential_geoid, work_tract AS work_geoid, nullif({_case("mode", TRAVEL_LABELS, "''")}, '') AS "MODE",
       CAST(total AS INTEGER) AS count, CAST(standard_error AS DOUBLE) AS standard_error
FROM ({COMMUTE_FLOWS}) WHERE workplace_state_county IN ({_list(WORKPLACE_COUNTIES)})
""",
)
def recipe_journey_to_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    flows = shaped(spark, sf_dir, COMMUTE_FLOWS).withColumnRenamed("total", "totwork_16+")
    return JOBS["journey_to_work"].run({"commute_flows": flows})["journey_to_work"]


# --- R6, R9, R14, R21: pass-through ------------------------------------------

CAMERAS = """
SELECT o_orderkey AS ogc_fid, '' AS content, o_orderpriority AS icon, CAST(o_orderkey AS STRING) AS id,
       CAST(CAST(o_custkey AS DOUBLE) / 4 AS STRING) AS latitude, '' AS longitude, o_orderstatus AS title,
       'http://c/' || CAST(o_custkey AS STRING) AS url, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE 'POINT (1 2)' END AS geom
FROM {orders}
"""


@check(
    "recipe_passthrough",
    f"""
SELECT nullif(content, '') AS content, icon, id, CAST(latitude AS DOUBLE) AS latitude, CAST(NULL AS DOUBLE) AS longitude,
       title, url, 'SRID=4326;' || geom AS geom FROM ({CAMERAS})
""",
)
def recipe_passthrough(spark: SparkSession, sf_dir: str) -> DataFrame:
    return JOBS["traffic_cameras"].run({"traffic_cameras": shaped(spark, sf_dir, CAMERAS)})["traffic_cameras"]


def _any_rows(ddl: str) -> tuple[str, str, dict[str, str]]:
    """(input SQL, oracle SELECT list, names) that fill every declared column of a table from the orders."""
    made, shown, names = [], [], {}
    for i, (name, kind) in enumerate(parse_ddl(ddl).items()):
        c = f"c{i}"
        names[c] = name
        if kind == GEOMETRY:
            made.append(f"CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE 'POINT (' || CAST(o_custkey AS STRING) || ' 2)' END AS {c}")
            shown.append(f"""'SRID=4326;' || {c} AS "{name}\"""")
        elif kind == "text":
            made.append(f"CASE WHEN o_orderkey % 7 = {i % 7} THEN '' ELSE '{c} ' || CAST(o_custkey AS STRING) END AS {c}")
            shown.append(f"""nullif({c}, '') AS "{name}\"""")
        else:
            number = f"CAST(o_custkey + {i} AS DOUBLE) / 4" if kind == "double precision" else f"o_custkey + {i}"
            made.append(f"CASE WHEN o_orderkey % 5 = {i % 5} THEN ' ' ELSE CAST({number} AS STRING) END AS {c}")
            shown.append(f"""TRY_CAST({c} AS {_SQL_TYPES[kind]}) AS "{name}\"""")
    return f"SELECT {', '.join(made)}, 'x' AS undeclared FROM {{orders}}", ", ".join(shown), names


def _pass_on(check_name: str, job: str) -> None:
    """Register the check of a job that publishes a table's declared columns as they are."""
    made, shown, names = _any_rows(next(iter(JOBS[job].outputs.values())))

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return JOBS[job].run({job: shaped(spark, sf_dir, made).withColumnsRenamed(names)})[job]

    check(check_name, f"SELECT {shown} FROM ({made})")(query)


_pass_on("recipe_areas_of_concern", "areas_of_concern")
_pass_on("recipe_aadt", "aadt")
_pass_on("recipe_ventilation_towers", "tunnel_ventilation_towers")


# --- R10, R11: facilities ----------------------------------------------------

FACILITIES = """
SELECT c_name AS facname, CASE c_custkey % 4 WHEN 0 THEN 'Core Infrastructure and Transportation' WHEN 1 THEN 'Parks'
         WHEN 2 THEN NULL ELSE 'Administration of Government' END AS facdomain,
       CASE c_custkey % 3 WHEN 0 THEN 'Maintenance and Garages' WHEN 1 THEN 'Offices' ELSE NULL END AS facsubgrp,
       CAST(c_custkey AS STRING) AS addressnum, 'MAIN ST' AS streetname, CAST(c_custkey AS STRING) || ' MAIN ST' AS address,
       'Bronx' AS boro, '2000000' AS bin, CAST(2000000000 + c_custkey AS STRING) AS bbl,
       CASE WHEN c_custkey % 5 = 0 THEN 'unknown' ELSE CAST(CAST(c_custkey % 64 AS DOUBLE) / 64 + 40 AS STRING) END AS latitude,
       CAST(CAST(c_custkey % 32 AS DOUBLE) / 32 - 74 AS STRING) AS longitude, '1000000' AS xcoord, '' AS ycoord,
       '10' AS commboard, 'N1' AS nta, '7' AS council, '2' AS schooldist, '40' AS policeprct, '1' AS censtract
FROM {customer}
"""


_GARAGE_COLUMNS = """facname facdomain facsubgrp geo_housenum geo_address borough geo_bbl geo_latitude geo_longitude geo_xcoord
geo_ycoord geom geo_streetname geo_bin geo_commboard geo_nta geo_council geo_schooldist geo_policeprct geo_censtract"""


@check(
    "recipe_garages",
    f"""
SELECT facname, facdomain, facsubgrp, addressnum AS geo_housenum, address AS geo_address, boro AS borough,
       CAST(bbl AS BIGINT) AS geo_bbl, TRY_CAST(latitude AS DOUBLE) AS geo_latitude, CAST(longitude AS DOUBLE) AS geo_longitude,
       CAST(xcoord AS DOUBLE) AS geo_xcoord, CAST(NULL AS DOUBLE) AS geo_ycoord,
       'SRID=4326;POINT (' || regexp_replace(longitude, '\\.0$', '') || ' '
         || regexp_replace(CAST(TRY_CAST(latitude AS DOUBLE) AS VARCHAR), '\\.0$', '') || ')' AS geom,
       streetname AS geo_streetname, bin AS geo_bin, commboard AS geo_commboard, nta AS geo_nta, council AS geo_council,
       schooldist AS geo_schooldist, policeprct AS geo_policeprct, censtract AS geo_censtract
       {_rest(schemas.FACILITIES_GARAGES, *_GARAGE_COLUMNS.split())}
FROM ({FACILITIES})
WHERE facdomain = 'Core Infrastructure and Transportation'
   OR (facdomain = 'Administration of Government' AND facsubgrp = 'Maintenance and Garages')
""",
)
def recipe_garages(spark: SparkSession, sf_dir: str) -> DataFrame:
    job = JOBS["facilities_garages"]
    facilities = shaped(spark, sf_dir, FACILITIES)
    rest = "city zipcode borocode factype facgroup servarea opname opabbrev optype overagency overabbrev overlevel capacity"
    rest += " captype proptype datasource uid"
    facilities = facilities.select("*", *[F.lit(None).cast("string").alias(c) for c in rest.split()])
    return job.run({"facilities": facilities})["facilities_garages"]


AIR_STATIONS = """
SELECT CAST(s_suppkey AS STRING) AS site_id, CASE WHEN s_suppkey % 2 = 0 THEN '2' WHEN s_suppkey % 3 = 0 THEN NULL ELSE '3' END AS region,
       CASE s_nationkey % 6 WHEN 0 THEN 'New York' WHEN 1 THEN 'Bronx' WHEN 2 THEN 'Kings' WHEN 3 THEN 'Queens'
         WHEN 4 THEN 'Richmond' ELSE 'Nassau' END AS county, CAST(s_acctbal AS STRING) AS latitude, 'X' AS pm25, 'POINT (1 2)' AS geom
FROM {supplier}
UNION ALL
SELECT 'c' || CAST(c_custkey AS STRING), '2', 'Kings', CAST(c_acctbal AS STRING), '', NULL FROM {customer}
"""


@check(
    "recipe_air_stations",
    f"""
SELECT site_id, county, CAST({_case("county", {"New York": 1, "Bronx": 2, "Kings": 3, "Queens": 4, "Richmond": 5})} AS INTEGER) AS borocode,
       CAST(latitude AS DOUBLE) AS latitude, nullif(pm25, '') AS "pm_2.5", 'SRID=4326;' || geom AS geom
       {_rest(schemas.AIR_MONITORING_STATIONS, "site_id", "county", "borocode", "latitude", "pm_2.5", "geom")}
FROM ({AIR_STATIONS}) WHERE region = '2'
""",
)
def recipe_air_stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    job = JOBS["air_monitoring_stations"]
    stations = shaped(spark, sf_dir, AIR_STATIONS).withColumnRenamed("pm25", "pm_2.5")
    stations = _with_declared(stations, job.outputs["air_monitoring_stations"])
    return job.run({"air_stations": stations.drop("borocode")})["air_monitoring_stations"]


# --- R2: school buildings ----------------------------------------------------

# Ids of schools that the school rules name.
SPECIAL_IDS = """CASE {0} WHEN 1 THEN 'X445' WHEN 2 THEN 'M539' WHEN 3 THEN 'X695' WHEN 4 THEN 'M973'
  ELSE 'S' || CAST({0} AS STRING) END"""


def _school(c: str) -> str:
    return SPECIAL_IDS.replace("{0}", c)


SCHOOL_LIST = f"""
SELECT {_school("c_custkey")} AS location_code,
       CASE WHEN c_custkey % 53 = 0 THEN NULL ELSE 'B' || CAST(c_custkey % 7 AS STRING) END AS building_code,
       'School ' || CAST(c_custkey AS STRING) AS location_name,
       CASE c_custkey % 9 WHEN 0 THEN 'Mini B' WHEN 1 THEN 'TRANSPORTABLE' WHEN 2 THEN 'GYM' WHEN 3 THEN NULL ELSE 'MAIN' END AS building_name,
       'addr' AS address_line_1, CAST(1 + c_custkey % 5 AS STRING) || '00' || CAST(c_custkey % 3 AS STRING) AS borough_block_lot,
       CASE WHEN c_custkey % 6 = 0 THEN 'NULL' ELSE CAST(CAST(c_custkey % 32 AS DOUBLE) / 32 - 74 AS STRING) END AS longitude,
       CASE WHEN c_custkey % 6 = 0 THEN 'NULL' WHEN c_custkey % 19 = 0 THEN NULL ELSE '40.5' END AS latitude,
       CASE c_custkey % 10 WHEN 0 THEN 'Ungraded' WHEN 1 THEN NULL ELSE 'K-8' END AS location_category_description,
       CASE c_custkey % 12 WHEN 0 THEN 'Home School' WHEN 1 THEN NULL ELSE 'General' END AS location_type_description,
       CASE c_custkey % 8 WHEN 0 THEN 'Charter' WHEN 1 THEN NULL ELSE 'DOE' END AS managed_by_name
FROM {{customer}}
UNION ALL
SELECT {_school("s_suppkey")}, 'B9', 'Second', 'MAIN', 'addr', CAST(1 + s_suppkey % 5 AS STRING) || '00' || CAST(s_suppkey % 3 AS STRING),
       '1', '2', 'K-8', 'General', 'DOE' FROM {{supplier}}
"""
BLUE_BOOK = f"""
SELECT CAST(p_partkey % 32 AS STRING) AS district, CAST(p_size % 4 AS STRING) AS subdistrict,
       CASE WHEN p_partkey % 29 = 0 THEN NULL ELSE {_school("p_partkey")} END AS org_id,
       'B' || CAST((p_partkey + CASE WHEN p_partkey % 5 = 0 THEN 1 ELSE 0 END) % 7 AS STRING) AS bldg_id,
       CASE p_partkey % 7 WHEN 0 THEN 'SPED' WHEN 1 THEN NULL WHEN 2 THEN 'OTHER' ELSE 'PS' END AS org_level,
       CASE WHEN p_partkey % 11 = 0 THEN 'Y' ELSE NULL END AS charter,
       CASE p_partkey % 13 WHEN 0 THEN 'Alc school' WHEN 1 THEN 'Alternative Learning X' WHEN 2 THEN 'ADULT CENTER' WHEN 3 THEN 'Pre-K Center'
         WHEN 4 THEN NULL ELSE 'P.S. ' || p_name END AS organization_name,
       CAST(p_size * 10 AS STRING) AS org_e, CAST(p_size AS STRING) || '.7' AS pc, '' AS ic, NULL AS hc,
       CAST(p_partkey % 100 AS STRING) || '.5%' AS ps_pct, '0%' AS ms_pct, NULL AS hs_pct,
       CASE p_partkey % 3 WHEN 0 THEN 'Y' WHEN 1 THEN 'no' ELSE NULL END AS bldg_excl
FROM {{part}}
UNION ALL
SELECT '1', '2', {_school("s_suppkey")}, 'B' || CAST(s_suppkey % 7 AS STRING), 'IS', NULL, 'I.S. twin', '100', '10', '20', '30', '50%', '7%', '', 'f'
FROM {{supplier}}
"""
# The ids of the rules, in their order.
_COMPETITIVE = "'X445','K449','K430','M692','X696','Q687','R605','M475'"
_GIFTED = "'M539','M334','K686','Q300','M012','M485'"
_SCHOOL_TAGS = f"""
bb AS (SELECT *, CASE WHEN org_id IN ('X695','M645') THEN 'o' WHEN org_id IN ({_GIFTED}) THEN 'citywide gifted and talented schools'
         WHEN org_id IN ({_COMPETITIVE}) THEN 'competitive high schools'
         WHEN organization_name ILIKE '%adult%' OR organization_name ILIKE '%pre-k%' THEN 'organization_name contains Adult OR PREK'
         WHEN organization_name ILIKE '%alc%' OR organization_name ILIKE '%alternative learning%' OR org_id IN ('M973','Q950') THEN 'alc'
         WHEN charter IS NOT NULL THEN 'charter' WHEN org_level IS NULL OR org_level IN ('SPED','OTHER') THEN 'level'
         WHEN org_id IS NULL THEN 'id' END AS reason FROM ({BLUE_BOOK})),
ls AS (SELECT *, CASE WHEN location_code IN ('X695','M645') THEN 'o'
         WHEN building_name ILIKE '% AF%' OR building_name ILIKE '%GYM%' OR building_name ILIKE '% FARM %' THEN 'building'
         WHEN location_code IN ({_GIFTED}) THEN 'gifted' WHEN location_code IN ({_COMPETITIVE}) THEN 'competitive'
         WHEN location_type_description IN ('Special Education','Home School') THEN 'type'
         WHEN managed_by_name <> 'DOE' THEN 'managed'
         WHEN location_category_description IS NULL OR location_category_description = 'Ungraded' THEN 'category' END AS reason
       FROM ({SCHOOL_LIST})),
lm AS (SELECT *, CASE WHEN reason IS NULL AND location_code || building_code NOT IN
                  (SELECT org_id || bldg_id FROM bb WHERE reason IS NULL) THEN 'not in blue book' END AS match FROM ls)
"""


@check(
    "recipe_school_buildings",
    f"""
WITH {_SCHOOL_TAGS},
ok AS (SELECT * FROM lm WHERE reason IS NULL AND match IS NULL), b AS (SELECT * FROM bb WHERE reason IS NULL),
share AS (SELECT b.*, round(CAST(nullif(replace(ps_pct, '%', ''), '') AS DECIMAL(12,4)) / 100, 5)::DECIMAL(17,5) AS p,
            round(CAST(nullif(replace(ms_pct, '%', ''), '') AS DECIMAL(12,4)) / 100, 5)::DECIMAL(17,5) AS m FROM b)
SELECT CAST(district AS INTEGER) AS district, CAST(subdistrict AS INTEGER) AS subdistrict,
       CAST(left(borough_block_lot, 1) AS INTEGER) AS borocode, building_name AS bldg_name,
       CASE WHEN bldg_excl = 'Y' THEN TRUE WHEN bldg_excl IN ('no', 'f') THEN FALSE END AS excluded,
       building_code AS bldg_id, location_code AS org_id, org_level, location_name AS name, address_line_1 AS address,
       coalesce(CAST(floor(CAST(pc AS DECIMAL(20,8))) AS INTEGER), 0) AS pc,
       coalesce(CAST(ceil(CAST(org_e AS DECIMAL(20,8)) * p) AS INTEGER), 0) AS pe,
       coalesce(CAST(floor(CAST(nullif(ic, '') AS DECIMAL(20,8))) AS INTEGER), 0) AS ic,
       coalesce(CAST(ceil(CAST(org_e AS DECIMAL(20,8)) * m) AS INTEGER), 0) AS ie,
       coalesce(CAST(floor(CAST(hc AS DECIMAL(20,8))) AS INTEGER), 0) AS hc, 0 AS he,
       'SRID=4326;POINT (' || regexp_replace(replace(longitude, 'NULL', '0'), '\\.0$', '') || ' ' || replace(latitude, 'NULL', '0') || ')' AS geom
FROM ok LEFT JOIN share ON location_code = org_id AND building_code = bldg_id
""",
)
def recipe_school_buildings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return JOBS["school_buildings"].run(_school_inputs(spark, sf_dir))["school_buildings"]


@check(
    "recipe_school_research",
    f"""
WITH {_SCHOOL_TAGS},
solid AS (SELECT location_code || borough_block_lot AS lot FROM lm WHERE NOT building_name ILIKE '%PORTABLE%' AND NOT building_name ILIKE '%MINI%')
SELECT location_code, building_code, building_name, match, CAST(NULL AS VARCHAR) AS ps_per FROM lm
WHERE reason IS NULL AND match IS NOT NULL
  AND NOT coalesce(location_code || borough_block_lot IN (SELECT lot FROM solid WHERE lot IS NOT NULL)
           AND (building_name ILIKE '%PORTABLE%' OR building_name ILIKE '%MINI%'), FALSE)
""",
)
def recipe_school_research(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = JOBS["school_buildings"].run(_school_inputs(spark, sf_dir))["school_research"]
    return out.select("location_code", "building_code", "building_name", "match", "ps_per")


@check(
    "blue_book_reconciled",
    f"""
WITH {_SCHOOL_TAGS}
SELECT org_id, bldg_id, organization_name, reason IS NOT NULL AS left_out,
       CASE WHEN reason IS NULL AND org_id || bldg_id NOT IN
         (SELECT location_code || building_code FROM ls WHERE reason IS NULL) THEN 'not in lcgms' END AS match FROM bb
""",
)
def blue_book_reconciled(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = unmatched_blue_book(_school_inputs(spark, sf_dir))
    return out.select("org_id", "bldg_id", "organization_name", F.col("excluded").isNotNull().alias("left_out"), "match")


def _school_inputs(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    names = {"ps_pct": "ps_%", "ms_pct": "ms_%", "hs_pct": "hs_%", "bldg_excl": "bldg_excl."}
    return {
        "blue_book": shaped(spark, sf_dir, BLUE_BOOK).withColumnsRenamed(names),
        "school_list": shaped(spark, sf_dir, SCHOOL_LIST),
    }


# --- R8: utilization changes -------------------------------------------------

PROPOSALS = """
SELECT CASE o_orderkey % 4 WHEN 0 THEN 'Withdrawn' WHEN 1 THEN NULL ELSE 'Approved' END AS approved,
       'B' || CAST(o_orderkey AS STRING) AS main_building_id, '' AS other_impacted_building, o_orderpriority AS proposal_title,
       CAST(year(o_orderdate) AS STRING) AS at_scale_year, '01' || lpad(CAST(o_custkey % 10000 AS STRING), 4, '0') AS dbn,
       CASE o_orderkey % 3 WHEN 0 THEN '300-350' WHEN 1 THEN '500–' || CAST(o_custkey AS STRING) ELSE 'TBD' END AS at_scale_school_enrollment,
       CASE WHEN o_orderkey % 14 = 3 THEN 'tbd' ELSE CAST(month(o_orderdate) AS STRING) || '/' || CAST(day(o_orderdate) AS STRING) || '/'
            || CAST(year(o_orderdate) + 18 AS STRING) END AS pep_vote
FROM {orders}
"""
# One address for each meeting day, and blanks.
URLS = """
SELECT 'u' || CAST(max(n) AS STRING) AS url, sy AS school_year, 'r' AS readable_url, d AS date FROM (
  SELECT n, CASE WHEN m < 9 THEN CAST(y - 1 AS STRING) || '-' || CAST(y AS STRING) ELSE CAST(y AS STRING) || '-' || CAST(y + 1 AS STRING) END AS sy,
         CASE WHEN n % 10 = 0 THEN '' ELSE CAST(y AS STRING) || '-' || lpad(CAST(m AS STRING), 2, '0') || '-'
           || lpad(CAST(1 + n % 28 AS STRING), 2, '0') END AS d
  FROM (SELECT c_custkey AS n, CAST(2015 + c_custkey % 6 AS INT) AS y, CAST(1 + floor(c_custkey / 6) % 12 AS INT) AS m FROM {customer}))
GROUP BY sy, d
"""


@check(
    "recipe_utilization_changes",
    f"""
WITH p AS (SELECT *, CASE WHEN pep_vote <> 'tbd' THEN CAST(try_strptime(pep_vote, '%m/%d/%Y') AS DATE) END AS d FROM ({PROPOSALS}) WHERE approved = 'Approved'),
     a AS (SELECT *, coalesce(CASE WHEN month(d) < 9 THEN (year(d) - 1) || '-' || year(d) ELSE year(d) || '-' || (year(d) + 1) END, '')
             || ' ' || coalesce(CASE WHEN d >= DATE '2016-04-21' THEN strftime(d, '%Y-%m-%d') END, '') AS k FROM p),
     u AS (SELECT url, school_year || ' ' || date AS k FROM ({URLS}))
SELECT main_building_id AS bldg_id, right(dbn, 4) AS org_id, other_impacted_building AS bldg_id_additional, proposal_title AS title,
       at_scale_year, url, CASE WHEN main_building_id IS NOT NULL THEN
         coalesce(TRY_CAST(string_split(replace(at_scale_school_enrollment, '–', '-'), '-')[-1] AS INTEGER), 0) END AS at_scale_enroll, d AS vote_date
FROM a FULL JOIN u USING (k)
""",
)
def recipe_utilization_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    inputs = {"proposals": shaped(spark, sf_dir, PROPOSALS), "meeting_urls": shaped(spark, sf_dir, URLS)}
    return JOBS["utilization_changes"].run(inputs)["utilization_changes"]


# Each stored page with three meeting links put before its own; the page decides
# their days.
MEETING_PAGES = """
SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'current' ELSE 'archive' END AS source,
  '<a class="x" href="https://a.sharepoint.com/%20s/b/c/d/e/f/g/h/i/201' || CAST(page_id % 10 AS STRING) || '/October 1, 2019 long'
  || CAST(page_id AS STRING) || '&amp;p=true">one</a><A href=''https://a.sharepoint.com/s/b/c/d/e/f/g/h/i/201' || CAST(page_id % 10 AS STRING)
  || '/October 1, 2019''>two</a><a href="https://a.sharepoint.com/s/b/c/d/e/f/g/h/i/201' || CAST(page_id % 10 AS STRING)
  || '/Undated"><b>three</b></a><a href="https://a.sharepoint.com/Contracts/b/c/d/e/f/g/h/i/2019/x">four</a>' || html AS html
FROM {pages}
"""


@check(
    "recipe_meeting_urls",
    """
WITH l AS (
  SELECT page_id, page_id % 2 AS rk, 1 AS pos, '2019-10-01' AS date, 'https://a.sharepoint.com/%20s/b/c/d/e/f/g/h/i/201' || (page_id % 10)
           || '/October 1, 2019 long' || page_id || '&p=true' AS url FROM {pages}
  UNION ALL SELECT page_id, page_id % 2, 2, '2019-10-01', 'https://a.sharepoint.com/s/b/c/d/e/f/g/h/i/201' || (page_id % 10) || '/October 1, 2019' FROM {pages}
  UNION ALL SELECT page_id, page_id % 2, 3, '', 'https://a.sharepoint.com/s/b/c/d/e/f/g/h/i/201' || (page_id % 10) || '/Undated' FROM {pages}
  WHERE page_id % 2 = 1),
r AS (SELECT *, replace(url, '%20', ' ') AS readable_url, '201' || (page_id % 10) AS school_year FROM l),
a AS (SELECT *, CASE WHEN lag(date || school_year) OVER (ORDER BY rk, page_id, pos) = date || school_year THEN 0 ELSE 1 END AS st FROM r),
b AS (SELECT *, sum(st) OVER (ORDER BY rk, page_id, pos ROWS UNBOUNDED PRECEDING) AS run FROM a),
c AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY length(readable_url), rk, page_id, pos) AS rn FROM b)
SELECT url, school_year, readable_url, date FROM c WHERE rn = 1
""",
)
def recipe_meeting_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return meeting_urls(shaped(spark, sf_dir, MEETING_PAGES))


# --- R18: capital plan -------------------------------------------------------

CAPITAL_PLAN = """
SELECT 'DSF' || CAST(o_orderkey AS STRING) AS projectid,
       CASE o_custkey % 12 WHEN 0 THEN 'P.S./I.S. 12' WHEN 1 THEN 'I.S. 5' WHEN 2 THEN 'M.S. 8' WHEN 3 THEN 'PRE-K CENTER' WHEN 4 THEN '3K CENTER'
         WHEN 5 THEN 'PS 4' WHEN 6 THEN 'HS OF ART' WHEN 7 THEN 'MUSIC HIGH SCHOOL' WHEN 8 THEN 'THIS ONE' WHEN 9 THEN NULL
         WHEN 10 THEN 'I.S./H.S. 3' ELSE 'IS 7' END AS schoolname,
       CASE o_orderkey % 3 WHEN 0 THEN 'capacity projects (new)' WHEN 1 THEN 'Capacity Projects' ELSE 'Repairs' END AS type,
       CASE o_orderkey % 4 WHEN 0 THEN ' ' || CAST(o_custkey AS STRING) || ' ' WHEN 1 THEN '12.5' WHEN 2 THEN 'n/a' ELSE '' END AS forecastcapacity,
       CASE WHEN o_orderkey % 2 = 0 THEN 'Sep-' || CASE WHEN o_custkey % 2 = 0 THEN '70' ELSE '21' END ELSE '21-jan' END AS constrstart,
       CASE WHEN o_orderkey % 5 = 0 THEN '2021' ELSE '2023-06-30 00:00:00' END AS actualestcompletion,
       CASE o_orderkey % 7 WHEN 0 THEN '1.2e+07' WHEN 1 THEN '0' WHEN 2 THEN NULL ELSE CAST(o_custkey + 1000 AS STRING) END AS totalestcost,
       CAST(o_custkey AS STRING) AS fundingreqd, CASE WHEN o_orderkey % 6 = 0 THEN 'none' ELSE '500' END AS previousappropriations
FROM {orders}
"""


@check(
    "recipe_capital_projects",
    f"""
WITH p AS (SELECT *, CASE WHEN schoolname LIKE '%3K%' THEN '3K' WHEN schoolname LIKE '%PRE-K%' THEN 'PK' WHEN contains(schoolname, 'P.S./I.S.') THEN 'PSIS'
             WHEN contains(schoolname, 'P.S.') THEN 'PS' WHEN contains(schoolname, 'I.S.') OR contains(schoolname, 'M.S.') THEN 'IS'
             WHEN contains(schoolname, 'H.S.') OR contains(schoolname, 'HIGH SCHOOL') THEN 'HS' WHEN regexp_matches(schoolname, '\\bPS\\b') THEN 'PS'
             WHEN regexp_matches(schoolname, '\\bIS\\b') THEN 'IS' WHEN regexp_matches(schoolname, '\\bHS\\b') THEN 'HS' END AS lv,
             TRY_CAST(totalestcost AS DOUBLE) AS cost, TRY_CAST(previousappropriations AS DOUBLE) AS prev, CAST(fundingreqd AS DOUBLE) AS cur
           FROM ({CAPITAL_PLAN}) WHERE type ILIKE '%capacity projects%')
SELECT projectid AS project_dsf, schoolname AS name, lv AS org_level,
       CASE WHEN regexp_matches(forecastcapacity, '^ *[0-9]+ *$') THEN CAST(trim(forecastcapacity, ' ') AS BIGINT) ELSE 0 END AS capacity,
       CAST(CASE lv WHEN 'PS' THEN 1 WHEN 'PSIS' THEN 0.5 ELSE 0 END AS DOUBLE) AS pct_ps,
       CAST(CASE lv WHEN 'IS' THEN 1 WHEN 'PSIS' THEN 0.5 ELSE 0 END AS DOUBLE) AS pct_is,
       CAST(CASE lv WHEN 'HS' THEN 1 ELSE 0 END AS DOUBLE) AS pct_hs, coalesce(lv = 'PSIS', FALSE) AS guessed_pct,
       CASE constrstart WHEN 'Sep-70' THEN DATE '1970-09-01' WHEN 'Sep-21' THEN DATE '2021-09-01' ELSE DATE '2021-01-01' END AS start_date,
       CASE WHEN actualestcompletion <> '2021' THEN DATE '2023-06-30' END AS planned_end_date, cost AS total_est_cost,
       cur AS funding_current_budget, prev AS funding_previous, (prev + cur) / nullif(cost, 0) AS pct_funded
FROM p
""",
)
def recipe_capital_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return JOBS["capital_projects"].run({"capital_plan": shaped(spark, sf_dir, CAPITAL_PLAN)})["capital_projects"]
