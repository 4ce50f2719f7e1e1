"""Reference tables for geocoding, shaped from the driver's tables.

Every customer is an address, every supplier a place name, every part a
crossing of two streets and a stretch between two nodes.
"""

BOROUGH = """CASE {0} % 5 WHEN 0 THEN 'Manhattan' WHEN 1 THEN 'Bronx' WHEN 2 THEN 'Brooklyn' WHEN 3 THEN 'Queens'
  ELSE 'Staten Island' END"""


def borough(c: str) -> str:
    return BOROUGH.replace("{0}", c)


ADDRESS_POINTS = f"""
SELECT CAST(c_custkey AS STRING) AS house, c_mktsegment || ' ST' AS street, {borough("c_nationkey")} AS borough,
       '1' || lpad(CAST(c_nationkey AS STRING), 4, '0') AS zipcode,
       CASE WHEN c_custkey % 7 <> 0 THEN CAST(c_custkey % 64 AS DOUBLE) / 64 - 74 END AS lon,
       CASE WHEN c_custkey % 7 <> 0 THEN CAST(c_custkey % 32 AS DOUBLE) / 32 + 40 END AS lat,
       CASE WHEN c_custkey % 7 = 0 THEN lpad(CAST(980000 + c_custkey % 9000 AS STRING), 7, '0')
            || lpad(CAST(200000 + c_custkey % 8000 AS STRING), 7, '0') END AS xy_coord,
       CASE WHEN c_custkey % 3 = 0 THEN '0000000000' ELSE CAST(1000000000 + c_custkey AS STRING) END AS bbl,
       CAST(5000000 + c_custkey AS STRING) AS bin, CAST(c_custkey AS STRING) AS norm_house,
       c_mktsegment || '   ST' AS norm_street, c_custkey % 5 = 1 AS is_pending,
       CASE WHEN c_custkey % 23 = 0 THEN '71' ELSE '00' END AS return_code
FROM {{customer}}
"""

PLACE_NAMES = """
SELECT CAST(s_suppkey AS STRING) AS house, 'PLACE ' || CAST(s_suppkey AS STRING) AS street,
       '1' || lpad(CAST(s_nationkey AS STRING), 4, '0') AS zipcode,
       CAST(s_suppkey % 64 AS DOUBLE) / 64 - 73 AS lon, CAST(s_suppkey % 32 AS DOUBLE) / 32 + 41 AS lat,
       CAST(2000000000 + s_suppkey AS STRING) AS bbl, CAST(6000000 + s_suppkey AS STRING) AS bin
FROM {supplier}
"""

CROSSINGS = f"""
SELECT 'size ' || CAST(p_partkey % 50 AS STRING) AS street_a, 'Part ' || CAST(p_partkey AS STRING) AS street_b,
       {borough("p_partkey")} AS borough, CAST(980000 + p_partkey % 9000 AS STRING) AS x,
       CAST(200000 + p_partkey % 8000 AS STRING) AS y
FROM {{part}}
"""

SEGMENTS = f"""
SELECT 'ON ' || CAST(p_partkey AS STRING) AS on_street, CAST(p_size AS STRING) || ' AVES' AS from_street,
       CAST(p_partkey % 50 AS STRING) || ' AVES' AS to_street, {borough("p_partkey")} AS borough,
       CAST(p_partkey AS STRING) AS from_node,
       CASE WHEN p_partkey % 6 = 0 THEN 'none' ELSE CAST(CAST(floor((p_partkey + 1) / 2) AS BIGINT) AS STRING) END AS to_node
FROM {{part}}
"""

NODES = """
SELECT CAST(p_partkey AS STRING) AS node, CAST(980000 + p_partkey % 9000 AS DOUBLE) AS x,
       CAST(200000 + p_partkey % 8000 AS DOUBLE) AS y
FROM {part}
"""
