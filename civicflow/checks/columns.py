"""Checks of text, code, date, number, link, address and geometry columns."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from civicflow.checks.registry import check, shaped, table
from civicflow.functions.address import crossing, house_number, street_name, stretch
from civicflow.functions.codes import first_match, keyword_rules, label, last_match, range_label, weight
from civicflow.functions.dates import date_from, first_readable_date, school_year, us_date
from civicflow.functions.geometry import centroid, ewkt, midpoint, packed_xy, parse_polygons, point_wkt, point_wkt_of
from civicflow.functions.links import explode_anchors, first_date_in_path, path_part, path_parts, readable
from civicflow.functions.numbers import (
    allocate,
    percent_share,
    range_end,
    ratio,
    to_exact,
    to_number,
    to_number_marked,
    to_whole,
    truncated,
)
from civicflow.functions.projection import to_lon_lat
from civicflow.functions.text import (
    CROSSING_NARROW,
    CROSSING_WIDE,
    blank,
    clean_borough,
    clean_house,
    clean_street,
    content_hash,
    crossing_part,
    cut_at_first,
    display_key,
    last_part,
    prefer,
    replace_if_different,
    spaced,
)
from civicflow.operators.spatial import meets_any

MARKED = """
SELECT o_orderkey, CAST(o_custkey % 40 AS INT) AS district,
       CASE o_custkey % 7 WHEN 0 THEN 'STATENISLAND' WHEN 1 THEN 'BRONX' WHEN 2 THEN 'QUEENS'
            WHEN 3 THEN 'NEWARK' WHEN 4 THEN NULL WHEN 5 THEN 'STATEN ISLAND' ELSE 'BROOKLYN' END AS borough,
       CASE o_orderkey % 4 WHEN 0 THEN 'JFK BLDG ' || CAST(o_custkey AS STRING) WHEN 1 THEN NULL
            ELSE 'MAIN ST' END AS street,
       nullif(o_orderstatus, 'P') AS status, o_orderpriority
FROM {orders}
"""
STATUS_NAMES = {"F": "finished", "O": "open"}
DISTRICTS = [(1, 6, "Manhattan"), (7, 12, "Bronx"), (13, 23, "Brooklyn"), (32, 32, "Brooklyn")]


@check(
    "code_map_default",
    f"""
WITH m AS ({MARKED})
SELECT o_orderkey,
       CASE status WHEN 'F' THEN 'finished' WHEN 'O' THEN 'open' ELSE '' END AS status_name,
       CASE WHEN district BETWEEN 1 AND 6 THEN 'Manhattan' WHEN district BETWEEN 7 AND 12 THEN 'Bronx'
            WHEN district BETWEEN 13 AND 23 OR district = 32 THEN 'Brooklyn' END AS district_name,
       CASE borough WHEN 'STATENISLAND' THEN 'Staten Island' WHEN 'STATEN ISLAND' THEN 'Staten Island'
            WHEN 'BRONX' THEN 'Bronx' WHEN 'QUEENS' THEN 'Queens' WHEN 'BROOKLYN' THEN 'Brooklyn' END AS borough,
       CASE WHEN street IS NULL THEN '' WHEN contains(street, 'JFK') THEN 'JFK INTERNATIONAL AIRPORT'
            ELSE street END AS street,
       CASE status WHEN 'F' THEN 1.0::DOUBLE WHEN 'O' THEN 0.5::DOUBLE ELSE 0::DOUBLE END AS part
FROM m
""",
)
def code_map_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shaped(spark, sf_dir, MARKED).select(
        "o_orderkey",
        label("status", STATUS_NAMES, "").alias("status_name"),
        range_label("district", DISTRICTS).alias("district_name"),
        clean_borough("borough").alias("borough"),
        clean_street("street").alias("street"),
        weight("status", {"F": 1.0, "O": 0.5}).alias("part"),
    )


@check(
    "first_match_rules",
    """
SELECT p_partkey, p_name, level, CASE level WHEN 'A' THEN 1::DOUBLE WHEN 'AB' THEN 0.5::DOUBLE ELSE 0::DOUBLE END AS pct,
       coalesce(length(level), 0) > 1 AS guessed
FROM (SELECT p_partkey, p_name,
             CASE WHEN contains(p_name, 'new w') THEN 'AB' WHEN contains(p_name, 'widget') THEN 'A'
                  WHEN contains(p_name, 'anvil') THEN 'B' WHEN regexp_matches(p_name, '\\bred\\b') THEN 'A'
                  WHEN regexp_matches(p_name, '\\bol\\b') THEN 'C' END AS level FROM {part})
""",
)
def first_match_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = keyword_rules(
        "p_name", [("new w", "AB"), ("widget", "A"), ("anvil", "B")], words=[("red", "A"), ("ol", "C")]
    )
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name", rules.alias("level"))
    return parts.withColumn("pct", weight("level", {"A": 1.0, "AB": 0.5})).withColumn(
        "guessed", F.coalesce(F.length("level"), F.lit(0)) > 1
    )


@check(
    "last_match_rules",
    """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
       CASE WHEN l_tax > 0.07 THEN 'tax' WHEN p_type = 'PROMO' OR p_type IS NULL THEN 'promo'
            WHEN regexp_matches(p_name, '(?i)BOLT') THEN 'bolt' WHEN l_quantity > 40 THEN 'bulk' END AS excluded
FROM {lineitem} LEFT JOIN (SELECT CASE WHEN p_size > 5 THEN p_partkey END AS k, p_type, p_name FROM {part}) ON l_partkey = k
""",
)
def last_match_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").withColumn("k", F.expr("CASE WHEN p_size > 5 THEN p_partkey END"))
    lines = table(spark, sf_dir, "lineitem").join(parts, F.col("l_partkey") == F.col("k"), "left")
    tag = last_match(
        [
            (F.col("l_quantity") > 40, "bulk"),
            (F.col("p_name").rlike("(?i)BOLT"), "bolt"),
            ((F.col("p_type") == "PROMO") | F.col("p_type").isNull(), "promo"),
            (F.col("l_tax") > 0.07, "tax"),
        ]
    )
    return lines.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", tag.alias("excluded"))


@check(
    "string_clean",
    r"""
WITH t AS (SELECT doc_id, source, lang, text,
           CASE WHEN doc_id % 9 = 0 THEN NULL WHEN doc_id % 4 = 0 THEN '0' || source
                WHEN doc_id % 4 = 1 THEN '12 - 14 (REAR) ' || source ELSE '7/9 (' || source END AS house
           FROM {documents})
SELECT doc_id, md5(upper(trim(replace(text, 'ß', 'ss'), ' '))) AS upper_text, left(text, 3) AS head, right(text, 3) AS tail,
       split_part(text, '.', 1) AS sentence,
       md5(list_element(string_split_regex(text, '\||&|@| AND '), 1)) AS cut_text,
       md5(split_part(split_part(replace(replace(replace(regexp_replace(text, '\([^)]*\)', '', 'g'), '''', ''),
           'VARIOUS', ''), 'LOCATIONS', ''), '(', 1), '/', 1)) AS street,
       split_part(split_part(replace(regexp_replace(CASE WHEN coalesce(house, ' ') LIKE '0%' THEN ''
           ELSE coalesce(house, ' ') END, '\([^)]*\)', '', 'g'), ' - ', '-'), '(', 1), '/', 1) AS house,
       lang || ' ' || nullif(source, 'src3') AS joined,
       coalesce(nullif(source, 'src3'), '') || ' ' || lang AS display,
       string_split(text, ' ')[-1] AS last_word
FROM t
""",
)
def string_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    key = F.col("doc_id")
    house = (
        F.when(key % 9 == 0, F.lit(None).cast("string"))
        .when(key % 4 == 0, F.concat(F.lit("0"), "source"))
        .when(key % 4 == 1, F.concat(F.lit("12 - 14 (REAR) "), "source"))
        .otherwise(F.concat(F.lit("7/9 ("), "source"))
    )
    known = F.nullif(F.col("source"), F.lit("src3"))
    return docs.select(
        "doc_id",
        F.md5(F.upper(F.trim(F.replace("text", F.lit("ß"), F.lit("ss"))))).alias("upper_text"),
        F.left("text", F.lit(3)).alias("head"),
        F.right("text", F.lit(3)).alias("tail"),
        F.substring_index("text", ".", 1).alias("sentence"),
        F.md5(cut_at_first("text")).alias("cut_text"),
        F.md5(clean_street("text", airport=False)).alias("street"),
        clean_house(house, blank_leading_zero=True).alias("house"),
        spaced("lang", known).alias("joined"),
        display_key(known, "lang").alias("display"),
        last_part("text", " ").alias("last_word"),
    )


@check(
    "intersection_split",
    r"""
WITH t AS (SELECT doc_id, text, upper(regexp_replace(text, '[^\x00-\x7F]', 'x', 'g')) AS plain FROM {documents})
SELECT doc_id,
       md5(CASE WHEN regexp_matches(text, '(?i)&| AND ') THEN string_split_regex(text, '(?i)&| AND ')[1] ELSE '' END) AS first_part,
       md5(CASE WHEN regexp_matches(text, '(?i)&| AND ') THEN string_split_regex(text, '(?i)&| AND ')[-1] ELSE '' END) AS last_part,
       md5(CASE WHEN regexp_matches(text, '(?i)&| AND |CROSS|CRS') THEN string_split_regex(text, '(?i)&| AND |CROSS|CRS')[1]
           ELSE '' END) AS wide_part,
       md5(CASE WHEN len(string_split_regex(plain, '\bAND\b')) >= 2
           THEN trim(string_split_regex(plain, '\bAND\b')[2], ' ') ELSE '' END) AS street_2
FROM t
""",
)
def intersection_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The oracle's word boundary knows plain letters only.
    plain = F.upper(F.regexp_replace("text", r"[^\x00-\x7F]", "x"))
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        F.md5(crossing_part("text", CROSSING_NARROW, first=True)).alias("first_part"),
        F.md5(crossing_part("text", CROSSING_NARROW, first=False)).alias("last_part"),
        F.md5(crossing_part("text", CROSSING_WIDE, first=True)).alias("wide_part"),
        F.md5(crossing(plain)["street_2"]).alias("street_2"),
    )


# Plan dates in the spellings the plans use, and some that are no dates.
SPELLED_DATES = """
SELECT o_orderkey,
       CASE o_orderkey % 7
         WHEN 0 THEN CAST(year(o_orderdate) AS STRING)
         WHEN 1 THEN CASE month(o_orderdate) WHEN 1 THEN 'January' WHEN 2 THEN 'february' WHEN 3 THEN 'March'
              WHEN 4 THEN 'April' WHEN 5 THEN 'MAY' WHEN 6 THEN 'June' WHEN 7 THEN 'July' WHEN 8 THEN 'August'
              WHEN 9 THEN 'September' WHEN 10 THEN 'October' WHEN 11 THEN 'November' ELSE 'Dezember' END
              || ' ' || CAST(year(o_orderdate) AS STRING)
         WHEN 2 THEN substr('JanFebMarAprMayJunJulAugSepOctNovDec', month(o_orderdate) * 3 - 2, 3) || '-'
              || lpad(CAST((year(o_orderdate) + o_custkey) % 100 AS STRING), 2, '0')
         WHEN 3 THEN lpad(CAST((year(o_orderdate) + o_custkey) % 100 AS STRING), 2, '0') || '-'
              || substr('JanFebMarAprMayJunJulAugSepOctNovDec', month(o_orderdate) * 3 - 2, 3)
         WHEN 4 THEN CAST(year(o_orderdate) AS STRING) || '-' || lpad(CAST(month(o_orderdate) AS STRING), 2, '0') || '-'
              || lpad(CAST(day(o_orderdate) AS STRING), 2, '0') || ' 00:00:00'
         WHEN 5 THEN CAST(month(o_orderdate) AS STRING) || '/' || CAST(day(o_orderdate) AS STRING) || '/'
              || CAST(year(o_orderdate) AS STRING)
         ELSE 'TBD' END AS spelled,
       CAST(month(o_orderdate) AS STRING) || '/' || CAST(day(o_orderdate) AS STRING) || '/'
         || CAST(year(o_orderdate) AS STRING) AS us
FROM {orders}
"""


@check(
    "multi_format_date",
    f"""
WITH s AS ({SPELLED_DATES}),
     p AS (SELECT s.*, o_orderdate AS d, (year(o_orderdate) + o_custkey) % 100 AS yy
           FROM s JOIN {{orders}} o USING (o_orderkey))
SELECT o_orderkey, spelled,
       CASE o_orderkey % 7
         WHEN 0 THEN make_date(year(d), 1, 1)
         WHEN 1 THEN CASE WHEN month(d) < 12 THEN make_date(year(d), month(d), 1) END
         WHEN 2 THEN make_date(CASE WHEN yy >= 69 THEN 1900 ELSE 2000 END + yy, month(d), 1)
         WHEN 3 THEN make_date(CASE WHEN yy >= 69 THEN 1900 ELSE 2000 END + yy, month(d), 1)
         WHEN 4 THEN CAST(d AS DATE) END AS opened
FROM p
""",
)
def multi_format_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shaped(spark, sf_dir, SPELLED_DATES).select(
        "o_orderkey", "spelled", first_readable_date("spelled").alias("opened")
    )


@check(
    "date_cutoff_year_label",
    f"""
WITH s AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 < 5 THEN us ELSE spelled END AS us FROM ({SPELLED_DATES})),
     p AS (SELECT o_orderkey, CASE WHEN regexp_matches(us, '/') THEN CAST(try_strptime(us, '%m/%d/%Y') AS DATE) END AS d
           FROM s),
     q AS (SELECT o_orderkey, coalesce(CASE WHEN d >= DATE '1998-04-21' THEN strftime(d, '%Y-%m-%d') END, '') AS cut,
             coalesce(CASE WHEN month(d) < 9 THEN CAST(year(d) - 1 AS VARCHAR) || '-' || CAST(year(d) AS VARCHAR)
               ELSE CAST(year(d) AS VARCHAR) || '-' || CAST(year(d) + 1 AS VARCHAR) END, '') AS school_year FROM p)
SELECT o_orderkey, cut, school_year, school_year || ' ' || cut AS join_key FROM q
""",
)
def date_cutoff_year_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("o_orderkey") % 7 < 5, F.col("us")).otherwise(F.col("spelled"))
    return (
        shaped(spark, sf_dir, SPELLED_DATES)
        .select("o_orderkey", text.alias("us"))
        .select(
            "o_orderkey",
            date_from("us", "1998-04-21").alias("cut"),
            school_year(us_date("us")).alias("school_year"),
        )
        .withColumn("join_key", display_key("school_year", "cut"))
    )


SPELLED_NUMBERS = """
SELECT event_id,
       CASE event_id % 8
         WHEN 0 THEN CAST(CAST(floor(value * 1000) AS BIGINT) AS STRING)
         WHEN 1 THEN '1,' || lpad(CAST(event_id % 1000 AS STRING), 3, '0')
         WHEN 2 THEN '+/-' || CAST(value AS STRING)
         WHEN 3 THEN '.' || CAST(event_id % 100 AS STRING)
         WHEN 4 THEN ' '
         WHEN 5 THEN CAST(event_id % 9 AS STRING) || '.5e+0' || CAST(event_id % 5 AS STRING)
         WHEN 6 THEN 'n/a'
         ELSE NULL END AS number,
       CASE event_id % 5
         WHEN 0 THEN CAST(user_id AS STRING) || '-' || CAST(user_id + 50 AS STRING)
         WHEN 1 THEN CAST(user_id AS STRING) || '–' || CAST(user_id + 7 AS STRING)
         WHEN 2 THEN CAST(user_id AS STRING)
         WHEN 3 THEN CAST(user_id AS STRING) || '-9999999999'
         ELSE NULL END AS span
FROM {events}
"""


@check(
    "number_tolerant",
    f"""
WITH s AS ({SPELLED_NUMBERS})
SELECT event_id, number, TRY_CAST(number AS DOUBLE) AS parsed,
       TRY_CAST(replace(replace(number, ',', ''), '+/-', '') AS DOUBLE) AS marked,
       CASE WHEN regexp_matches(number, '^[0-9]+$') THEN TRY_CAST(number AS BIGINT) END AS whole,
       CAST(trunc(TRY_CAST(replace(replace(number, ',', ''), '+/-', '') AS DOUBLE)) AS BIGINT) AS cut,
       coalesce(TRY_CAST(string_split(replace(span, '–', '-'), '-')[-1] AS INTEGER), 0) AS upper_end
FROM s
""",
)
def number_tolerant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shaped(spark, sf_dir, SPELLED_NUMBERS).select(
        "event_id",
        "number",
        to_number("number").alias("parsed"),
        to_number_marked("number").alias("marked"),
        to_whole("number").alias("whole"),
        truncated(to_number_marked("number"), "bigint").alias("cut"),
        range_end("span").alias("upper_end"),
    )


@check(
    "decimal_ceil_floor",
    """
WITH t AS (SELECT p_partkey, CAST(p_size AS VARCHAR) || '00.0000001' AS total,
                  CAST(p_partkey % 100 AS VARCHAR) || '.5%' AS pct, p_size * 100.0::DOUBLE AS total_d,
                  (p_partkey % 100) / 100.0::DOUBLE AS share_d, CAST(p_retailprice AS VARCHAR) AS price FROM {part})
SELECT p_partkey,
       CAST(ceil(CAST(total AS DECIMAL(28,10)) * round(CAST(replace(pct, '%', '') AS DECIMAL(10,4)) / 100, 5)::DECIMAL(9,5))
            AS INTEGER) AS exact_up,
       CAST(ceil(total_d * share_d) AS BIGINT) AS double_up, CAST(floor(CAST(price AS DECIMAL(20,8))) AS INTEGER) AS down,
       CAST(qty AS BIGINT) AS qty, CAST(ceil(qty * share_d) AS BIGINT) AS allocated
FROM t LEFT JOIN (SELECT l_partkey, sum(l_quantity) AS qty FROM {lineitem} GROUP BY 1) ON p_partkey = l_partkey
""",
)
def decimal_ceil_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    parts = table(spark, sf_dir, "part").select(
        "p_partkey",
        F.concat(F.col("p_size").cast("string"), F.lit("00.0000001")).alias("total"),
        F.concat((key % 100).cast("string"), F.lit(".5%")).alias("pct"),
        (F.col("p_size") * 100.0).alias("total_d"),
        (key % 100 / 100.0).alias("share_d"),
        F.col("p_retailprice").cast("string").alias("price"),
    )
    sums = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(
        F.sum("l_quantity").alias("qty")
    )
    return parts.join(sums, "p_partkey", "left").select(
        "p_partkey",
        truncated(allocate(to_exact("total"), percent_share("pct"))).alias("exact_up"),
        allocate("total_d", "share_d").alias("double_up"),
        truncated(F.floor(to_exact("price"))).alias("down"),
        F.col("qty").cast("bigint").alias("qty"),
        allocate("qty", "share_d").alias("allocated"),
    )


@check(
    "safe_ratio",
    """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
       (coalesce(l_tax, 0) + l_discount) / nullif(l_tax, 0) AS funded,
       CASE WHEN coalesce(nullif(l_returnflag, 'N'), '') <> '' THEN l_returnflag ELSE l_linestatus END AS preferred,
       l_linestatus AS link
FROM {lineitem}
""",
)
def safe_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag = F.nullif(F.col("l_returnflag"), F.lit("N"))
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        ratio(F.coalesce("l_tax", F.lit(0.0)) + F.col("l_discount"), "l_tax").alias("funded"),
        prefer(flag, "l_linestatus").alias("preferred"),
        replace_if_different(flag, "l_linestatus").alias("link"),
    )


@check(
    "content_hash",
    """
SELECT o_orderkey, md5('{"o_custkey":' || CAST(o_custkey AS VARCHAR) || ',"o_orderkey":' || CAST(o_orderkey AS VARCHAR)
       || ',"o_orderpriority":"' || o_orderpriority || '","o_orderstatus":'
       || CASE WHEN o_orderstatus = 'P' THEN 'null' ELSE '"' || o_orderstatus || '"' END || '}') AS uid
FROM {orders}
""",
)
def content_hash_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey",
        "o_custkey",
        F.nullif(F.col("o_orderstatus"), F.lit("P")).alias("o_orderstatus"),
        "o_orderpriority",
    )
    return orders.select("o_orderkey", content_hash(orders.columns).alias("uid"))


@check(
    "html_links",
    r"""
WITH p AS (SELECT page_id, string_split_regex(regexp_replace(html, '(?is)<!--.*?-->|<script.*?</script>|<style.*?</style>', '', 'g'),
                                             '(?i)<a\s')[2:] AS pieces FROM {pages}),
     e AS (SELECT page_id, unnest(range(len(pieces))) AS pos, unnest(pieces) AS piece FROM p),
     f AS (SELECT page_id, pos, piece,
             regexp_extract(piece, '^[^>]*?href\s*=\s*"([^"]*)"', 1) AS href,
             regexp_replace(regexp_replace(string_split_regex(piece, '(?i)</a\s*>')[1], '^[^>]*>', ''),
                            '<[^>]*>', '', 'g') AS text FROM e)
SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY pos) - 1 AS INTEGER) AS pos,
       replace(replace(replace(replace(replace(href, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&') AS href,
       trim(replace(replace(replace(replace(replace(text, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), ' ') AS text
FROM f WHERE regexp_matches(piece, '^[^>]*?href\s*=\s*"')
""",
)
def html_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explode_anchors(table(spark, sf_dir, "pages"), keep=["page_id"])


@check(
    "url_parts",
    """
WITH u AS (SELECT page_id, url || '%20a%26b&tail=' || CAST(page_id AS VARCHAR) AS url FROM {pages}),
     d AS (SELECT page_id, replace(replace(url, '%20', ' '), '%26', '&') AS readable FROM u),
     p AS (SELECT page_id, readable, list_filter(string_split(split_part(readable, '&', 1), '/'), lambda x: x <> '') AS parts FROM d)
SELECT page_id, readable, parts[2] AS host, parts[3] AS lang, parts[6] AS deep, CAST(len(parts) AS INTEGER) AS n FROM p
""",
)
def url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    tail = F.concat(F.lit("%20a%26b&tail="), F.col("page_id").cast("string"))
    urls = table(spark, sf_dir, "pages").select("page_id", readable(F.concat("url", tail)).alias("readable"))
    return urls.select(
        "page_id",
        "readable",
        path_part("readable", 1).alias("host"),
        path_part("readable", 2).alias("lang"),
        path_part("readable", 5).alias("deep"),
        F.size(path_parts("readable")).alias("n"),
    )


DATED_URLS = """
SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'current' ELSE 'archive' END AS source,
       url || CASE page_id % 5
         WHEN 0 THEN '/October ' || CAST(1 + page_id % 28 AS STRING) || ', 2019 Panel/Public Notice/May 1, 2018'
         WHEN 1 THEN '/x/June ' || CAST(1 + page_id % 28 AS STRING) || ' 2018 Panel/May 1, 2017'
         WHEN 2 THEN '/2019-2020/Public Notice May 1, 2018'
         WHEN 3 THEN '/Meeting 12, 2019/April 3, 2016&p=July 4, 2015'
         ELSE '/undated' END AS url
FROM {pages}
"""


@check(
    "path_date",
    f"""
WITH u AS ({DATED_URLS}),
     q AS (SELECT u.page_id, source, CASE WHEN contains(p.url, '&') THEN NULL ELSE CASE u.page_id % 5
             WHEN 0 THEN make_date(2019, 10, CAST(1 + u.page_id % 28 AS INTEGER))
             WHEN 1 THEN make_date(2018, 6, CAST(1 + u.page_id % 28 AS INTEGER))
             WHEN 3 THEN DATE '2016-04-03' END END AS d FROM u JOIN {{pages}} p USING (page_id))
SELECT page_id, source, coalesce(strftime(d, '%Y-%m-%d'), '') AS date FROM q WHERE d IS NOT NULL OR source = 'archive'
""",
)
def path_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.date_format(first_date_in_path("url"), "yyyy-MM-dd")
    dated = shaped(spark, sf_dir, DATED_URLS).select("page_id", "source", blank(day).alias("date"))
    return dated.filter((F.col("date") != "") | (F.col("source") == "archive"))


ADDRESSES = """
SELECT c_custkey,
       CASE c_custkey % 8
         WHEN 0 THEN CAST(c_custkey AS STRING) || ' ' || c_mktsegment || ' ST'
         WHEN 1 THEN CAST(c_custkey AS STRING) || '-' || CAST(c_nationkey AS STRING) || ' ' || c_mktsegment || ' AVE APT 4B'
         WHEN 2 THEN '31ST AVE'
         WHEN 3 THEN CAST(c_custkey AS STRING) || 'A 1/2 ' || c_mktsegment || ' ST, FL 3'
         WHEN 4 THEN NULL
         WHEN 5 THEN c_mktsegment || ' ST BETWEEN ' || CAST(c_nationkey AS STRING) || ' AND '
                     || CAST(c_custkey AS STRING) || ' AVENUES'
         WHEN 6 THEN 'GRAND ' || c_mktsegment || ' AND ' || CAST(c_nationkey AS STRING) || ' AVE'
         ELSE CAST(c_custkey AS STRING) END AS address
FROM {customer}
"""


@check(
    "address_parse",
    f"""
SELECT c_custkey, address,
       CASE k WHEN 0 THEN n WHEN 1 THEN n || '-' || CAST(c_nationkey AS VARCHAR) WHEN 3 THEN n || 'A 1/2'
              WHEN 7 THEN n ELSE '' END AS house,
       CASE k WHEN 0 THEN c_mktsegment || ' ST' WHEN 1 THEN c_mktsegment || ' AVE' WHEN 3 THEN c_mktsegment || ' ST'
              ELSE address END AS street,
       CASE k WHEN 5 THEN c_mktsegment || ' ST' ELSE '' END AS on_street,
       CASE k WHEN 5 THEN CAST(c_nationkey AS VARCHAR) || ' AVENUES' ELSE '' END AS from_street,
       CASE k WHEN 5 THEN n || ' AVENUES' ELSE '' END AS to_street,
       CASE k WHEN 6 THEN 'GRAND ' || c_mktsegment
              WHEN 5 THEN c_mktsegment || ' ST BETWEEN ' || CAST(c_nationkey AS VARCHAR) ELSE '' END AS street_1
FROM (SELECT *, c_custkey % 8 AS k, CAST(c_custkey AS VARCHAR) AS n FROM {{customer}} JOIN ({ADDRESSES}) USING (c_custkey))
""",
)
def address_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    between = stretch("address")
    return shaped(spark, sf_dir, ADDRESSES).select(
        "c_custkey",
        "address",
        house_number("address").alias("house"),
        street_name("address").alias("street"),
        between["street_1"].alias("on_street"),
        between["street_2"].alias("from_street"),
        between["street_3"].alias("to_street"),
        crossing("address")["street_1"].alias("street_1"),
    )


POSITIONS = """
SELECT c_custkey,
       CASE WHEN c_custkey % 9 = 0 THEN 'n/a' WHEN c_custkey % 10 = 0 THEN NULL
            ELSE '-' || CAST(73 + (c_custkey % 64) / 64.0 AS STRING) END AS lon,
       CASE WHEN c_custkey % 11 = 0 THEN '' ELSE CAST(40 + (c_custkey % 32) / 32.0 AS STRING) END AS lat
FROM {customer}
"""


@check(
    "point_wkt",
    f"""
WITH p AS (SELECT c_custkey, TRY_CAST(lon AS DOUBLE) AS x, TRY_CAST(lat AS DOUBLE) AS y FROM ({POSITIONS})),
     w AS (SELECT c_custkey, 'POINT (' || regexp_replace(CAST(x AS VARCHAR), '\\.0$', '') || ' '
                  || regexp_replace(CAST(y AS VARCHAR), '\\.0$', '') || ')' AS wkt FROM p)
SELECT c_custkey, wkt, coalesce('SRID=4326;' || wkt, '') AS ewkt FROM w
""",
)
def point_wkt_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = shaped(spark, sf_dir, POSITIONS).select("c_custkey", point_wkt("lon", "lat").alias("wkt"))
    return points.withColumn("ewkt", ewkt("wkt"))


# A box with a hole and, for every third customer, a second box.
AREAS = """
SELECT c_custkey, x, y, w, h,
  CASE WHEN c_custkey % 3 = 0 THEN
    'MULTIPOLYGON (((' || x0 || ' ' || y0 || ', ' || x1 || ' ' || y0 || ', ' || x1 || ' ' || y1 || ', ' || x0 || ' ' || y1
      || ', ' || x0 || ' ' || y0 || ')), ((100 100, 102 100, 102 102, 100 102, 100 100)))'
  ELSE 'POLYGON ((' || x0 || ' ' || y0 || ', ' || x0 || ' ' || y1 || ', ' || x1 || ' ' || y1 || ', ' || x1 || ' ' || y0
      || ', ' || x0 || ' ' || y0 || '), (' || hx0 || ' ' || hy0 || ', ' || hx1 || ' ' || hy0 || ', ' || hx1 || ' ' || hy1
      || ', ' || hx0 || ' ' || hy1 || ', ' || hx0 || ' ' || hy0 || '))' END AS wkt
FROM (SELECT c_custkey, x, y, w, h, CAST(x AS STRING) AS x0, CAST(x + w AS STRING) AS x1,
             CAST(y AS STRING) AS y0, CAST(y + h AS STRING) AS y1,
             CAST(x + 1 AS STRING) AS hx0, CAST(x + 2 AS STRING) AS hx1,
             CAST(y + 1 AS STRING) AS hy0, CAST(y + 3 AS STRING) AS hy1
      FROM (SELECT c_custkey, CAST(c_custkey % 90 AS INT) AS x, CAST(c_custkey % 70 AS INT) AS y,
                   CAST(4 + c_custkey % 11 AS INT) AS w, CAST(5 + c_custkey % 7 AS INT) AS h FROM {customer}))
"""


@check(
    "polygon_centroid",
    f"""
SELECT c_custkey,
  round(CASE WHEN c_custkey % 3 = 0 THEN (w * h * (x + w / 2.0) + 4 * 101) / (w * h + 4)
             ELSE (w * h * (x + w / 2.0) - 2 * (x + 1.5)) / (w * h - 2) END::DOUBLE, 6) AS lon,
  round(CASE WHEN c_custkey % 3 = 0 THEN (w * h * (y + h / 2.0) + 4 * 101) / (w * h + 4)
             ELSE (w * h * (y + h / 2.0) - 2 * (y + 2)) / (w * h - 2) END::DOUBLE, 6) AS lat
FROM ({AREAS})
""",
)
def polygon_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shaped(spark, sf_dir, AREAS).select("c_custkey", centroid(parse_polygons("wkt")).alias("c"))
    return placed.select("c_custkey", F.round("c.lon", 6).alias("lon"), F.round("c.lat", 6).alias("lat"))


STATE_PLANE = """
SELECT o_orderkey, CAST(920000 + (o_orderkey * 37) % 140000 AS DOUBLE) AS x,
       CAST((o_custkey * 91) % 270000 AS DOUBLE) AS y,
       CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE
         lpad(CAST(920000 + (o_orderkey * 37) % 140000 AS STRING), 7, '0')
         || lpad(CAST((o_custkey * 91) % 270000 AS STRING), 7, '0') END AS packed
FROM {orders}
"""


def _reproject_sql(source: str) -> str:
    """The inverse projection as plain arithmetic, one step a query, from the public numbers of EPSG:2263."""
    axis, flattening, foot, false_easting, origin = 6378137.0, 1 / 298.257222101, 1200 / 3937, 984250.0, -74.0
    south, north, base = (math.radians(d) for d in (40 + 40 / 60, 41 + 2 / 60, 40 + 10 / 60))
    e = math.sqrt(flattening * (2 - flattening))

    def tangent(phi: float) -> float:
        return math.tan(math.pi / 4 - phi / 2) * ((1 + e * math.sin(phi)) / (1 - e * math.sin(phi))) ** (e / 2)

    def radius(phi: float) -> float:
        return math.cos(phi) / math.sqrt(1 - (e * math.sin(phi)) ** 2)

    cone = math.log(radius(south) / radius(north)) / math.log(tangent(south) / tangent(north))
    size = axis * radius(south) / (cone * tangent(south) ** cone)
    steps = "".join(
        f", s{i + 1} AS (SELECT * REPLACE (pi() / 2 - 2 * atan(t * pow((1 - {e!r} * sin(phi)) /"
        f" (1 + {e!r} * sin(phi)), {e / 2!r})) AS phi) FROM s{i})"
        for i in range(6)
    )
    return f"""
a AS (SELECT *, (x - {false_easting!r}) * {foot!r} AS px, {size * tangent(base) ** cone!r} - y * {foot!r} AS py FROM {source}),
b AS (SELECT *, pow(sqrt(px * px + py * py) / {size!r}, {1 / cone!r}) AS t FROM a),
s0 AS (SELECT *, pi() / 2 - 2 * atan(t) AS phi FROM b){steps},
r AS (SELECT *, degrees(atan2(px, py) / {cone!r}) + ({origin!r}) AS lon, degrees(phi) AS lat FROM s6)
"""


@check(
    "reproject",
    f"""
WITH p AS (SELECT * FROM ({STATE_PLANE})), {_reproject_sql("p")}
SELECT o_orderkey, round(lon, 6) AS lon, round(lat, 6) AS lat,
       round(CASE WHEN packed IS NOT NULL THEN lon END, 6) AS packed_lon,
       round(CASE WHEN packed IS NOT NULL THEN lat END, 6) AS packed_lat FROM r
""",
)
def reproject(spark: SparkSession, sf_dir: str) -> DataFrame:
    halves = packed_xy("packed")
    points = shaped(spark, sf_dir, STATE_PLANE).select(
        "o_orderkey", to_lon_lat("x", "y").alias("a"), to_lon_lat(halves["x"], halves["y"]).alias("b")
    )
    return points.select(
        "o_orderkey",
        F.round("a.lon", 6).alias("lon"),
        F.round("a.lat", 6).alias("lat"),
        F.round("b.lon", 6).alias("packed_lon"),
        F.round("b.lat", 6).alias("packed_lat"),
    )


@check(
    "midpoint",
    """
SELECT o_orderkey, (mx + nx) / 2 AS lon, (my + ny) / 2 AS lat,
  'POINT (' || regexp_replace(CAST((mx + nx) / 2 AS VARCHAR), '\\.0$', '') || ' '
  || regexp_replace(CAST((my + ny) / 2 AS VARCHAR), '\\.0$', '') || ')' AS wkt
FROM (SELECT o_orderkey, CAST(o_orderkey % 64 AS DOUBLE) AS mx, CAST(o_custkey % 64 AS DOUBLE) AS my,
             CAST(o_custkey % 31 AS DOUBLE) AS nx, CAST(o_orderkey % 29 AS DOUBLE) AS ny FROM {orders})
""",
)
def midpoint_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    def part(c: str, n: int):
        return (F.col(c) % n).cast("double")

    middle = midpoint(part("o_orderkey", 64), part("o_custkey", 64), part("o_custkey", 31), part("o_orderkey", 29))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", middle.alias("m"))
    return orders.select("o_orderkey", "m.lon", "m.lat", point_wkt_of("m").alias("wkt"))


# Two-segment lines on a quarter grid and boxes with a hole, so that the test
# is exact in both engines.
LINES = """
SELECT o_orderkey, x1, y1, x2, y2, x3, y3 FROM (
  SELECT o_orderkey, (o_orderkey % 400) / 4.0 AS x1, (o_custkey % 400) / 4.0 AS y1,
         (o_orderkey % 400) / 4.0 + ((o_custkey % 9) - 4) / 4.0 AS x2, (o_custkey % 400) / 4.0 + ((o_orderkey % 7) - 3) / 4.0 AS y2,
         (o_orderkey % 400) / 4.0 + ((o_custkey % 5) - 2) / 2.0 AS x3, (o_custkey % 400) / 4.0 + ((o_orderkey % 11) - 5) / 2.0 AS y3
  FROM {orders}) t
"""
BOXES = """
SELECT n_nationkey, CAST((n_nationkey % 5) * 20 + 3 AS DOUBLE) AS box_x, CAST(floor(n_nationkey / 5) * 20 + 2 AS DOUBLE) AS box_y,
       CAST(6 + n_nationkey % 4 AS DOUBLE) AS box_w, CAST(7 + n_nationkey % 3 AS DOUBLE) AS box_h
FROM {nation}
"""


def _meets_box(x1: str, y1: str, x2: str, y2: str, left: str, low: str, right: str, high: str) -> str:
    """A segment meets a closed box: an end in it, or it cuts a diagonal.

    A segment with both ends outside a convex box meets it exactly when the
    bounding boxes overlap and the corners are not all on one side of its line.
    """
    side = [f"({x2} - {x1}) * ({cy} - {y1}) - ({y2} - {y1}) * ({cx} - {x1})" for cx in (left, right) for cy in (low, high)]
    return (
        f"(greatest({x1}, {x2}) >= {left} AND least({x1}, {x2}) <= {right} AND greatest({y1}, {y2}) >= {low}"
        f" AND least({y1}, {y2}) <= {high} AND greatest({', '.join(side)}) >= 0 AND least({', '.join(side)}) <= 0)"
    )


def _strictly_in(x: str, y: str) -> str:
    return f"({x} > box_x + 2 AND {x} < box_x + 4 AND {y} > box_y + 2 AND {y} < box_y + 4)"


# The hole is convex, so a line stays clear of the area around it exactly when
# all its vertices are strictly inside the hole.
MEETS = f"""
({_meets_box("x1", "y1", "x2", "y2", "box_x", "box_y", "box_x + box_w", "box_y + box_h")}
 OR {_meets_box("x2", "y2", "x3", "y3", "box_x", "box_y", "box_x + box_w", "box_y + box_h")})
AND NOT ({_strictly_in("x1", "y1")} AND {_strictly_in("x2", "y2")} AND {_strictly_in("x3", "y3")})
"""


@check(
    "spatial_semi",
    f"""
WITH l AS (SELECT o_orderkey, CAST(x1 AS DOUBLE) AS x1, CAST(y1 AS DOUBLE) AS y1, CAST(x2 AS DOUBLE) AS x2,
                  CAST(y2 AS DOUBLE) AS y2, CAST(x3 AS DOUBLE) AS x3, CAST(y3 AS DOUBLE) AS y3 FROM ({LINES})),
     b AS ({BOXES})
SELECT o_orderkey, x1, y1 FROM l WHERE EXISTS (SELECT 1 FROM b WHERE {MEETS})
""",
)
def spatial_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    def point(x, y):
        return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))

    def box(x, y, w, h):
        return F.array(point(x, y), point(x + w, y), point(x + w, y + h), point(x, y + h), point(x, y))

    lines = shaped(spark, sf_dir, LINES).select(
        "o_orderkey",
        F.col("x1").cast("double").alias("x1"),
        F.col("y1").cast("double").alias("y1"),
        F.array(
            point(F.col("x1"), F.col("y1")), point(F.col("x2"), F.col("y2")), point(F.col("x3"), F.col("y3"))
        ).alias("line"),
    )
    x, y = F.col("box_x"), F.col("box_y")
    shell, hole = box(x, y, F.col("box_w"), F.col("box_h")), box(x + 2, y + 2, F.lit(2.0), F.lit(2.0))
    areas = shaped(spark, sf_dir, BOXES).select(F.array(F.array(shell, hole)).alias("area"))
    found = meets_any(lines, "o_orderkey", F.array("line"), areas, F.col("area"), 2.5)
    return found.drop("line")


@check(
    "first_match_default",
    """
SELECT doc_id, coalesce(CASE WHEN regexp_matches(text, '(?i)chapter|section') THEN 'reference'
       WHEN n_chars > 2000 THEN 'long' WHEN lang = 'de' THEN 'german' END, '') AS kind FROM {documents}
""",
)
def first_match_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [
        (F.col("text").rlike("(?i)chapter|section"), "reference"),
        (F.col("n_chars") > 2000, "long"),
        (F.col("lang") == "de", "german"),
    ]
    return table(spark, sf_dir, "documents").select("doc_id", blank(first_match(rules)).alias("kind"))
