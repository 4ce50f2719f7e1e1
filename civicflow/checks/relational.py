"""Checks of scans, filters, joins, unions, aggregates and deduplication."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from civicflow.checks.registry import check, shaped, table
from civicflow.functions.numbers import truncated
from civicflow.functions.text import blank, sentinel_to_null
from civicflow.operators.dedup import adjacent_runs_best, latest_per_key
from civicflow.operators.relate import (
    differs,
    distinct_ids,
    exists_flag,
    full_outer,
    join_hot_key,
    known_or_blank,
    lookup_left,
    not_in,
    null_safe_left,
    override_by_key,
    semi_join,
    union_missing,
)
from civicflow.operators.reshape import (
    group_sum,
    pivot_single,
    pivot_sum,
    root_sum_squares,
    share,
    total,
    unpivot,
    unpivot_structs,
)
from civicflow.sources.publish import conform
from civicflow.sources.tables import select_renamed

LINES_AS_TEXT = """
SELECT CAST(l_orderkey AS STRING) AS l_orderkey,
       CASE WHEN l_linenumber = 1 THEN '' ELSE CAST(l_linenumber AS STRING) END AS l_linenumber,
       CASE WHEN l_returnflag = 'N' THEN '' ELSE l_returnflag END AS l_returnflag,
       CASE l_linenumber % 5 WHEN 0 THEN 'Yes' WHEN 1 THEN 'off' WHEN 2 THEN 't'
            WHEN 3 THEN '' ELSE 'maybe' END AS flagged,
       CASE WHEN l_linenumber = 2 THEN 'n/a' ELSE CAST(l_quantity AS STRING) END AS l_quantity,
       CAST(month(l_shipdate) AS STRING) || '/' || CAST(day(l_shipdate) AS STRING) || '/'
         || CAST(year(l_shipdate) AS STRING) AS l_shipdate,
       l_tax
FROM {lineitem}
"""


@check(
    "scan_conform",
    f"""
WITH t AS ({LINES_AS_TEXT})
SELECT CAST(l_orderkey AS BIGINT) AS orderkey,
       CAST(nullif(l_linenumber, '') AS INTEGER) AS line,
       nullif(l_returnflag, '') AS "return.flag",
       CASE WHEN flagged IN ('Yes', 't') THEN TRUE WHEN flagged = 'off' THEN FALSE END AS flagged,
       TRY_CAST(l_quantity AS DOUBLE) AS quantity,
       CAST(strptime(l_shipdate, '%m/%d/%Y') AS DATE) AS shipped,
       'plan' AS source,
       CAST(NULL AS VARCHAR) AS remark
FROM t
""",
)
def scan_conform(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = {
        "l_orderkey": "orderkey",
        "l_linenumber": "line",
        "l_returnflag": "return.flag",
        "flagged": "flagged",
        "l_quantity": "quantity",
        "l_shipdate": "shipped",
    }
    lines = select_renamed(shaped(spark, sf_dir, LINES_AS_TEXT), names)
    lines = lines.withColumn("source", F.lit("plan")).withColumn("remark", F.lit(None))
    return conform(
        lines,
        """
        orderkey bigint
        line integer
        return.flag text
        flagged boolean
        quantity double precision
        shipped date
        source text
        remark text
        """,
    )


@check(
    "filter_three_valued",
    """
SELECT o_orderkey, o_orderstatus, o_orderpriority FROM (
  SELECT o_orderkey, nullif(o_orderstatus, 'P') AS o_orderstatus,
         nullif(o_orderpriority, '3-MEDIUM') AS o_orderpriority FROM {orders})
WHERE left(o_orderpriority, 1) != '5'
  AND NOT (left(o_orderpriority, 1) = '1' AND (o_orderstatus = 'F' OR o_orderstatus = 'X'))
""",
)
def filter_three_valued(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey",
        sentinel_to_null("o_orderstatus", "P").alias("o_orderstatus"),
        sentinel_to_null("o_orderpriority", "3-MEDIUM").alias("o_orderpriority"),
    )
    kind, status = F.left("o_orderpriority", F.lit(1)), F.col("o_orderstatus")
    return orders.filter((kind != "5") & ~((kind == "1") & ((status == "F") | (status == "X"))))


@check(
    "filter_in_list",
    """
SELECT l_orderkey, l_linenumber, l_quantity, p_brand FROM {lineitem} JOIN {part} ON l_partkey = p_partkey
WHERE p_brand IN ('Brand#1', 'Brand#5', 'Brand#12') AND l_returnflag IN ('A', 'R')
""",
)
def filter_in_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").filter(F.col("p_brand").isin("Brand#1", "Brand#5", "Brand#12"))
    lines = table(spark, sf_dir, "lineitem").filter(F.col("l_returnflag").isin("A", "R"))
    joined = lines.join(parts, F.col("l_partkey") == F.col("p_partkey"))
    return joined.select("l_orderkey", "l_linenumber", "l_quantity", "p_brand")


@check(
    "filter_regex",
    """
SELECT p_partkey, p_name FROM {part}
WHERE (regexp_matches(p_name, '(?i)WIDGET') OR regexp_matches(p_name, '(?i)^new '))
  AND NOT regexp_matches(p_name, '(?i)BLUE') AND contains(p_type, 'A')
""",
)
def filter_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.col("p_name")
    parts = table(spark, sf_dir, "part").filter(
        (name.rlike("(?i)WIDGET") | name.rlike("(?i)^new ")) & ~name.rlike("(?i)BLUE") & F.col("p_type").contains("A")
    )
    return parts.select("p_partkey", "p_name")


@check(
    "filter_null_tolerant",
    """
SELECT o_orderkey, c_mktsegment FROM {orders}
LEFT JOIN (SELECT CASE WHEN c_acctbal > 0 THEN c_custkey END AS k, c_mktsegment FROM {customer}) ON o_custkey = k
WHERE c_mktsegment IS DISTINCT FROM 'BUILDING' AND o_orderstatus IS NOT NULL
""",
)
def filter_null_tolerant(spark: SparkSession, sf_dir: str) -> DataFrame:
    owing = table(spark, sf_dir, "customer").select(
        F.expr("CASE WHEN c_acctbal > 0 THEN c_custkey END").alias("o_custkey"), "c_mktsegment"
    )
    joined = lookup_left(table(spark, sf_dir, "orders"), owing, "o_custkey")
    kept = joined.filter(differs(F.col("c_mktsegment"), "BUILDING") & F.col("o_orderstatus").isNotNull())
    return kept.select("o_orderkey", "c_mktsegment")


PLACED_CUSTOMERS = """
SELECT c_custkey,
       CASE WHEN c_custkey % 11 = 0 THEN '' WHEN c_custkey % 13 = 0 THEN NULL
            ELSE 'NATION_' || CAST(c_nationkey AS STRING) END AS city,
       CASE WHEN c_custkey % 17 = 0 THEN '' WHEN c_custkey % 19 = 0 THEN NULL
            ELSE CAST(c_custkey % 997 AS STRING) END AS zip
FROM {customer}
"""


@check(
    "existence_or_filter",
    f"""
WITH c AS ({PLACED_CUSTOMERS})
SELECT c_custkey, city, zip FROM c
WHERE city IN (SELECT CASE WHEN n_regionkey = 1 THEN n_name ELSE 'not ' || n_name END FROM {{nation}})
   OR zip IN (SELECT CAST(CASE WHEN s_acctbal > 5000 THEN s_suppkey ELSE -s_suppkey END AS VARCHAR) FROM {{supplier}})
   OR city = '' OR zip = ''
""",
)
def existence_or_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    cities = table(spark, sf_dir, "nation").select(
        F.expr("CASE WHEN n_regionkey = 1 THEN n_name ELSE 'not ' || n_name END").alias("n_name")
    )
    zips = table(spark, sf_dir, "supplier").select(
        F.expr("CAST(CASE WHEN s_acctbal > 5000 THEN s_suppkey ELSE -s_suppkey END AS STRING)").alias("zip")
    )
    customers = shaped(spark, sf_dir, PLACED_CUSTOMERS)
    return known_or_blank(customers, [("city", cities, "n_name"), ("zip", zips, "zip")])


@check(
    "join_inner_multi",
    """
WITH a AS (SELECT o_custkey AS custkey, year(o_orderdate) AS yr, count(*) AS n_orders
           FROM {orders} GROUP BY 1, 2),
     b AS (SELECT o_custkey AS custkey, year(l_shipdate) AS yr, CAST(sum(l_quantity) AS BIGINT) AS qty
           FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey GROUP BY 1, 2)
SELECT custkey, CAST(yr AS INTEGER) AS yr, n_orders, qty FROM a JOIN b USING (custkey, yr)
""",
)
def join_inner_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("custkey"), "o_orderdate")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity", "l_shipdate")
    placed = orders.groupBy("custkey", F.year("o_orderdate").alias("yr")).agg(F.count("*").alias("n_orders"))
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    shipped = joined.groupBy("custkey", F.year("l_shipdate").alias("yr")).agg(
        F.sum("l_quantity").cast("bigint").alias("qty")
    )
    return placed.join(shipped, ["custkey", "yr"]).select("custkey", "yr", "n_orders", "qty")


@check(
    "join_left_lookup",
    """
SELECT c_custkey, n_name, r_name, s_suppkey FROM {customer}
LEFT JOIN {nation} ON c_nationkey = n_nationkey
LEFT JOIN (SELECT CASE WHEN r_name <> 'ASIA' THEN r_regionkey END AS k, r_name FROM {region}) ON n_regionkey = k
LEFT JOIN {supplier} ON c_nationkey % 2 = s_nationkey % 2 AND c_custkey = s_suppkey // 3
""",
)
def join_left_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = table(spark, sf_dir, "nation").withColumnRenamed("n_nationkey", "c_nationkey")
    regions = table(spark, sf_dir, "region").select(
        F.expr("CASE WHEN r_name <> 'ASIA' THEN r_regionkey END").alias("n_regionkey"), "r_name"
    )
    # Up to three suppliers share a key, so some customers come several times.
    suppliers = table(spark, sf_dir, "supplier").select(
        "s_suppkey", F.expr("s_suppkey div 3").alias("c_custkey"), (F.col("s_nationkey") % 2).alias("side")
    )
    out = lookup_left(table(spark, sf_dir, "customer"), nations, "c_nationkey")
    out = lookup_left(out, regions, "n_regionkey").withColumn("side", F.col("c_nationkey") % 2)
    out = lookup_left(out, suppliers, ["c_custkey", "side"])
    return out.select("c_custkey", "n_name", "r_name", "s_suppkey")


NULLED_ORDERS = """
SELECT o_orderkey, nullif(o_orderstatus, 'P') AS status,
       CASE WHEN o_custkey % 7 = 0 THEN NULL ELSE o_custkey % 50 END AS grp,
       nullif(o_orderpriority, '5-LOW') AS priority
FROM {orders}
"""


@check(
    "join_null_safe",
    f"""
WITH o AS ({NULLED_ORDERS}),
     s AS (SELECT status, grp, CASE WHEN n % 2 = 0 THEN priority ELSE 'odd' END AS priority, n
           FROM (SELECT status, grp, priority, count(*) AS n FROM o GROUP BY 1, 2, 3))
SELECT o.o_orderkey, s.n FROM o LEFT JOIN s
  ON o.status IS NOT DISTINCT FROM s.status AND o.grp IS NOT DISTINCT FROM s.grp
 AND o.priority IS NOT DISTINCT FROM s.priority
""",
)
def join_null_safe(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = ["status", "grp", "priority"]
    orders = shaped(spark, sf_dir, NULLED_ORDERS)
    sums = orders.groupBy(*keys).agg(F.count("*").alias("n"))
    sums = sums.withColumn("priority", F.when(F.col("n") % 2 == 0, F.col("priority")).otherwise("odd"))
    return null_safe_left(orders, sums, keys).select("o_orderkey", "n")


@check(
    "join_full_outer",
    """
WITH c AS (SELECT CASE WHEN c_acctbal > 2000 THEN c_custkey ELSE -c_custkey END AS custkey, c_name FROM {customer}),
     o AS (SELECT CASE WHEN o_orderstatus = 'F' THEN o_custkey ELSE 1000000000000 + o_custkey END AS custkey,
                  count(*) AS n_orders FROM {orders} GROUP BY 1)
SELECT custkey, c_name, n_orders FROM c FULL JOIN o USING (custkey)
""",
)
def join_full_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").select(
        F.expr("CASE WHEN c_acctbal > 2000 THEN c_custkey ELSE -c_custkey END").alias("custkey"), "c_name"
    )
    key = F.expr("CASE WHEN o_orderstatus = 'F' THEN o_custkey ELSE 1000000000000 + o_custkey END")
    counts = table(spark, sf_dir, "orders").groupBy(key.alias("custkey")).agg(F.count("*").alias("n_orders"))
    return full_outer(customers, counts, ["custkey"])


@check(
    "not_in_null_aware",
    """
WITH c AS (SELECT CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE c_custkey END AS k, c_custkey FROM {customer})
SELECT c_custkey, 'no null' AS right_side, k NOT IN (SELECT CASE WHEN o_orderstatus = 'F' THEN o_custkey ELSE -o_custkey END FROM {orders}) AS absent FROM c
UNION ALL
SELECT c_custkey, 'with null', k NOT IN (SELECT nullif(o_custkey, 1) FROM {orders}) FROM c
UNION ALL
SELECT c_custkey, 'empty', k NOT IN (SELECT o_custkey FROM {orders} WHERE o_orderstatus = 'none') FROM c
""",
)
def not_in_null_aware(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").select(
        "c_custkey", F.when(F.col("c_custkey") % 10 != 0, F.col("c_custkey")).alias("k")
    )
    orders = table(spark, sf_dir, "orders")
    sides = {
        "no null": (orders, F.expr("CASE WHEN o_orderstatus = 'F' THEN o_custkey ELSE -o_custkey END")),
        "with null": (orders, F.nullif(F.col("o_custkey"), F.lit(1))),
        "empty": (orders.filter("o_orderstatus = 'none'"), F.col("o_custkey")),
    }
    parts = [
        not_in(customers, F.col("k"), right, key, "absent").select("c_custkey", F.lit(name).alias("right_side"), "absent")
        for name, (right, key) in sides.items()
    ]
    return union_missing(*parts)


@check(
    "semi_concat_key",
    """
SELECT p_partkey, p_size,
       CAST(p_partkey AS VARCHAR) || CAST(p_size AS VARCHAR) IN
         (SELECT CAST(l_suppkey AS VARCHAR) || CAST(l_linenumber AS VARCHAR) FROM {lineitem}) AS beside
FROM {part}
WHERE CAST(p_partkey AS VARCHAR) || CAST(p_size AS VARCHAR) IN
  (SELECT CAST(l_orderkey AS VARCHAR) || CAST(l_linenumber AS VARCHAR) FROM {lineitem})
""",
)
def semi_concat_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    def key(a: str, b: str):
        return F.concat(F.col(a).cast("string"), F.col(b).cast("string"))

    parts, lines = table(spark, sf_dir, "part"), table(spark, sf_dir, "lineitem")
    kept = semi_join(parts, key("p_partkey", "p_size"), lines, key("l_orderkey", "l_linenumber"))
    flagged = exists_flag(kept, key("p_partkey", "p_size"), lines, key("l_suppkey", "l_linenumber"), "beside")
    return flagged.select("p_partkey", "p_size", "beside")


@check(
    "override_by_key",
    """
WITH fix AS (SELECT CASE WHEN o_orderstatus = 'F' THEN o_custkey ELSE -o_custkey END AS o_custkey,
                    max(o_orderkey) AS last_key FROM {orders} GROUP BY 1),
     last AS (SELECT f.o_custkey, nullif(o.o_orderpriority, '1-URGENT') AS priority
              FROM fix f JOIN {orders} o ON o.o_orderkey = f.last_key)
SELECT c_custkey, CASE WHEN o_custkey IS NOT NULL THEN priority ELSE c_mktsegment END AS c_mktsegment
FROM {customer} LEFT JOIN last ON c_custkey = o_custkey
""",
)
def override_by_key_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.expr("CASE WHEN o_orderstatus = 'F' THEN o_custkey ELSE -o_custkey END")
    corrections = table(spark, sf_dir, "orders").withColumn("o_custkey", key)
    value = F.nullif(F.col("o_orderpriority"), F.lit("1-URGENT"))
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return override_by_key(
        customers, "c_custkey", "c_mktsegment", corrections, "o_custkey", value, F.col("o_orderkey")
    )


@check(
    "union_by_name_missing",
    """
SELECT c_custkey AS id, c_name AS name, c_mktsegment AS segment, CAST(NULL AS DOUBLE) AS balance, 'customer' AS plan
FROM {customer}
UNION ALL
SELECT s_suppkey, s_name, NULL, s_acctbal, 'supplier' FROM {supplier}
""",
)
def union_by_name_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = select_renamed(
        table(spark, sf_dir, "customer"), {"c_custkey": "id", "c_name": "name", "c_mktsegment": "segment"}
    )
    suppliers = select_renamed(
        table(spark, sf_dir, "supplier"), {"s_suppkey": "id", "s_name": "name", "s_acctbal": "balance"}
    )
    return union_missing(
        customers.withColumn("plan", F.lit("customer")), suppliers.withColumn("plan", F.lit("supplier"))
    )


@check(
    "union_distinct_ids",
    "SELECT l_partkey AS id FROM {lineitem} UNION SELECT l_suppkey FROM {lineitem}",
)
def union_distinct_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distinct_ids(table(spark, sf_dir, "lineitem"), ["l_partkey", "l_suppkey"], "id")


@check(
    "group_sum_drop_null_key",
    """
SELECT flag, CAST(yr AS INTEGER) AS yr, round(sum(l_quantity), 2) AS l_quantity,
       round(sum(l_extendedprice), 2) AS l_extendedprice
FROM (SELECT nullif(l_returnflag, 'N') AS flag, year(l_shipdate) AS yr, l_quantity, l_extendedprice FROM {lineitem})
WHERE flag IS NOT NULL GROUP BY 1, 2
""",
)
def group_sum_drop_null_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(
        sentinel_to_null("l_returnflag", "N").alias("flag"),
        F.year("l_shipdate").alias("yr"),
        "l_quantity",
        "l_extendedprice",
    )
    sums = group_sum(lines, ["flag", "yr"], ["l_quantity", "l_extendedprice"])
    return sums.withColumns({c: F.round(c, 2) for c in ["l_quantity", "l_extendedprice"]})


@check(
    "latest_per_key",
    """
SELECT custkey, o_orderkey, CAST(o_orderdate AS DATE) AS latest, o_orderstatus FROM (
  SELECT *, row_number() OVER (PARTITION BY custkey ORDER BY day DESC NULLS LAST, o_orderkey) AS rn FROM (
    SELECT *, nullif(o_custkey, 1) AS custkey,
           CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderdate END AS day FROM {orders}))
WHERE rn = 1
""",
)
def latest_per_key_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").withColumn("custkey", F.nullif(F.col("o_custkey"), F.lit(1)))
    day = F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate"))
    newest = latest_per_key(orders, [F.col("custkey")], day, [F.col("o_orderkey")])
    return newest.select("custkey", "o_orderkey", F.col("o_orderdate").cast("date").alias("latest"), "o_orderstatus")


# Half of the lines, and most of the orders, have one and the same key.
HOT_LINES = """
SELECT l_orderkey, l_linenumber, l_quantity,
       CASE WHEN l_orderkey % 2 = 0 THEN CAST(7 AS BIGINT) WHEN l_orderkey % 9 = 0 THEN NULL ELSE l_partkey END AS k
FROM {lineitem}
"""
HOT_PARTS = """
SELECT CASE WHEN p_partkey <= 10 THEN CAST(7 AS BIGINT) WHEN p_partkey = 12 THEN NULL ELSE CAST(p_partkey AS BIGINT) END AS k, p_size, p_partkey
FROM {part}
"""


@check(
    "join_hot_key",
    f"""
SELECT l_orderkey, l_linenumber, count(p_partkey) AS parts, CAST(sum(p_size) AS BIGINT) AS sizes
FROM ({HOT_LINES}) l LEFT JOIN ({HOT_PARTS}) p ON l.k = p.k GROUP BY ALL
""",
)
def join_hot_key_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = join_hot_key(shaped(spark, sf_dir, HOT_LINES), shaped(spark, sf_dir, HOT_PARTS), ["k"], "left")
    sums = joined.groupBy("l_orderkey", "l_linenumber")
    return sums.agg(F.count("p_partkey").alias("parts"), F.sum("p_size").alias("sizes"))


@check(
    "adjacent_runs_argmin",
    """
WITH a AS (SELECT user_id, event_id, event_type, value, ts,
                  CASE WHEN lag(event_type) OVER w = event_type THEN 0 ELSE 1 END AS start
           FROM {events} WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
     b AS (SELECT *, sum(start) OVER (PARTITION BY user_id ORDER BY ts, event_id
                                      ROWS UNBOUNDED PRECEDING) AS run FROM a),
     c AS (SELECT *, row_number() OVER (PARTITION BY user_id, run ORDER BY value, ts, event_id) AS rn FROM b)
SELECT user_id, event_id, event_type, value FROM c WHERE rn = 1
""",
)
def adjacent_runs_argmin(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value", "ts")
    best = adjacent_runs_best(
        events,
        ["user_id"],
        [F.date_trunc("day", "ts"), F.date_trunc("minute", "ts")],
        ["ts", "event_id"],
        F.col("event_type"),
        F.col("value"),
    )
    return best.drop("ts")


@check(
    "share_metric",
    "SELECT count(*) FILTER (WHERE l_discount > 0.05) / count(*) AS discounted FROM {lineitem}",
)
def share_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    return share(table(spark, sf_dir, "lineitem"), F.col("l_discount") > 0.05, "discounted")


EVENT_TYPES = ["view", "click", "signup", "error", "purchase"]

# One row for each user, day and type, so that the pivot has single values.
DAILY = """
SELECT user_id, day(ts) AS dy, event_type, CAST(count(*) AS DOUBLE) AS n,
       CAST(max(CAST(event_id % 100 AS INT)) AS DOUBLE) AS err
FROM {events} GROUP BY user_id, day(ts), event_type
"""


@check(
    "pivot_fixed",
    f"""
WITH d AS ({DAILY})
SELECT user_id, CAST(dy AS INTEGER) AS dy,
       {", ".join(f"coalesce(max(n) FILTER (event_type = '{t}'), 0) AS {t}_n" for t in EVENT_TYPES)},
       {", ".join(f"coalesce(sum(err) FILTER (event_type = '{t}'), 0) AS {t}_sum" for t in EVENT_TYPES)}
FROM d GROUP BY 1, 2
""",
)
def pivot_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = shaped(spark, sf_dir, DAILY)
    keys = ["user_id", "dy"]
    single = pivot_single(daily, keys, "event_type", EVENT_TYPES, {"n": F.col("n")})
    sums = pivot_sum(daily, keys, "event_type", {t: f"{t}_sum" for t in EVENT_TYPES}, F.col("err"))
    single = single.select(*keys, *[F.col(f"{t}.n").alias(f"{t}_n") for t in EVENT_TYPES])
    return single.join(sums, keys)


@check(
    "unpivot_long",
    f"""
WITH u AS (SELECT DISTINCT user_id FROM {{events}}),
     t AS (SELECT unnest([{", ".join(f"'{t}'" for t in EVENT_TYPES)}, 'login']) AS event_type),
     s AS (SELECT user_id, event_type, count(*) AS n FROM {{events}} GROUP BY 1, 2)
SELECT user_id, event_type, coalesce(n, 0) AS n FROM u CROSS JOIN t LEFT JOIN s USING (user_id, event_type)
""",
)
def unpivot_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = [*EVENT_TYPES, "login"]
    wide = pivot_sum(table(spark, sf_dir, "events"), ["user_id"], "event_type", {t: t for t in kinds}, F.lit(1))
    return unpivot(wide, ["user_id"], kinds, "event_type", "n")


ROLLUPS = {"active_total": ["click", "purchase", "signup"], "all_total": EVENT_TYPES}


@check(
    "rollup_sum_rss",
    f"""
WITH d AS ({DAILY}),
     w AS (SELECT user_id, dy, unnest([{", ".join(f"'{t}'" for t in [*EVENT_TYPES, *ROLLUPS])}]) AS variable
           FROM (SELECT DISTINCT user_id, dy FROM d)),
     g AS (SELECT event_type, event_type AS variable FROM (SELECT DISTINCT event_type FROM d)
           UNION ALL SELECT unnest(['click', 'purchase', 'signup']), 'active_total'
           UNION ALL SELECT DISTINCT event_type, 'all_total' FROM d)
SELECT w.user_id, CAST(w.dy AS INTEGER) AS dy, w.variable,
       CAST(coalesce(sum(n), 0) AS INTEGER) AS n,
       CAST(trunc(coalesce(sqrt(sum(err * err)), 0)) AS INTEGER) AS err
FROM w LEFT JOIN g USING (variable)
       LEFT JOIN d ON d.user_id = w.user_id AND d.dy = w.dy AND d.event_type = g.event_type
GROUP BY 1, 2, 3
""",
)
def rollup_sum_rss(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys, values = ["user_id", "dy"], {"n": F.col("n"), "err": F.col("err")}
    wide = pivot_single(shaped(spark, sf_dir, DAILY), keys, "event_type", EVENT_TYPES, values)
    for name, kinds in ROLLUPS.items():
        sums = total([F.col(f"{t}.n") for t in kinds]).alias("n")
        errors = root_sum_squares([F.col(f"{t}.err") for t in kinds]).alias("err")
        wide = wide.withColumn(name, F.struct(sums, errors))
    long = unpivot_structs(wide, keys, [*EVENT_TYPES, *ROLLUPS], "variable", ["n", "err"])
    return long.withColumn("n", truncated("n")).withColumn("err", truncated("err"))


@check(
    "reconcile_tables",
    """
WITH a AS (SELECT l_orderkey AS k, nullif(l_returnflag, 'N') AS flag FROM {lineitem}),
     b AS (SELECT CASE WHEN o_orderstatus <> 'P' THEN o_orderkey ELSE -o_orderkey END AS k FROM {orders})
SELECT a.k, flag, CASE WHEN a.k IN (SELECT k FROM b) THEN '' ELSE 'not in orders' END AS match
FROM a WHERE flag IS NOT NULL
""",
)
def reconcile_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("k"), sentinel_to_null("l_returnflag", "N").alias("flag")
    )
    orders = table(spark, sf_dir, "orders")
    key = F.expr("CASE WHEN o_orderstatus <> 'P' THEN o_orderkey ELSE -o_orderkey END")
    tagged = not_in(lines.dropna(subset=["flag"]), F.col("k"), orders, key, "absent")
    return tagged.select("k", "flag", blank(F.when(F.col("absent"), F.lit("not in orders"))).alias("match"))
