"""Reading back what was written: CSV, a post step before the cast, staging."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from civicflow.checks.registry import check, shaped
from civicflow.sources.publish import publish, publish_after
from civicflow.sources.tables import Staging, read_csv_text, read_versioned, write_csv


def scratch(spark: SparkSession) -> str:
    """A new folder that all executors reach: under the checkpoint folder, or the warehouse where none is set."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/checks-{uuid.uuid4().hex}"


NOTES = """
SELECT CAST(o_orderkey AS STRING) AS id, CASE o_orderkey % 5 WHEN 0 THEN 'say "' || o_orderpriority || '", twice'
         WHEN 1 THEN 'two,' || chr(10) || 'lines' WHEN 2 THEN ' spaced ' WHEN 3 THEN 'é日' ELSE o_orderstatus END AS note,
       CAST(o_totalprice AS STRING) AS price
FROM {orders}
"""


@check("csv_round_trip", f"SELECT id, note, length(note) AS n_chars, TRY_CAST(price AS DOUBLE) AS price FROM ({NOTES})")
def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders written as CSV and read again as text: quotes, commas, line breaks and spaces stay."""
    path = scratch(spark)
    write_csv(shaped(spark, sf_dir, NOTES), path)
    back = read_csv_text(spark, path, ["id", "note", "price"], multi_line=True)
    return back.select("id", "note", F.length("note").cast("bigint").alias("n_chars"), F.col("price").cast("double").alias("price"))


TYPED = """
SELECT CAST(l_orderkey AS STRING) AS l_orderkey, CAST(l_linenumber AS STRING) AS l_linenumber,
       CASE WHEN l_linenumber = 3 THEN '' ELSE CAST(CAST(l_quantity AS INT) AS STRING) END AS quantity,
       CASE WHEN l_returnflag = 'N' THEN '' ELSE l_returnflag END AS flag
FROM {lineitem}
"""


@check(
    "publish_after_post",
    f"""
SELECT CAST(l_orderkey AS BIGINT) AS l_orderkey, CAST(l_linenumber AS INTEGER) AS l_linenumber,
       CAST(quantity || '0' AS INTEGER) AS quantity, flag FROM ({TYPED}) WHERE flag <> 'R'
""",
)
def publish_after_post(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A post step on the untyped columns, where empty text is no NULL, then the cast; read back by its version."""
    base = scratch(spark)
    ddl = "l_orderkey bigint\nl_linenumber integer\nquantity integer\nflag text"

    def post(df: DataFrame) -> DataFrame:
        return df.filter(F.col("flag") != "R").withColumn("quantity", F.concat("quantity", F.lit("0")))

    publish_after(shaped(spark, sf_dir, TYPED), 'lines."2019/09"', base, ddl, post)
    return read_versioned(spark, 'lines."2019/09"', base)


@check(
    "staged_table",
    """
SELECT o_custkey AS customer, count(*) AS n, CAST(max(o_orderkey) AS BIGINT) AS last_order FROM {orders} GROUP BY o_custkey
HAVING count(*) > 1
""",
)
def staged_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums kept in an intermediate table, of which two steps read; the table is gone when the result is read."""
    base = scratch(spark)
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    with Staging(spark, base) as staging:
        sums = orders.groupBy("o_custkey").agg(F.count("*").alias("n"), F.max("o_orderkey").cast("bigint").alias("last_order"))
        kept = staging.keep(sums, "sums")
        several = kept.filter("n > 1").select("o_custkey")
        out = kept.join(several, "o_custkey", "left_semi").withColumnRenamed("o_custkey", "customer")
        publish(out, "customers", base, "customer bigint\nn bigint\nlast_order bigint")
    return read_versioned(spark, "customers", base)
