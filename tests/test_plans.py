"""What the plans of all queries must and must not hold."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from pyspark.sql import types as T

import __spark_entry__ as entry
from civicflow.checks import all_checks, places
from civicflow.checks.registry import shaped
from civicflow.functions.geometry import parse_lines, parse_polygons
from civicflow.operators.dedup import latest_per_key
from civicflow.operators.geocode import geocode, geocode_with_stretch
from civicflow.operators.spatial import edge_cells, meets_any, raster

SF = "/root/testdata/sf0.001"
QUERIES = all_checks()[0]


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_python_and_no_pairwise_join(spark, name):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(QUERIES[name](spark, SF))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    for bad in ["Python", "Pandas", "CartesianProduct", "NestedLoopJoin", "BroadcastHashJoin"]:
        assert bad not in text, f"{name} plans {bad}"
    # One task may only gather sums of one row each, and the first level of the
    # pages' pieces, of which there are 2 * 65,536 at most.
    lines = text.splitlines()
    for above, line in zip(lines, lines[1:]):
        if "SinglePartition" in line and name != "recipe_meeting_urls":
            assert "Aggregate(keys=[]" in above, f"{name} gathers rows in one task: {above}"


def test_latest_per_key_thins_out_before_the_shuffle(spark):
    df = spark.range(10).select((F.col("id") % 2).alias("k"), F.col("id").alias("d"))
    text = plan(latest_per_key(df, [F.col("k")], F.col("d"), []))
    partial = text.index("Partial")
    assert "WindowGroupLimit" in text
    assert text.index("Final") < text.index("Exchange") < partial


def test_group_sums_are_partial_before_the_shuffle(spark):
    for name in ["group_sum_drop_null_key", "pivot_fixed", "recipe_enrolment", "override_by_key"]:
        text = plan(QUERIES[name](spark, SF))
        assert "partial_" in text, name


def test_filters_and_columns_reach_the_scan(spark):
    text = plan(QUERIES["filter_in_list"](spark, SF))
    assert re.search(r"PushedFilters: \[.*In\(l_returnflag", text)
    assert re.search(r"PushedFilters: \[.*In\(p_brand", text)
    schema = re.search(r"ReadSchema: struct<(l_orderkey[^>]*)>", text)[1]
    assert "l_extendedprice" not in schema and "l_returnflag" in schema


def test_single_scan_enrolment_shuffles_once(spark):
    text = plan(QUERIES["recipe_enrolment"](spark, SF))
    assert text.count("Exchange hashpartitioning") == 1


def test_travel_variables_shuffle_once(spark):
    text = plan(QUERIES["recipe_travel_variables"](spark, SF))
    assert text.count("Exchange hashpartitioning") == 1


def _exchanged(node) -> list[set[str]]:
    """The columns that each shuffle of a plan moves."""
    name = node.getClass().getSimpleName()
    if name == "AdaptiveSparkPlanExec":
        return _exchanged(node.executedPlan())
    out = [{node.output().apply(i).name() for i in range(node.output().size())}] if name == "ShuffleExchangeExec" else []
    for i in range(node.children().size()):
        out += _exchanged(node.children().apply(i))
    return out


def test_a_lookup_moves_the_rows_once(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        books = {k: shaped(spark, SF, sql) for k, sql in (("points", places.ADDRESS_POINTS), ("crossings", places.CROSSINGS))}
        more = {"segments": shaped(spark, SF, places.SEGMENTS), "nodes": shaped(spark, SF, places.NODES)}
        asked = spark.read.parquet(f"{SF}/orders.parquet").select(
            F.col("o_custkey").cast("string").alias("hnum"),
            F.col("o_orderpriority").alias("sname"),
            F.lit("Queens").alias("borough"),
            F.col("o_orderstatus").alias("streetname_1"),
            F.col("o_orderpriority").alias("streetname_2"),
            F.concat("o_orderstatus", F.lit(" ST AND "), "o_orderpriority").alias("address"),
            F.col("o_totalprice").alias("payload"),
        )
        cascade = geocode(asked, **books, house="hnum", street="sname", area="borough")
        stretched = geocode_with_stretch(asked, **books, **more)
        for df in (cascade, stretched):
            moved = _exchanged(df._jdf.queryExecution().executedPlan())
            assert sum("payload" in columns for columns in moved) == 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_no_row_of_an_area_holds_an_outline(spark):
    areas = spark.createDataFrame([("POLYGON ((0 0, 9 0, 9 9, 0 0))",)], "g string")
    cells = raster(edge_cells(areas, parse_polygons("g"), 1.0))
    assert all(not isinstance(f.dataType, T.ArrayType) for f in cells.schema.fields)
    points = ", ".join(f"{k * 0.01} {(k % 7) * 0.001}" for k in range(50_000))
    back = ", ".join(f"{(49_999 - k) * 0.01} {5 + (k % 5) * 0.001}" for k in range(50_000))
    outline = spark.createDataFrame([(f"POLYGON (({points}, {back}, 0 0))",)], "g string")
    lines = spark.createDataFrame([(k, f"LINESTRING ({k} {y}, {k + 0.5} {y})") for k, y in enumerate((2, 6, -1, 4.99, 5.002, 0.0005))], "id int, g string")
    met = meets_any(lines, "id", parse_lines("g"), outline, parse_polygons("g"), 0.5)
    assert sorted(r.id for r in met.collect()) == [0, 3, 4, 5]
