"""Versions, CSV, schema-enforced publishing and staging."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from civicflow.plans.job import JobSpec
from civicflow.sources.publish import conform, parse_ddl, publish, publish_after, split_by
from civicflow.sources.tables import DatasetRef, Staging, read_csv_text, read_versioned, select_renamed, write_csv


def test_version_names(tmp_path):
    assert DatasetRef.parse('centroids."2019/09/17"') == DatasetRef("centroids", "2019/09/17")
    assert DatasetRef.parse("permits.latest").path("/base/") == "/base/permits/latest"
    assert DatasetRef("a", "2019/09/17").path("/b") == "/b/a/2019__09__17"


def test_publish_keeps_declared_columns_in_order(spark, tmp_path):
    df = spark.createDataFrame(
        [("1", "", "yes", "9/1/2018", "x", "POINT (1 2)"), ("1.5", "t", "off", "2018-09-01 10:00:00+00", "y", "")],
        "n string, `pm_2.5` string, flag string, day string, extra string, geom string",
    )
    ddl = "geom geometry(Point,4326)\nday date\npm_2.5 text\nn integer\nflag boolean"
    publish(df, 'out."2019/09"', str(tmp_path), ddl)
    back = read_versioned(spark, 'out."2019/09"', str(tmp_path))
    assert back.columns == ["geom", "day", "pm_2.5", "n", "flag"]
    day = dt.date(2018, 9, 1)
    assert {tuple(r) for r in back.collect()} == {
        ("SRID=4326;POINT (1 2)", day, None, 1, True),
        (None, day, "t", None, False),
    }


def test_publish_rebuilds(spark, tmp_path):
    for n in (3, 2):
        publish(spark.range(n), "t.latest", str(tmp_path), "id bigint")
    assert read_versioned(spark, "t.latest", str(tmp_path)).count() == 2


def test_missing_declared_column_is_an_error(spark):
    with pytest.raises(ValueError, match="other"):
        conform(spark.range(1), "id bigint\nother text")


def test_post_step_before_the_cast_keeps_empty_text(spark, tmp_path):
    df = spark.createDataFrame([("1", ""), ("", "b")], "n string, s string")
    post = lambda d: d.withColumn("n", F.concat("n", F.lit("0")))
    publish_after(df, "t", str(tmp_path), "n integer\ns text", post)
    assert {tuple(r) for r in read_versioned(spark, "t", str(tmp_path)).collect()} == {(10, ""), (0, "b")}


def test_wide_declarations_parse():
    assert parse_ddl("shape.stlength() double precision\ngeom geometry(Point,4326)") == {
        "shape.stlength()": "double precision",
        "geom": "geometry",
    }


def test_split_keeps_every_row(spark):
    df = spark.createDataFrame([(1, True), (2, False), (3, None)], "i int, ok boolean")
    accepted, rejected = split_by(df, F.col("ok"))
    assert [r.i for r in accepted.collect()] == [1]
    assert sorted(r.i for r in rejected.collect()) == [2, 3]


def test_csv_is_text_with_quotes(spark, tmp_path):
    df = spark.createDataFrame([("1", 'say "hi", you'), ("2", "two\nlines")], "id string, t string")
    path = str(tmp_path / "c")
    write_csv(df, path)
    assert sorted(read_csv_text(spark, path, multi_line=True).collect()) == sorted(df.collect())
    assert sorted(read_csv_text(spark, path, ["id", "t"], multi_line=True).collect()) == sorted(df.collect())


def test_csv_lines_keep_their_order(spark, tmp_path):
    (tmp_path / "c.csv").write_text("school,address\nA,one\nB,x\nA,two\n")
    rows = read_csv_text(spark, str(tmp_path / "c.csv"), line="line").orderBy("line").collect()
    assert [r.address for r in rows] == ["one", "x", "two"]


def test_csv_lines_go_by_file_then_place(spark, tmp_path):
    for name, lines in (("b", 3), ("a", 4000)):
        (tmp_path / f"{name}.csv").write_text("n\n" + "".join(f"{name}{k:05}\n" for k in range(lines)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    try:
        df = read_csv_text(spark, str(tmp_path / "*.csv"), ["n"], line="line")
        assert df.rdd.getNumPartitions() > 3
        names = [r.n for r in df.orderBy("line").collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert names == sorted(names)


def test_values_their_type_cannot_hold_are_counted(spark, tmp_path):
    df = spark.createDataFrame([("1", "x", " "), ("12345678901", "y", "no date"), ("n/a", None, "9/1/2018")], "a string, b string, c string")
    lost: dict[str, int] = {}
    publish(df, "t.latest", str(tmp_path), "a integer\nb text\nc date", unreadable=lost)
    assert lost == {"a": 2, "c": 1}


def test_version_of_a_catalog_table(spark):
    spark.sql("CREATE SCHEMA IF NOT EXISTS flows_test")
    spark.sql("DROP TABLE IF EXISTS flows_test.`2019__09`")
    spark.range(3).write.saveAsTable("flows_test.`2019__09`")
    try:
        assert read_versioned(spark, 'flows_test."2019/09"').count() == 3
    finally:
        spark.sql("DROP SCHEMA flows_test CASCADE")


def test_renamed_selection_prunes_the_scan(spark, tmp_path):
    spark.sql("SELECT 1 AS `totwork_16+`, 2 AS b, 3 AS c").write.parquet(str(tmp_path / "p"))
    df = select_renamed(spark.read.parquet(str(tmp_path / "p")), {"totwork_16+": "count"})
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert df.first().asDict() == {"count": 1}
    assert "ReadSchema: struct<totwork_16+:int>" in plan


def test_staged_frame_is_written_read_back_and_removed(spark, tmp_path):
    with Staging(spark, str(tmp_path)) as staging:
        out = staging.keep(spark.range(5).select(F.col("id"), F.lit(None).cast("string").alias("s")), "x")
        assert out.count() == 5 and out.columns == ["id", "s"]
        assert "FileScan parquet" in out._jdf.queryExecution().executedPlan().toString()
    assert list(tmp_path.iterdir()) == []


def test_outputs_become_visible_together(spark, tmp_path):
    bad = F.raise_error(F.lit("stop")).cast("bigint")

    def build(inputs):
        ids = inputs["numbers"]
        return {"small": ids.filter("id < 5"), "large": ids.filter("id >= 5").select(F.when(F.col("id") < 90, F.col("id")).otherwise(bad).alias("id"))}

    job = JobSpec("sizes", ["numbers"], {"small": "id bigint", "large": "id bigint"}, build)
    base = str(tmp_path / "out")

    def counts():
        return [read_versioned(spark, name, base).count() for name in ("small", "large")]

    def run(n):
        publish(spark.range(n), "numbers", str(tmp_path / "in"), "id bigint")
        return job.publish(spark, str(tmp_path / "in"), base)

    first = run(8)
    assert counts() == [5, 3]
    held = read_versioned(spark, "large", base)
    with pytest.raises(Exception, match="stop"):
        run(100)  # the second output fails after the first was written
    assert counts() == [5, 3] and len(list((tmp_path / "out" / "_runs").iterdir())) == 1
    second = run(20)
    assert counts() == [5, 15] and held.count() == 3 and first != second
    run(30)
    assert counts() == [5, 25] and len(list((tmp_path / "out" / "_runs").iterdir())) == 2


def test_versions_of_one_job_stand_side_by_side(spark, tmp_path):
    for version, n in (("2019/09", 2), ("latest", 3), ("2019/09", 4)):
        publish(spark.range(n), DatasetRef("t", version), str(tmp_path), "id bigint")
    assert read_versioned(spark, 't."2019/09"', str(tmp_path)).count() == 4
    assert read_versioned(spark, "t", str(tmp_path)).count() == 3
