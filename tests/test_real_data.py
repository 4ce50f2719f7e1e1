"""Values as they come in real tables: too large, too exact, badly marked, far away, tied."""

from __future__ import annotations

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from civicflow.functions import links, numbers, text
from civicflow.functions.geometry import parse_lines, parse_polygons, point_wkt
from civicflow.operators.spatial import meets_any, segment_cells, extent
from civicflow.plans import JOBS
from civicflow.plans.commuting import travel_variables
from civicflow.plans.permits import newest_permits, permit_links
from civicflow.plans.utilization import meeting_urls
from civicflow.session import SETTINGS, applied


def test_numbers_keep_their_digits(values):
    exact = numbers.to_exact("c").cast("string")
    assert values(exact, ["-73.9876543211", "1234567890123", "1" * 19]) == ["-73.9876543211", "1234567890123.0000000000", None]
    share = numbers.percent_share(F.lit("100%"))
    assert values(numbers.allocate(numbers.to_exact("c"), share), ["100.0000001"]) == [101]
    assert values(numbers.range_end("c"), ["300-9999999999", "1–7", "x", None]) == [0, 7, 0, 0]
    assert values(numbers.to_count("c"), ["9,007,199,254,740,993", "12.7", "x", "9" * 30]) == [9007199254740993, 12, None, None]


def test_marks_are_for_those_who_ask(values):
    assert values(numbers.to_number("c"), ["1,200", "-74,01", "+/-5", "\t7 \n", ".5"]) == [None, None, None, 7.0, 0.5]
    assert values(numbers.to_number_marked("c"), ["1,200", "+/-5", "x"]) == [1200.0, 5.0, None]
    assert values(point_wkt(F.col("c"), F.lit("40,7")), ["-74,01"]) == [None]
    assert values(text.stripped("c"), ["\t a b\r\n", None]) == ["a b", None]


@pytest.mark.parametrize("far", [10_000, 100_000_000])
def test_a_stray_vertex_makes_no_more_cells_than_the_box(spark, far):
    areas = spark.createDataFrame([("POLYGON ((0 0, 1 0, 0 1, 0 0))",)], "g string")
    rows = [(1, f"LINESTRING (0.25 0.25, {far} {far})"), (2, f"LINESTRING (-{far} 0.5, {far} 0.5)"), (3, f"LINESTRING (5 5, {far} 0)")]
    lines = spark.createDataFrame([*rows, (4, "LINESTRING (1 0, 2 0)")], "id int, g string")
    polygons, parts = parse_polygons("g"), parse_lines("g")
    cells = segment_cells(lines, "id", parts, extent(areas, polygons), 0.01)
    assert cells.count() < 1000
    met = meets_any(lines, "id", parts, areas, polygons, 0.01)
    assert sorted(r.id for r in met.collect()) == [1, 2, 4]


def test_entities_and_hidden_links(values, spark):
    given = ["&#38;&eacute;&nbsp;x&#xE9;", "a & b &unknown; &amp;lt;", "plain", None, "&#1114112;&#0;"]
    assert values(links.unescape("c"), given) == ["&é\xa0xé", "a & b &unknown; &lt;", "plain", None, "&#1114112;&#0;"]
    page = "<!-- <a href='no'>n</a> --><script>'<a href=no>'</script><a href='?a=1&amp;b=2'> yes\t</a><!-- <a href=open>"
    df = spark.createDataFrame([(page,)], "html string")
    assert links.explode_anchors(df).collect() == [Row(pos=0, href="?a=1&b=2", text="yes")]


def test_only_the_listing_counts(spark):
    menu = "<table class='menu'><td><a href='m'>2-0</a></td></table>"
    listing = "<TABLE id=x class='big dataTable'><tr><td><a href='a.txt'>2-1</a><a href='z'>2-9</a></td><td>-</td></tr></TABLE>"
    later = "<table class='dataTable'><td><a href='l'>2-3</a></td></table>"
    pages = spark.createDataFrame([(menu + "<!-- <table class='dataTable'> -->" + listing + later,), (menu,), (None,)], "html string")
    assert [r.permit_id for r in permit_links(pages).collect()] == ["2-1"]


def test_ties_end_with_every_column(spark):
    columns = "facility_name address issue_date permit_id facility_location zipcode borough expiration_date url_to_permit_text longitude"
    row = ["f", "a", "1/1/2020", "p", "l", "z", "b", "e"]
    rows = [(*row, "u2", "1"), (*row, "u1", "2"), (*row, "u1", "1")]
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, columns.split()).repartition(3)
        assert [(r.url_to_permit_text, r.longitude) for r in newest_permits(df).collect()] == [("u1", "1")]


def test_a_tract_of_unknown_modes_stays(spark):
    rows = [("C3100US36061000100", "99", "5", "1"), ("C3100US36061000200", "2", "1,234", "+/-5")]
    out = travel_variables(spark.createDataFrame(rows, "geoid string, lineno string, est string, moe string")).collect()
    assert len({r.geoid for r in out}) == 2
    assert {(r.value, r.moe) for r in out if r.geoid.endswith("100")} == {(0, 0)}


def test_unmatched_districts_are_an_output(spark):
    projections = spark.createDataFrame(
        [(1, "1", "PK", "1,000"), (2, "1", "6", "5"), (3, "2", "K", "5"), (4, "2", "7", "5")],
        "ogc_fid int, district string, projected string, `2019-20` string",
    )
    shares = spark.createDataFrame([("1", "1", "PS", "1"), ("9", "1", "PS", "1")], "district string, subdistrict string, level string, multiplier string")
    out = JOBS["projections_by_sd"].run({"projections": projections, "split_pct": shares})
    assert sorted(map(tuple, out["projections_by_sd_unmatched"].collect())) == [("2", "split_pct"), ("9", "projections")]


def test_meeting_pages_may_have_any_numbers(spark):
    link = "<a href='https://a.sharepoint.com/s/b/c/d/e/f/g/h/i/2019-2020/{}'>x</a>"
    ids = [-(2**62), -5, 3, 2**40, 2**40 + 1, 2**62]
    days = ["May 1, 2020", "May 1, 2020 long", "May 2, 2020", "May 2, 2020", "May 2, 2020 x", "May 1, 2020"]
    rows = [(i, "archive", link.format(d)) for i, d in zip(ids, days)]
    out = meeting_urls(spark.createDataFrame(rows, "page_id bigint, source string, html string"))
    got = sorted((r.date, r.readable_url[-12:]) for r in out.collect())
    assert got == [("2020-05-01", "/May 1, 2020"), ("2020-05-01", "/May 1, 2020"), ("2020-05-02", "/May 2, 2020")]


def test_published_rows_can_be_sorted(spark):
    df = spark.createDataFrame([("2", "b"), (None, "a"), ("10", "c")], "district string, s string")
    # By the number, missing ones last, as the published listing is read
    ordered = df.orderBy(F.col("district").try_cast("int").asc_nulls_last(), "s")
    assert [r.s for r in ordered.collect()] == ["b", "c", "a"]
    assert "rangepartitioning" in ordered._jdf.queryExecution().executedPlan().toString()


def test_settings_hold_while_publishing(spark):
    key = "spark.sql.adaptive.forceOptimizeSkewedJoin"
    spark.conf.set(key, "false")
    try:
        with applied(spark):
            assert all(spark.conf.get(k) == v for k, v in SETTINGS.items() if spark.conf.isModifiable(k))
        assert spark.conf.get(key) == "false"
    finally:
        spark.conf.set(key, SETTINGS[key])


def test_corrections_from_csv(spark, tmp_path):
    from civicflow.checks.geocoding import _capacity_inputs

    inputs = _capacity_inputs(spark, "/root/testdata/sf0.001")
    job = JOBS["capacity_projects"]
    for name in job.inputs:
        if name not in ("address_cor", "level_cor"):
            inputs[name].write.parquet(f"{tmp_path}/in/{name}/latest")
    school = inputs["plans_current"].where("school LIKE 'P.S. 1%'").orderBy("school").first().school
    (tmp_path / "a.csv").write_text(f'school,address\n"{school}",first\n"{school}","1 LAST\nST"\n')
    (tmp_path / "l.csv").write_text("school,org_level\n")
    csv = {"address_cor": str(tmp_path / "a.csv"), "level_cor": str(tmp_path / "l.csv")}
    lost: dict[str, dict[str, int]] = {}
    paths = job.publish(spark, f"{tmp_path}/in", f"{tmp_path}/out", csv=csv, unreadable=lost)
    assert set(lost) == set(paths) == set(job.outputs)
    every = [spark.read.parquet(paths[n]) for n in ("all_capacity_projects", "all_capacity_projects_rejects")]
    found = every[0].select("name", "address").union(every[1].select("name", "address")).where(F.col("address").contains("LAST"))
    assert found.count() == 1
    assert not [p.name for p in (tmp_path / "out").iterdir() if p.name.startswith("_staging")]
