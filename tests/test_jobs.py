"""Whole jobs on small fixtures, and published end to end."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from civicflow.checks.geocoding import _capacity_inputs, _permit_inputs, books
from civicflow.checks.geocoding import BOILER_REQUESTS, PERMIT_REQUESTS
from civicflow.checks.jobs import _school_inputs
from civicflow.checks.registry import shaped
from civicflow.plans import JOBS, schemas
from civicflow.plans.commuting import travel_variables
from civicflow.plans.enrolment import unmatched_districts
from civicflow.plans.schools import tagged_school_list, unmatched_blue_book
from civicflow.plans.utilization import meeting_urls
from civicflow.sources.publish import publish
from civicflow.sources.tables import read_versioned

SF = "/root/testdata/sf0.001"


def test_all_jobs_are_listed():
    assert len(JOBS) == 22


def _schools(spark, book_rows, list_rows):
    book = spark.createDataFrame(
        book_rows,
        "district string, subdistrict string, org_id string, bldg_id string, org_level string, charter string, organization_name string, org_e string, pc string, ic string, hc string, `ps_%` string, `ms_%` string, `hs_%` string, `bldg_excl.` string",
    )
    schools = spark.createDataFrame(
        list_rows,
        "location_code string, building_code string, location_name string, building_name string, address_line_1 string, borough_block_lot string, longitude string, latitude string, location_category_description string, location_type_description string, managed_by_name string",
    )
    return {"blue_book": book, "school_list": schools}


def _book(org, bldg, level="PS", name="P.S. 1", charter=None):
    return ("1", "2", org, bldg, level, charter, name, "100", "10.9", None, "5", "7%", "45.5%", None, "Y")


def _listed(code, bldg, building="MAIN", lot="1001", category="K-8", managed="DOE"):
    return (code, bldg, "School", building, "addr", lot, "NULL", "40.5", category, "General", managed)


def test_school_buildings(spark):
    inputs = _schools(
        spark,
        [_book("K1", "B1"), _book("K2", "B2", charter="Y", name="ALC"), _book("K1", "B1")],
        [
            _listed("K1", "B1"),
            _listed("K3", "B3", "MINI", "2002"),
            _listed("K3", "B4", "MAIN", "2002"),
            _listed("K5", "B5", "MINI", "3003"),
            _listed("K6", "B6", managed="Charter", category="Ungraded"),
        ],
    )
    out = JOBS["school_buildings"].run(inputs)
    rows = out["school_buildings"].collect()
    # The blue book lists the building twice, so it is published twice.
    assert len(rows) == 2
    got = rows[0].asDict()
    assert (got["pc"], got["pe"], got["ic"], got["ie"], got["hc"], got["he"]) == (10, 7, 0, 46, 5, 0)
    assert got["geom"] == "SRID=4326;POINT (0 40.5)" and got["excluded"] is True and got["borocode"] == 1
    # A mini beside another structure is left out, a mini alone stays.
    assert {(r.location_code, r.building_code) for r in out["school_research"].collect()} == {("K3", "B4"), ("K5", "B5")}
    tags = {r.building_code: r.excluded for r in tagged_school_list(inputs)[1].collect()}
    assert tags["B3"] == "annex of another building"
    assert tags["B6"] == "managed by others"


def test_null_key_in_the_sister_table_tags_nothing(spark):
    inputs = _schools(spark, [_book("K1", None)], [_listed("K9", "B9"), _listed("K8", None)])
    _, schools = tagged_school_list(inputs)
    assert {r.match for r in schools.collect()} == {None}
    assert {r.match for r in unmatched_blue_book(inputs).collect()} == {None}


def test_subdistricts_use_doubles_and_skip_unmatched(spark):
    projections = spark.createDataFrame(
        [(1, "1", "PK", "100"), (2, "1", "6", "1,000"), (3, "2", "K", "5"), (4, "9", "12", "7"), (5, None, "K", "9")],
        "ogc_fid int, district string, projected string, `2019-20` string",
    )
    split = spark.createDataFrame(
        [("1", "1", "PS", "0.07"), ("1", "1", "MS", "0.5"), ("1", "2", "PS", "1"), ("3", "1", "PS", "1"), ("1", None, "PS", "1")],
        "district string, subdistrict string, level string, multiplier string",
    )
    inputs = {"projections": projections, "split_pct": split}
    rows = JOBS["projections_by_sd"].run(inputs)["projections_by_sd"].collect()
    assert {tuple(r) for r in rows} == {(2019, 1, 1, 8, 500), (2019, 1, 2, 100, 0)}
    assert {tuple(r) for r in unmatched_districts(inputs).collect()} == {("3", "projections")}


def test_borough_projections(spark):
    projections = spark.createDataFrame(
        [(1, "1", "9", "1,234"), (2, "2", "12", "6"), (3, "32", "10", "5"), (4, "99", "9", "7"), (5, "1", "8", "7")],
        "ogc_fid int, district string, projected string, `2019-20` string",
    )
    rows = JOBS["projections_by_boro"].run({"projections": projections})["projections_by_boro"].collect()
    assert {tuple(r) for r in rows} == {(2019, "Manhattan", 1240), (2019, "Brooklyn", 5)}


def test_travel_margins(spark):
    rows = [("C3100US36061000100", "3", "1,000", "+/-30"), ("C3100US36061000100", "4", "5", "40"), ("C3100US36061000100", "2", "7", " ")]
    split = spark.createDataFrame(rows + [("C3100US34003000100", "1", "9", "9")], "geoid string, lineno string, est string, moe string")
    own = {r.variable: (r.value, r.moe) for r in travel_variables(split).collect()}
    assert len(own) == 21
    assert own["trans_auto_carpool_total"] == (1005, 50) and own["trans_auto_total"] == (1012, 50)
    assert own["trans_public_total"] == (0, 0) and own["trans_auto_solo"] == (7, 0)
    published = {r.variable: r.moe for r in travel_variables(split, compat=True).collect()}
    assert published["trans_auto_total"] == 7 and published["trans_public_total"] == 7


def test_commute_labels(spark):
    flows = spark.createDataFrame(
        [("a", "b", "8", "12", "1.5", "36061"), ("a", "b", "99", "1", "", "36119"), ("a", "b", "1", "1", "1", "36001")],
        "res_tract string, work_tract string, mode string, `totwork_16+` string, standard_error string, workplace_state_county string",
    )
    out = JOBS["journey_to_work"].run({"commute_flows": flows})["journey_to_work"]
    assert {tuple(r) for r in out.collect()} == {("a", "b", "Bus or trolley bus", 12, 1.5), ("a", "b", None, 1, None)}


def test_meeting_urls_keep_undated_links_of_the_archive_only(spark):
    base = "https://n.sharepoint.com/sites/P/Docs/Forms/All?id=/sites/P/Docs/PEP/"

    def link(url):
        return f'<a href="{url}">m</a>'

    pages = spark.createDataFrame(
        [
            (1, "current", link(base + "2019-2020/May 1, 2020 long") + link(base + "2019-2020/Undated")),
            (2, "archive", link(base + "2019-2020/May 1, 2020") + link(base + "2019-2020/Undated") + link(base + "2019-2020/May 1, 2020")),
            (3, "archive", link(base + "2018-2019/Contracts/May 1, 2019") + link("https://else.where/2019-2020")),
        ],
        "page_id int, source string, html string",
    )
    out = meeting_urls(pages)
    assert sorted((r.date, r.school_year, r.url[-13:]) for r in out.collect()) == [
        ("", "2019-2020", "-2020/Undated"),
        ("2020-05-01", "2019-2020", "0/May 1, 2020"),
        ("2020-05-01", "2019-2020", "0/May 1, 2020"),
    ]


@pytest.mark.parametrize("name", ["cats_permits", "state_facility_permits", "capacity_projects", "school_buildings"])
def test_published_outputs_hold_every_row(spark, tmp_path, name):
    job = JOBS[name]
    inputs = {
        **_permit_inputs(spark, SF),
        **_capacity_inputs(spark, SF),
        **_school_inputs(spark, SF),
        **books(spark, SF, "address_points"),
        "boiler_permits": shaped(spark, SF, BOILER_REQUESTS),
        "state_permits": shaped(spark, SF, PERMIT_REQUESTS),
    }
    for table in job.inputs:
        inputs[table].write.parquet(f"{tmp_path}/in/{table}/latest")
    paths = job.publish(spark, f"{tmp_path}/in", f"{tmp_path}/out")
    assert set(paths) == set(job.outputs)
    lazily = job.run(inputs)
    for output in job.outputs:
        written = read_versioned(spark, output, f"{tmp_path}/out")
        assert written.columns == lazily[output].columns
        assert written.count() == lazily[output].count() > 0, output
    if f"{name}_rejects" in job.outputs:
        assert read_versioned(spark, name, f"{tmp_path}/out").filter(F.col("geom").isNull()).count() == 0


def test_school_values_that_do_not_fit_are_counted(spark, tmp_path):
    inputs = _school_inputs(spark, "/root/testdata/sf0.001")
    odd = {"org_e": ["99999999999", "about 300"], "pc": ["abc"], "ps_%": ["half"]}
    book = inputs["blue_book"]
    listed = JOBS["school_buildings"].run(inputs)["school_buildings"].filter("pc > 0 and pe > 0")
    rows = sorted(r.org_id for r in listed.groupBy("org_id").count().filter("count = 1").collect())[:4]
    cases = [(c, v, rows[k]) for k, (c, v) in enumerate((c, v) for c, vs in odd.items() for v in vs)]
    for c, v, org in cases:
        book = book.withColumn(c, F.when(F.col("org_id") == org, F.lit(v)).otherwise(F.col(f"`{c}`")))
    built = JOBS["school_buildings"].build({**inputs, "blue_book": book})["school_buildings"]
    counts: dict[str, int] = {}
    path = publish(built, "school_buildings", str(tmp_path), schemas.SCHOOL_BUILDINGS, unreadable=counts)
    got = {r.org_id: r for r in spark.read.parquet(path).filter(F.col("org_id").isin(rows)).collect()}
    assert [got[rows[k]].pe for k in (0, 1, 3)] == [None] * 3 and got[rows[2]].pc is None and got[rows[2]].pe > 0
    assert counts["pe"] >= 3 and counts["pc"] >= 1 and counts["hc"] == 0
