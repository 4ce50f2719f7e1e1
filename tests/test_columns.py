"""Column functions, with the inputs that are easy to get wrong."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from civicflow.functions import codes, dates, links, numbers, text
from civicflow.functions.address import crossing, house_number, street_name, stretch
from civicflow.plans.capacity import capital_level, project_level
from civicflow.plans.fixed_values import BOROUGH_BY_DISTRICT


def test_blank_and_null(values):
    assert values(text.empty_to_null("c"), ["", " ", None, "x"]) == [None, " ", None, "x"]
    assert values(text.blank_to_null("c"), ["", " ", None, "x"]) == [None, None, None, "x"]
    assert values(text.sentinel_to_null("c", "SE"), ["SE", "PS", None]) == [None, "PS", None]
    assert values(text.is_blank("c"), ["", None, "x"]) == [True, True, False]


def test_cut_at_first(values):
    given = ["53RD ST & FIRST AVE|4 WHALE SQUARE", "A@B", "A AND B", "SAND ST", "a and b", None]
    assert values(text.cut_at_first("c"), given) == ["53RD ST ", "A", "A", "SAND ST", "a and b", ""]


def test_crossing_part_guard_and_split_agree(values):
    given = ["A & B", "A And B", "X CROSS Y", "GRAND AVE", None]
    assert values(text.crossing_part("c", text.CROSSING_WIDE, first=True), given) == ["A ", "A", "X ", "", ""]
    assert values(text.crossing_part("c", text.CROSSING_WIDE, first=False), given) == [" B", "B", " Y", "", ""]
    assert values(text.crossing_part("c", text.CROSSING_NARROW, first=False), ["X CROSS Y"]) == [""]


def test_clean_house(values):
    given = ["0", "", None, "12 - 14 (REAR)", "7/9", "5 (OPEN", "012"]
    assert values(text.clean_house("c", blank_leading_zero=True), given) == ["", "", " ", "12-14 ", "7", "5 ", ""]
    assert values(text.clean_house("c"), [None, " 12 (X) ", "0"]) == ["", "12", "0"]


def test_clean_street(values):
    given = ["JFK BLDG 5", "O'NEIL ST (VARIOUS LOCATIONS)", "MAIN/ELM", None, "VARIOUS ST"]
    assert values(text.clean_street("c"), given) == ["JFK INTERNATIONAL AIRPORT", "ONEIL ST ", "MAIN", "", " ST"]


def test_clean_borough(values):
    given = ["STATENISLAND", "BRONX", "bronx", "NEWARK", None]
    assert values(text.clean_borough("c"), given) == ["Staten Island", "Bronx", None, None, None]


def test_concatenation_and_choice(spark):
    row = spark.sql("SELECT 'a' AS a, CAST(NULL AS STRING) AS n, '' AS e").select(
        text.spaced("a", "n").alias("propagates"),
        text.display_key("a", "n").alias("display"),
        text.prefer("e", "a").alias("prefer"),
        text.replace_if_different("a", "n").alias("replaced"),
        text.replace_if_different("a", "a").alias("kept"),
    )
    assert row.first().asDict() == {
        "propagates": None,
        "display": "a ",
        "prefer": "a",
        "replaced": None,
        "kept": "a",
    }


def test_content_hash_ignores_column_order(spark):
    df = spark.sql("SELECT 1 AS b, CAST(NULL AS STRING) AS a")
    one = df.select(text.content_hash(["a", "b"]).alias("h")).first().h
    assert one == df.select(text.content_hash(["b", "a"]).alias("h")).first().h
    assert one == df.select(F.md5(F.lit('{"a":null,"b":1}')).alias("h")).first().h


def test_numbers(values):
    given = ["1,234", "+/-56", ".5", " ", "1.2e+07", "n/a", None, "12.", "1d"]
    assert values(numbers.to_number_marked("c"), given) == [1234.0, 56.0, 0.5, None, 1.2e7, None, None, 12.0, None]
    assert values(numbers.to_number("c"), given) == [None, None, 0.5, None, 1.2e7, None, None, 12.0, None]
    assert values(numbers.to_whole("c"), [" 12 ", "12.5", "", None, "-3"]) == [12, None, None, None, -3]
    assert values(numbers.range_end("c"), ["300-350", "300–350", "n/a", None, "7"]) == [350, 350, 0, 0, 7]
    assert values(numbers.truncated("c"), [1.9, -1.9, 1e12, None], "double") == [1, -1, None, None]


def test_ceiling_depends_on_the_type(spark):
    row = spark.sql("SELECT '100' AS e, '7%' AS p, 100.0D AS d, 0.07D AS s").select(
        numbers.allocate(numbers.to_exact("e"), numbers.percent_share("p")).cast("int").alias("exact"),
        numbers.allocate("d", "s").alias("double"),
        numbers.percent_share(F.lit("45.5%")).cast("string").alias("share"),
    )
    assert tuple(row.first()) == (7, 8, "0.45500")


def test_ratio_by_zero_is_null(spark):
    row = spark.sql("SELECT 1.0D AS a, 0.0D AS b, CAST(NULL AS DOUBLE) AS n")
    row = row.select(numbers.ratio("a", "b").alias("x"), numbers.ratio("n", "a").alias("y"))
    assert tuple(row.first()) == (None, None)


def test_plan_dates(values):
    given = [
        "2021",
        "September 2021",
        "september 2021",
        "Sep-21",
        "21-Sep",
        "Sep-70",
        "Sep-68",
        "2021-09-03 00:00:00",
        "2021-09-03 00:00:01",
        "bad",
        "Foo-21",
        None,
    ]
    day = dt.date
    assert values(dates.first_readable_date("c"), given) == [
        day(2021, 1, 1),
        day(2021, 9, 1),
        day(2021, 9, 1),
        day(2021, 9, 1),
        day(2021, 9, 1),
        day(1970, 9, 1),
        day(2068, 9, 1),
        day(2021, 9, 3),
        None,
        None,
        None,
        None,
    ]
    assert values(dates.first_readable_date("c", dates.BUDGET_DATE_SHAPES), ["2021", "Sep-21"]) == [None, day(2021, 9, 1)]


def test_cut_off_and_school_year(values):
    given = ["08/31/2018", "9/1/2018", "4/20/2016", "2/30/2018", "tbd", None]
    assert values(dates.date_from("c", "2016-04-21"), given) == ["2018-08-31", "2018-09-01", "", "", "", ""]
    years = values(dates.school_year(dates.us_date("c")), given)
    assert years == ["2017-2018", "2018-2019", "2015-2016", "", "", ""]
    assert values(dates.iso_date("c"), ["2018-09-01 00:00:00+00", "2018-9-1", "x"]) == [
        dt.date(2018, 9, 1),
        dt.date(2018, 9, 1),
        None,
    ]


def test_codes(values):
    assert values(codes.label("c", {"a": "A"}, ""), ["a", "b", None]) == ["A", "", ""]
    assert values(codes.label("c", {"a": 1}), ["a", "b"]) == [1, None]
    named = values(codes.range_label("c", BOROUGH_BY_DISTRICT), [1, 7, 13, 32, 24, 31, 33], "int")
    assert named == ["Manhattan", "Bronx", "Brooklyn", "Brooklyn", "Queens", "Staten Island", None]


def test_first_and_last_match(values):
    rules = [(F.col("c") > 1, "one"), (F.col("c") > 2, "two"), (F.col("c").isNull(), "null")]
    assert values(codes.first_match(rules), [1, 2, 3, None], "int") == [None, "one", "one", "null"]
    assert values(codes.last_match(rules), [1, 2, 3, None], "int") == [None, "one", "two", "null"]


@pytest.mark.parametrize(
    "name, project, capital",
    [
        ("P.S./I.S. 12", "PSIS", "PSIS"),
        ("P.S. / I.S. 12", "PSIS", "PS"),
        ("I.S./H.S. 3", "ISHS", "IS"),
        ("I.S. 5", "IS", "IS"),
        ("M.S. 8", "IS", "IS"),
        ("PRE-K CENTER", "PK", "PK"),
        ("3K CENTER", "3K", "3K"),
        ("PS 4", "PS", "PS"),
        ("D75 SITE", "SE", None),
        ("THIS SCHOOL", None, None),
        (None, None, None),
    ],
)
def test_school_levels(values, name, project, capital):
    assert values(project_level("c"), [name]) == [project]
    assert values(capital_level("c"), [name]) == [capital]


def test_addresses(values):
    given = ["12 MAIN ST", "43-10 BERRIAN BLVD", "31ST AVE", "12 1/2 MAIN ST, FL 3", None, "5A ELM ST APT 2", "77"]
    assert values(house_number("c"), given) == ["12", "43-10", "", "12 1/2", "", "5A", "77"]
    streets = ["MAIN ST", "BERRIAN BLVD", "31ST AVE", "MAIN ST", None, "ELM ST", "77"]
    assert values(street_name("c"), given) == streets


def test_stretch_and_crossing(values):
    given = ["MAIN ST BETWEEN 4 AND 5 AVENUES", "GRAND AVENUE", "A BETWEEN B", None]
    found = [tuple(v) for v in values(stretch("c"), given)]
    assert found == [("MAIN ST", "4 AVENUES", "5 AVENUES")] + [("", "", "")] * 3
    found = [tuple(v) for v in values(crossing("c"), ["ELM AND OAK ST", "GRAND AVENUE", None])]
    assert found == [("ELM", "OAK ST"), ("", ""), ("", "")]


def test_anchors(values):
    html = (
        '<p>x<a class="q" HREF="/one?a=1&amp;b=2">One <b>1</b></a>'
        "<A href='/two'>two</A><a name=x>no target</a><abbr>y</abbr><a href=/three>open"
    )
    found = values(links.anchors("c"), [html, "", None])
    assert [tuple(a) for a in found[0]] == [("/one?a=1&b=2", "One 1"), ("/two", "two"), ("/three", "open")]
    assert found[1:] == [[], []]


def test_long_page_is_read_whole(values):
    html = "<p>" + "x" * 300_000 + '</p><a href="/last">last</a>'
    assert [a.href for a in values(links.anchors("c"), [html])[0]] == ["/last"]


def test_cell_anchor_takes_the_first_of_a_cell(values):
    html = '<table class="dataTable"><tr><td class="a"><a href="1">A</a><a href="2">B</a></td><td>none</td></tr></table><a href="3">C</a>'
    assert [(a.href, a.text) for a in values(links.cell_anchor("c"), [html])[0]] == [("1", "A")]


def test_meeting_address(values):
    url = (
        "https://x.sharepoint.com/sites/P/Shared%20Documents/Forms/AllItems.aspx?id=/sites/P/Shared Documents/PEP/"
        "2019-2020/October 22, 2019 Panel/Public Notice/May 1, 2018&p=true"
    )
    assert values(links.path_part(links.readable("c"), 11), [url]) == ["2019-2020"]
    assert values(links.first_date_in_path(links.readable("c")), [url, "https://x/a"]) == [dt.date(2019, 10, 22), None]
    assert values(links.readable("c"), ["a%20b+c", "100%", None]) == ["a b+c", "100%", None]


def test_anchors_with_brackets_in_quotes_and_odd_heads(values):
    cases = {
        '<a title="a > b" href="z">x > y</a>': [("z", "x > y")],
        "<a title='href=\"no\"' href='yes' >T<b title='>'>b</b></a>": [("yes", "Tb")],
        '<a data-href="no" HREF = plain class=x>t</a><a href="">e</a>': [("plain", "t"), ("", "e")],
        '<a name="top">t</a><a href="open>t</a>': [('"open', "t")],
        "<a href=&#0000047;x&#x000002F;>&copy;&nosuch;</a>": [("/x/", "©&nosuch;")],
        "<abbr href=no>x</abbr><a\nhref='n'>l</a>": [("n", "l")],
        "<a href='long' " + "x='1' " * 5000 + ">t</a>": [("long", "t")],
    }
    found = values(links.anchors("c"), list(cases))
    for got, want, html in zip(found, cases.values(), cases):
        if "open" not in html:
            assert [(a.href, a.text) for a in got] == want, html[:60]
        else:
            assert len(got) <= 1


def test_listing_with_tables_in_cells(values):
    inner = "<table><tr><td><a href='{0}'>i</a></td><td>x</td></tr></table>"
    html = (
        "<table class='menu'><tr><td><a href='no'>n</a></td></tr></table><table id=\"a>b\" class=\"x dataTable y\"><tr>"
        f"<td>{inner.format('in1')}<a href='out1'>o</a></td><td>none</td><td><table><tr><td>x</td></tr></table><a href='out2'>p</a></td>"
        "<td><a href='last'>l</a></td></tr></table><table class='dataTable'><tr><td><a href='other'>m</a></td></tr></table>"
    )
    found = values(links.cell_anchor("c"), [html, "<table class=dataTable></table>", "", None])
    assert [a.href for a in found[0]] == ["in1", "in1", "out2", "last"] and found[1:] == [[], [], []]


def test_dates_in_any_usual_spelling(values):
    day = dt.date(2019, 10, 22)
    same = ["October 22, 2019", "10-22-2019", "Oct 22 2019", "22 October 2019", "October 22nd, 2019", "OCTOBER 22, 2019",
            "2019-10-22", "10.22.19", "22/10/2019", "2019 Oct 22", "PS 123 October 22, 2019 v2", "Oct. 22, 2019", "10_22_2019"]
    assert values(links.date_in(F.col("c")), same) == [day] * len(same)
    none = ["October 2019", "2019-2020", "22 October", "X123", "", None, "February 30, 2019", "Mayor 5 2019", "2019"]
    assert values(links.date_in(F.col("c")), none) == [None] * len(none)


def test_house_and_street_anywhere(values):
    cases = {
        "C/O SMITH 123 MAIN ST": ("123", "MAIN ST"),
        "123 1/2 MAIN ST, NEW YORK NY 10001": ("123 1/2", "MAIN ST"),
        "BLDG 5, 45 BROAD ST": ("45", "BROAD ST"),
        "45 W 31ST ST APT 2": ("45", "W 31ST ST"),
        "123 MAIN ST NEW YORK NY 10001": ("123", "MAIN ST"),
        "100 ST NICHOLAS AVE": ("100", "ST NICHOLAS AVE"),
        "45 AVENUE A, BROOKLYN, NY": ("45", "AVENUE A"),
        "12 AVENUE OF THE AMERICAS #4B": ("12", "AVENUE OF THE AMERICAS"),
        "31ST AVE, QUEENS NY 11101-1234": ("", "31ST AVE"),
        "STATE ROUTE 25": ("", "STATE ROUTE 25"),
        "TERMINAL 4 JFK AIRPORT": ("", "TERMINAL 4 JFK AIRPORT"),
        "4 AVE BETWEEN 5 ST AND 6 ST": ("4", "AVE BETWEEN 5 ST AND 6 ST"),
        "GRAND ST AND 5 AVE": ("", "GRAND ST AND 5 AVE"),
        "43-10A BERRIAN BLVD FL 2": ("43-10A", "BERRIAN BLVD"),
        "12 BUILDING ST UNIT 4": ("12", "BUILDING ST"),
        "77": ("77", "77"),
        "": ("", ""),
        None: ("", None),
    }
    assert list(zip(values(house_number("c"), list(cases)), values(street_name("c"), list(cases)))) == list(cases.values())
