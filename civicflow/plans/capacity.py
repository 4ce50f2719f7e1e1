"""School capacity projects and the capital plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from civicflow.functions.address import house_number, street_name, tagged
from civicflow.functions.codes import first_match, label, weight
from civicflow.functions.dates import BUDGET_DATE_SHAPES, PLAN_DATE_SHAPES, first_readable_date
from civicflow.functions.numbers import ratio, to_number, to_whole, truncated
from civicflow.functions.text import blank, clean_house, clean_street, content_hash, sentinel_to_null, stripped
from civicflow.operators.geocode import geocode_with_stretch, place_stretch_result
from civicflow.operators.relate import computed, differs, moved_once, override_by_key, union_missing
from civicflow.operators.reshape import share as share_of
from civicflow.plans import schemas
from civicflow.plans.fixed_values import (
    BOROUGH_BY_LETTER,
    CAPITAL_SHARES,
    LEVEL_CONTAINED,
    LEVEL_CONTAINED_PREFIX,
    LEVEL_CONTAINED_REST,
    LEVEL_CONTAINED_SPACELESS,
    LEVEL_WORDS,
    PROJECT_SHARES,
)
from civicflow.plans.job import Frames, JobSpec, Share, as_is
from civicflow.sources.publish import split_by


def _contained(text: Column, rules: list[tuple[str, str]]) -> list[tuple[Column, str]]:
    return [(text.contains(key), value) for key, value in rules]


def _words(text: Column) -> list[tuple[Column, str]]:
    return [(text.rlike(rf"\b{word}\b"), value) for word, value in LEVEL_WORDS]


def project_level(name: str) -> Column:
    """School level of a project's school by its name."""
    text = F.col(name)
    spaceless = F.replace(text, F.lit(" "), F.lit(""))
    return first_match(
        [
            *_contained(text, LEVEL_CONTAINED_PREFIX),
            *_contained(spaceless, LEVEL_CONTAINED_SPACELESS),
            *_contained(text, LEVEL_CONTAINED_REST),
            *_words(text),
        ]
    )


def capital_level(name: str) -> Column:
    """School level in the capital plan, which knows fewer kinds."""
    text = F.col(name)
    return first_match([*_contained(text, LEVEL_CONTAINED), *_words(text)])


# Which source column holds what in the three plans.
PREVIOUS_COLUMNS = {
    "school": "name",
    "number_of_seats": "forecastcapacity",
    "opening_&_anticipated_opening": "start_date",
}
CURRENT_COLUMNS = {
    "school": "name",
    "location": "address",
    "capacity": "forecastcapacity",
    "anticipated_opening": "start_date",
}


def all_plans(inputs: Frames) -> DataFrame:
    """The three plans as one table, with the plan they come from."""
    columns = ["name", "address", "borough", "district", "forecastcapacity", "start_date", "capital_plan"]

    def plan(df: DataFrame, renamed: dict[str, str], years: str) -> DataFrame:
        named = df.withColumnsRenamed(renamed).withColumn("capital_plan", F.lit(years))
        return named.select(*[c for c in columns if c in named.columns])

    return union_missing(
        plan(inputs["plans_prev"], PREVIOUS_COLUMNS, "15-19"),
        plan(inputs["plans_current"], CURRENT_COLUMNS, "20-24"),
        plan(inputs["plans_tcu"], CURRENT_COLUMNS, "20-24"),
    )


def _line(fixes: DataFrame) -> Column:
    """The order of corrections: a line in text is a number, one of a CSV file is in order as it is."""
    text = isinstance(fixes.schema["line"].dataType, T.StringType)
    return F.col("line").cast("bigint") if text else F.col("line")


def described_projects(inputs: Frames) -> DataFrame:
    """Projects with corrected address, level, seats and opening date."""
    plans = all_plans(inputs)
    plans = override_by_key(
        plans, "name", "address", inputs["address_cor"], "school", F.upper("address"), _line(inputs["address_cor"])
    )
    # One automaton gives the house and the street.
    plans = computed(plans, {"_labels": tagged("address")})
    plans = computed(
        plans,
        {
            "borough": label(stripped("borough"), BOROUGH_BY_LETTER, ""),
            "hnum": clean_house(house_number("address", F.col("_labels"))),
            "sname": clean_street(street_name("address", F.col("_labels")), fillers=["'"], airport=False),
            "org_level": project_level("name"),
        },
    ).drop("_labels")
    plans = override_by_key(
        plans, "name", "org_level", inputs["level_cor"], "school", F.col("org_level"), _line(inputs["level_cor"])
    )
    level = F.col("org_level")
    return computed(
        plans,
        {
            "capacity": F.coalesce(truncated(to_number("forecastcapacity"), "bigint"), F.lit(0)),
            "start_date": first_readable_date("start_date", PLAN_DATE_SHAPES),
            **{name: weight(level, shares) for name, shares in PROJECT_SHARES.items()},
            "guessed_pct": F.coalesce(F.length(level), F.lit(0)) > 2,
            "org_level": sentinel_to_null("org_level", "SE"),
        },
    )


def located_projects(inputs: Frames) -> DataFrame:
    """Projects with their place and a content id."""
    found = geocode_with_stretch(
        moved_once(described_projects(inputs)),
        inputs["address_points"],
        inputs["segments"],
        inputs["nodes"],
        inputs["intersections"],
    )
    return place_stretch_result(found.withColumn("uid", content_hash(found.columns)))


def placed_share(projects: DataFrame) -> DataFrame:
    """Part of the projects that could be placed."""
    return share_of(projects, F.col("geom").isNotNull(), "share_geocoded")


def build_capacity_projects(inputs: Frames, share: Share = as_is) -> Frames:
    """All projects and those outside special education and early years."""
    every = share(located_projects(inputs), "capacity_projects")
    kept = every.filter(
        differs(F.col("district"), "75") & differs(F.col("org_level"), "PK") & differs(F.col("org_level"), "3K")
    )
    out: Frames = {}
    for name, df in [("capacity_projects", kept), ("all_capacity_projects", every)]:
        out[name], out[f"{name}_rejects"] = split_by(df, F.col("geom").isNotNull())
    return out


CAPACITY_PROJECTS = JobSpec(
    "capacity_projects",
    [
        "plans_prev",
        "plans_current",
        "plans_tcu",
        "address_cor",
        "level_cor",
        "address_points",
        "segments",
        "nodes",
        "intersections",
    ],
    {
        "capacity_projects": schemas.CAPACITY_PROJECTS,
        "capacity_projects_rejects": schemas.CAPACITY_PROJECTS_REJECTS,
        "all_capacity_projects": schemas.CAPACITY_PROJECTS,
        "all_capacity_projects_rejects": schemas.CAPACITY_PROJECTS_REJECTS,
    },
    build_capacity_projects,
    shares=True,
)


def build_capital_projects(inputs: Frames) -> Frames:
    """Capacity projects of the capital plan with their funding."""
    plan = inputs["capital_plan"].filter(F.col("type").rlike("(?i)Capacity Projects"))
    plan = plan.withColumn("org_level", capital_level("schoolname"))
    level = F.col("org_level")
    cost = to_number("totalestcost")
    current, previous = to_number("fundingreqd"), to_number("previousappropriations")
    out = plan.select(
        F.col("projectid").alias("project_dsf"),
        F.col("schoolname").alias("name"),
        "org_level",
        F.coalesce(to_whole("forecastcapacity"), F.lit(0)).alias("capacity"),
        *[weight(level, shares).alias(name) for name, shares in CAPITAL_SHARES.items()],
        (blank(level) == "PSIS").alias("guessed_pct"),
        first_readable_date("constrstart", BUDGET_DATE_SHAPES).alias("start_date"),
        first_readable_date("actualestcompletion", BUDGET_DATE_SHAPES).alias("planned_end_date"),
        cost.alias("total_est_cost"),
        current.alias("funding_current_budget"),
        previous.alias("funding_previous"),
        ratio(previous + current, cost).alias("pct_funded"),
    )
    return {"capital_projects": out}


CAPITAL_PROJECTS = JobSpec(
    "capital_projects",
    ["capital_plan"],
    {"capital_projects": schemas.CAPITAL_PROJECTS},
    build_capital_projects,
)
