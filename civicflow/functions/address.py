"""House, street, stretch and crossing out of address text.

The rules stand in for a trained address tagger.  A text is cut into tokens, each of a class, and a small automaton
reads them from left to right and labels the house and the street: it seeks the house, which may stand behind a name
or a building, then takes the street up to a comma, a unit, or the city.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from civicflow.functions.text import blank, col, empty_to_null, let

FRACTION = r"(\d+/\d+)"
LEADING_FRACTION = r"^\s*\d+/\d+\s+"
UNIT = r"(?i)(?:[\s,]+|^)(?:(?:APT|UNIT|SUITE|STE|FL|FLOOR|RM|ROOM)\b|#).*$"
CROSSING = r"(?i)\b(?:BETWEEN|AND)\b|[&@|]"
# The classes of tokens, the city's names, and what ends an address.
NUMBER_TOKEN = r"^\d+[A-Za-z]?(?:-\d+[A-Za-z]?)*$"
FRACTION_TOKEN = r"^\d+/\d+$"
UNIT_TOKEN = r"(?i)^(?:(?:APT|APARTMENT|UNIT|SUITE|STE|FL|FLOOR|RM|ROOM|BLDG|BUILDING|BOX|LOT|HANGAR|DOCK)\.?|#.*)$"
ROUTE_TOKEN = r"(?i)^(?:ROUTE|RTE|HIGHWAY|HWY|PIER|EXIT|TERMINAL|GATE|PS|IS|MS|HS|NO)\.?$"
STREET_TOKEN = (
    r"(?i)^(?:ST|STREET|AVES?|AVENUES?|BLVD|BOULEVARD|RD|ROAD|DR|DRIVE|LN|LANE|PL|PLACE|CT|COURT|PKWY|PARKWAY|TER|TERRACE"
    r"|WAY|HWY|HIGHWAY|EXPY|EXPRESSWAY|SQ|SQUARE|PLZ|PLAZA|CIR|CIRCLE|LOOP|WALK|SLIP|ALY|ALLEY|TPKE|TURNPIKE|BROADWAY)\.?$"
)
CITY = (
    r"(?i)\b(?:NEW\s+YORK(?:\s+CITY)?|STATEN\s+ISLAND|THE\s+BRONX|BRONX|BROOKLYN|QUEENS|MANHATTAN)"
    r"(?=[\s,]+(?:N\.?Y\b|NEW\s+YORK\b|\d{5}(?:-\d{4})?\s*$))"
)
STATE_AND_ZIP = r"(?i)[\s,]+(?:N\.?Y\.?|NEW\s+YORK)(?:[\s,]+\d{5}(?:-\d{4})?)?\s*$|[\s,]+\d{5}(?:-\d{4})?\s*$"

_LABELS = "struct<at:int,house:array<string>,street:array<string>>"
_SEEK, _HOUSE, _STREET, _END = range(4)


def _cut_city(text: Column) -> Column:
    """The text with a comma in place of the city, the state and the ZIP code at its end."""
    return F.regexp_replace(F.regexp_replace(text, CITY, " , "), STATE_AND_ZIP, " , ")


def tagged(address) -> Column:
    """(house, street): the tokens of each label.

    A first token that is a number is the house.  A later one is, if neither a unit nor a route stands before it, if a
    kind of street follows it before the next comma, and if the text names no crossing.  A fraction next to the house
    belongs to it.  The street ends with a comma, a unit, or the text.
    """

    def classed(t: Column) -> Column:
        """What a token is, by each pattern once; the automaton below reads these only."""
        return F.struct(
            t.alias("token"),
            t.rlike(NUMBER_TOKEN).alias("number"),
            t.rlike(FRACTION_TOKEN).alias("fraction"),
            (t == ",").alias("comma"),
            t.rlike(UNIT_TOKEN).alias("unit"),
            t.rlike(ROUTE_TOKEN).alias("route"),
            t.rlike(STREET_TOKEN).alias("kind"),
        )

    def labels(tokens: Column, crossing: Column) -> Column:
        n = F.size(tokens)
        none = F.array().cast("array<string>")
        start = F.struct(F.lit(_SEEK).alias("at"), none.alias("house"), none.alias("street")).cast(_LABELS)

        def follows(k: Column) -> Column:
            rest = F.slice(tokens, k + 2, F.greatest(n - k - 1, F.lit(0)))
            return F.get(F.filter(rest, lambda t: t["kind"] | t["comma"]), F.lit(0))["kind"]

        def step(s: Column, k: Column) -> Column:
            t, last = F.get(tokens, k), F.get(tokens, F.when(k > 0, k - 1))
            token, number, fraction, comma = t["token"], t["number"], t["fraction"], t["comma"]
            bound = F.coalesce(last["unit"] | last["route"], F.lit(False))
            seek, house, street = (s["at"] == state for state in (_SEEK, _HOUSE, _STREET))
            followed = F.coalesce(follows(k), F.lit(False))
            more_house = (seek & number & ((k == 0) | (~crossing & ~bound & followed))) | (house & fraction)
            # "12 BUILDING ST" has a street of that name.
            ends = (street & comma) | ((house | street) & t["unit"] & (street | ~followed))
            facts = F.struct(more_house.alias("more_house"), ends.alias("ends"), ((house & ~fraction & ~comma) | street).alias("street"))

            def moved(f: Column) -> Column:
                more_street = ~f["ends"] & f["street"]
                at = F.when(f["ends"], _END).when(f["more_house"], _HOUSE).when(more_street, _STREET).otherwise(s["at"])
                return F.struct(
                    at.alias("at"),
                    F.when(f["more_house"], F.concat(s["house"], F.array(token))).otherwise(s["house"]).alias("house"),
                    F.when(more_street, F.concat(s["street"], F.array(token))).otherwise(s["street"]).alias("street"),
                )

            return let(facts, moved).cast(_LABELS)

        places = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
        return F.aggregate(places, start, step)

    text = blank(address)
    cut = F.filter(F.split(F.replace(_cut_city(text), F.lit(","), F.lit(" , ")), r"\s+"), lambda t: t != "")
    tokens = F.transform(cut, classed)
    return let(F.struct(tokens.alias("tokens"), text.rlike(CROSSING).alias("crossing")), lambda c: labels(c["tokens"], c["crossing"]))


def house_number(address, labels: Column | None = None) -> Column:
    """House number with its fraction; '' when there is none.

    ``labels`` is ``tagged(address)``, where it has been worked out already.
    """
    number = F.array_join((tagged(address) if labels is None else labels)["house"], " ")
    fraction = F.regexp_extract(blank(address), FRACTION, 1)
    return let(number, lambda n: F.when((fraction != "") & ~n.contains("/"), F.trim(F.concat(n, F.lit(" "), fraction))).otherwise(n))


def street_name(address, labels: Column | None = None) -> Column:
    """Street part, or the whole text when no street is left (D2); ``labels`` as in ``house_number``."""

    def of(labels: Column) -> Column:
        bare = F.regexp_replace(F.regexp_replace(F.substring_index(_cut_city(col(address)), " , ", 1), LEADING_FRACTION, ""), UNIT, "")
        street = F.when(F.size(labels["house"]) > 0, F.array_join(labels["street"], " ")).otherwise(F.trim(bare))
        return F.coalesce(empty_to_null(street), col(address))

    return let(tagged(address), of) if labels is None else of(labels)


def stretch(address) -> Column:
    """'X BETWEEN Y AND Z' as (street_1, street_2, street_3), else blanks.

    The second street takes the last word of the address: '4 AND 5 AVENUES'
    names two avenues.
    """
    text = blank(address)
    last_word = F.substring_index(text, " ", -1)

    def parts(halves: Column, sides: Column) -> Column:
        complete = F.size(sides) >= 2

        def part(value: Column) -> Column:
            return F.when(complete, F.trim(value)).otherwise("")

        return F.struct(
            part(halves[0]).alias("street_1"),
            part(F.concat(sides[0], last_word)).alias("street_2"),
            part(F.get(sides, F.lit(1))).alias("street_3"),
        )

    return let(
        F.split(text, r"\bBETWEEN\b"),
        lambda halves: let(F.split(F.get(halves, F.lit(1)), r"\bAND\b"), lambda sides: parts(halves, sides)),
    )


def crossing(address) -> Column:
    """'X AND Y' as (street_1, street_2), else blanks (D6, trap T4)."""

    def streets(parts: Column) -> Column:
        both = F.size(parts) >= 2

        def part(i: int) -> Column:
            return F.when(both, F.trim(F.get(parts, F.lit(i)))).otherwise("")

        return F.struct(part(0).alias("street_1"), part(1).alias("street_2"))

    return let(F.split(blank(address), r"\bAND\b"), streets)


def street_key(name) -> Column:
    """Street spelling for lookups: upper case, single spaces; NULL if blank."""
    return empty_to_null(F.trim(F.regexp_replace(F.upper(col(name)), r"\s+", " ")))
