"""Text cleaning."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """The body with the value computed once, however often it is used there.

    Nothing inside a lambda is shared by the optimizer, so a costly value used
    in one would be computed again for every element.
    """
    return F.transform(F.array(value), body)[0]


def col(c) -> Column:
    """A column from a name or a column."""
    return F.col(c) if isinstance(c, str) else c


def blank(c) -> Column:
    """NULL becomes the empty string."""
    return F.coalesce(col(c), F.lit(""))


def empty_to_null(c) -> Column:
    """The empty string, and only that, becomes NULL."""
    return F.nullif(col(c), F.lit(""))


def stripped(c) -> Column:
    """Text without white space of any kind at either end.

    ``F.trim`` takes spaces only and stands where SQL's TRIM is meant.
    """
    return F.regexp_replace(col(c), r"^\s+|\s+$", "")


def blank_to_null(c) -> Column:
    """Text without anything but white space becomes NULL."""
    return F.when(F.trim(col(c)) != "", col(c))


def sentinel_to_null(c, *sentinels: str) -> Column:
    """Any of the given stand-in values becomes NULL."""
    return F.when(~col(c).isin(*sentinels), col(c))


def is_blank(c) -> Column:
    """True for NULL and for the empty string, never NULL itself."""
    return blank(c) == ""


def before(c, separator: str) -> Column:
    """Text up to the first separator."""
    return F.substring_index(col(c), separator, 1)


def nth_part(c, separator: str, index: int) -> Column:
    """Zero-based part of a split, NULL when there are fewer."""
    return F.get(F.split(col(c), separator), F.lit(index))


def last_part(c, separator: str) -> Column:
    """Last part of a split."""
    return F.substring_index(col(c), separator, -1)


# Separators that end the usable part of a location.
LOCATION_SEPARATORS = ["|", "&", "@", " AND "]


def cut_at_first(c, separators: list[str] = LOCATION_SEPARATORS) -> Column:
    """Text up to whichever separator comes first; NULL gives '' (C4).

    Cutting at one separator after another always ends at the earliest of
    them, so one alternation does the same work in one pass.
    """
    pattern = "|".join(_escape(s) for s in separators)
    return F.get(F.split(blank(c), pattern, 2), F.lit(0))


def crossing_part(c, pattern: str, first: bool) -> Column:
    """First or last street of a crossing, '' when it is not one.

    The same case-insensitive pattern decides and splits (trap T20).
    """
    text = blank(c)
    part = F.element_at(F.split(text, f"(?i){pattern}"), 1 if first else -1)
    return F.when(text.rlike(f"(?i){pattern}"), part).otherwise("")


# What joins two street names in permit addresses.
CROSSING_WIDE = "&| AND |CROSS|CRS"
CROSSING_NARROW = "&| AND "


def remove(c, *literals: str) -> Column:
    """Drop each literal text wherever it occurs."""
    out = col(c)
    for text in literals:
        out = F.replace(out, F.lit(text), F.lit(""))
    return out


def remove_parenthesised(c) -> Column:
    """Drop every closed pair of parentheses with its content."""
    return F.regexp_replace(col(c), r"\([^)]*\)", "")


def join_text(*parts) -> Column:
    """Concatenate; NULL as soon as one part is NULL."""
    return F.concat(*[col(p) for p in parts])


def spaced(*parts) -> Column:
    """Concatenate with one space between, NULL-propagating."""
    out: list[Column] = []
    for i, part in enumerate(parts):
        if i:
            out.append(F.lit(" "))
        out.append(col(part))
    return F.concat(*out)


def display_key(*parts) -> Column:
    """Space-separated key in which a missing part counts as blank."""
    return spaced(*[blank(p) for p in parts])


def clean_house(c, blank_leading_zero: bool = False) -> Column:
    """House number without remarks (D3).

    With ``blank_leading_zero`` a number that starts with 0 is dropped (C15);
    an empty one stays empty (trap T5).
    """
    text = F.coalesce(col(c), F.lit(" "))
    if blank_leading_zero:
        text = F.when(text.startswith("0"), F.lit("")).otherwise(text)
    text = F.replace(remove_parenthesised(text), F.lit(" - "), F.lit("-"))
    if not blank_leading_zero:
        text = F.trim(text)
    return before(before(text, "("), "/")


# Filler words in permit street names, and the airport's name.
STREET_FILLERS = ["'", "VARIOUS", "LOCATIONS"]
AIRPORT_MARK = "JFK"
AIRPORT_NAME = "JFK INTERNATIONAL AIRPORT"


def clean_street(c, fillers: list[str] = STREET_FILLERS, airport: bool = True) -> Column:
    """Street name without remarks and filler words."""
    text = blank(c)
    if airport:
        text = F.when(text.contains(AIRPORT_MARK), F.lit(AIRPORT_NAME)).otherwise(text)
    text = remove(remove_parenthesised(text), *fillers)
    return before(before(text, "("), "/")


# The five boroughs, and the one misspelling that is repaired.
BOROUGHS = ["BRONX", "MANHATTAN", "BROOKLYN", "QUEENS", "STATEN ISLAND"]
BOROUGH_REPAIRS = {"STATENISLAND": "STATEN ISLAND"}


def clean_borough(c) -> Column:
    """Known borough in title case, anything else NULL."""
    name = col(c)
    for wrong, right in BOROUGH_REPAIRS.items():
        name = F.when(name == wrong, F.lit(right)).otherwise(name)
    return F.when(name.isin(*BOROUGHS), F.initcap(F.lower(name)))


def prefer(first, second) -> Column:
    """First text unless it is blank, then the second."""
    return F.when(~is_blank(first), col(first)).otherwise(col(second))


def replace_if_different(old, new) -> Column:
    """The new value wherever it differs from the old, NULL included."""
    return F.when(col(old).eqNullSafe(col(new)), col(old)).otherwise(col(new))


def content_hash(df_columns: list[str]) -> Column:
    """md5 of the record as JSON, columns in name order (C24, trap T12)."""
    ordered = [F.col(f"`{name}`") for name in sorted(df_columns)]
    return F.md5(F.to_json(F.struct(*ordered), {"ignoreNullFields": "false"}))


def _escape(literal: str) -> str:
    return "".join("\\" + ch if ch in "\\^$.|?*+()[]{}" else ch for ch in literal)
