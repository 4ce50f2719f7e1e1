"""Dates in mixed spellings, cut-offs and school years (S-DATE, C16, C17)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from civicflow.functions.text import blank, col

# Two-digit years from this one on belong to the 1900s (trap T13).
PIVOT_YEAR = 69


def _full_year(two_digits: Column) -> Column:
    century = F.when(two_digits.try_cast("int") >= PIVOT_YEAR, F.lit("19")).otherwise(F.lit("20"))
    return F.concat(century, two_digits)


def _month_of_year(text: Column, pattern: str, month: int, year: int) -> Column:
    name = F.initcap(F.lower(F.regexp_extract(text, pattern, month)))
    full = _full_year(F.regexp_extract(text, pattern, year))
    spelled = F.concat(F.lit("01 "), name, F.lit(" "), full)
    return F.when(text.rlike(pattern), F.try_to_timestamp(spelled, F.lit("dd MMM yyyy")).cast("date"))


def year_only(c) -> Column:
    """'2021' as its first day."""
    text = col(c)
    shape = r"^\d{4}$"
    return F.when(
        text.rlike(shape), F.try_to_timestamp(F.concat(text, F.lit("-01-01")), F.lit("yyyy-MM-dd")).cast("date")
    )


def month_name_year(c) -> Column:
    """'September 2021' as the first of the month."""
    text = col(c)
    pattern = r"^([A-Za-z]+)\s+(\d{4})$"
    spelled = F.concat(
        F.lit("01 "),
        F.initcap(F.lower(F.regexp_extract(text, pattern, 1))),
        F.lit(" "),
        F.regexp_extract(text, pattern, 2),
    )
    return F.when(text.rlike(pattern), F.try_to_timestamp(spelled, F.lit("dd MMMM yyyy")).cast("date"))


def short_month_year(c) -> Column:
    """'Sep-21' as the first of the month."""
    return _month_of_year(col(c), r"^([A-Za-z]{3})-(\d{2})$", 1, 2)


def year_short_month(c) -> Column:
    """'21-Sep' as the first of the month."""
    return _month_of_year(col(c), r"^(\d{2})-([A-Za-z]{3})$", 2, 1)


def stamped_day(c) -> Column:
    """'2021-09-01 00:00:00' as its day; the seconds must end in 0."""
    text = col(c)
    shape = r"^(\d{4}-\d{1,2}-\d{1,2})\s+(2[0-3]|[01]?\d):[0-5]?\d:[0-5]?\d0$"
    day = F.regexp_extract(text, shape, 1)
    return F.when(text.rlike(shape), F.try_to_timestamp(day, F.lit("yyyy-M-d")).cast("date"))


PLAN_DATE_SHAPES = (year_only, month_name_year, short_month_year, year_short_month, stamped_day)
BUDGET_DATE_SHAPES = (short_month_year, year_short_month, stamped_day)


def first_readable_date(c, shapes=PLAN_DATE_SHAPES) -> Column:
    """Date by the first spelling that fits, else NULL (S-DATE)."""
    return F.coalesce(*[shape(c) for shape in shapes])


def us_date(c) -> Column:
    """'9/1/2018' as a date, else NULL."""
    text = F.trim(col(c))
    shape = r"^\d{1,2}/\d{1,2}/\d{4}$"
    return F.when(text.rlike(shape), F.try_to_timestamp(text, F.lit("M/d/yyyy")).cast("date"))


def iso_date(c) -> Column:
    """'2018-09-01', with or without a time behind it, as a date."""
    day = F.regexp_extract(F.trim(col(c)), r"^(\d{4}-\d{1,2}-\d{1,2})($|[ T])", 1)
    return F.when(day != "", F.try_to_timestamp(day, F.lit("yyyy-M-d")).cast("date"))


def date_from(c, earliest: str) -> Column:
    """US date as ISO text; '' when unreadable or before the cut-off."""
    day = us_date(c)
    return blank(F.when(day >= F.lit(earliest).cast("date"), F.date_format(day, "yyyy-MM-dd")))


def school_year(day) -> Column:
    """'2017-2018' for days before September 2018, '' for no day (C17)."""
    day = col(day)
    start = F.when(F.month(day) < 9, F.year(day) - 1).otherwise(F.year(day))
    return blank(F.concat(start.cast("string"), F.lit("-"), (start + 1).cast("string")))
