"""Tolerant numbers, rounding and ratios."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from civicflow.functions.text import blank, col, stripped

_DECIMAL_SHAPE = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
_INTEGER_SHAPE = r"^[+-]?\d+$"


def strip_marks(c) -> Column:
    """Drop thousands commas and the plus-minus mark of an error."""
    return stripped(F.replace(F.replace(col(c), F.lit(","), F.lit("")), F.lit("+/-"), F.lit("")))


def to_number(c) -> Column:
    """Text as a double; NULL when it is not a number (C19, trap T14).

    A bare leading point and an exponent are accepted, commas are not: in a
    coordinate or a cost they do not part thousands.
    """
    text = stripped(col(c).cast("string"))
    return F.when(text.rlike(_DECIMAL_SHAPE), text.try_cast("double"))


def to_number_marked(c) -> Column:
    """``to_number`` of text with thousands commas or a plus-minus mark."""
    return to_number(strip_marks(col(c).cast("string")))


def to_count(c) -> Column:
    """Text with thousands commas as a whole number, all digits kept (trap T22).

    What follows the point is cut off; NULL when it is not a number or too
    large for a bigint.
    """
    return strip_marks(col(c).cast("string")).try_cast("decimal(38,10)").try_cast("bigint")


def to_whole(c) -> Column:
    """Text as a whole number; NULL when it is not one."""
    text = stripped(col(c).cast("string"))
    return F.when(text.rlike(_INTEGER_SHAPE), text.try_cast("bigint"))


def truncated(c, kind: str = "int") -> Column:
    """Double to integer, cutting toward zero; NULL if it does not fit (C20)."""
    return col(c).try_cast(kind)


def to_exact(c) -> Column:
    """Text as an exact decimal, so that ceilings are not off by one.

    Eighteen whole digits and ten decimals: times a share of four and five, all
    of the product's digits still fit.
    """
    return stripped(c).try_cast("decimal(28,10)")


def range_end(c) -> Column:
    """Upper end of '300-350' with either dash, 0 when unreadable."""
    text = F.replace(blank(c), F.lit("–"), F.lit("-"))
    return F.coalesce(to_whole(F.substring_index(text, "-", -1)).try_cast("int"), F.lit(0))


def percent_share(c) -> Column:
    """'45.5%' as an exact share rounded to five places."""
    number = to_exact(F.replace(col(c), F.lit("%"), F.lit("")))
    return F.round(number / F.lit(100).cast("decimal(3,0)"), 5).try_cast("decimal(9,5)")


def allocate(total, share) -> Column:
    """Total times share, rounded up, in the type of the inputs."""
    return F.ceil(col(total) * col(share))


def ratio(numerator, denominator) -> Column:
    """Quotient, NULL for a zero denominator (C23, trap T15)."""
    return F.try_divide(col(numerator), col(denominator))
