"""Geometry scan (S4): binary or text geometry of an input as text, and decoded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from civicflow.functions.wkb import with_geometry, wkt_of
from civicflow.operators.relate import computed

# Fixed value: the column in which the inputs hold binary geometry.
BINARY_COLUMN = "wkb_geometry"
# The decoded geometry that a scan leaves beside its text.
SHAPE = "_shape"


def scan_geometry(df: DataFrame, column: str = BINARY_COLUMN, to: str = "geom") -> DataFrame:
    """The frame with its geometry as text in ``to`` and decoded in ``SHAPE``.

    Bytes and hex text are decoded; text that is no hex is taken as text geometry already, without a decoded form.
    What is neither read nor such text is NULL in both.  A frame without the column is left as it is.
    """
    if column not in df.columns:
        return df
    return computed(with_geometry(df, column, SHAPE), {to: F.coalesce(wkt_of(F.col(SHAPE)), _written(df, column))})


def decoded_geometry(df: DataFrame, column: str = BINARY_COLUMN, to: str = "geom") -> DataFrame:
    """``scan_geometry`` for a reader of the shapes alone: ``to`` is NULL where there is a decoded form."""
    if column not in df.columns:
        return df
    return with_geometry(df, column, SHAPE).withColumn(to, F.when(F.col(SHAPE).isNull(), _written(df, column)))


def _written(df: DataFrame, column: str) -> Column:
    """The geometry that the column holds as text, without its reference system."""
    if not isinstance(df.schema[column].dataType, T.StringType):
        return F.lit(None).cast("string")
    written = F.regexp_replace(F.trim(f"`{column}`"), "(?i)^SRID=[0-9]+;", "")
    return F.when(F.upper(written).rlike("^[A-Z]{5,}.*(\\)|EMPTY)$"), written)


def unreadable_geometry(df: DataFrame, column: str = BINARY_COLUMN) -> int:
    """How many values of a geometry column are there and cannot be read."""
    if column not in df.columns:
        return 0
    empty = F.col(f"`{column}`").isNull() | (F.octet_length(f"`{column}`") == 0)
    return scan_geometry(df.select(f"`{column}`"), column, "_text").where(~empty & F.col("_text").isNull()).count()
