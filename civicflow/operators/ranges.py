"""Positions of houses that no list has, from the address ranges of street sides.

A range is one side of a street between two ends: its house numbers from low to high, all odd or all even as the low
one is, and where both ends lie.  A house on no list is placed between the ends, as far along as its number is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civicflow.functions.address import street_key
from civicflow.functions.text import col, empty_to_null
from civicflow.operators.relate import computed, lookup_spread

# House numbers that share a bin of the interval join.
BIN = 64

_KEYS = ["_street", "_area", "_n"]
_BIN_KEYS = ["_street", "_area", "_odd", "_bin"]


def house_in_block(c) -> Column:
    """The whole number that a house number begins with; NULL if it begins with none or with one too large."""
    return F.regexp_extract(F.trim(col(c)), r"^(\d+)", 1).try_cast("int")


def _bin(n: Column) -> Column:
    return F.floor(n / BIN).cast("int")


def range_book(ranges: DataFrame, area: str) -> DataFrame:
    """Of the ranges that hold the same numbers of a bin the one that counts: (_street, _area, _odd, _bin, from, to, r).

    ``ranges`` has street, the area column, low, high, from_lon, from_lat, to_lon, to_lat and id.  A range whose ends
    are the wrong way round is turned; one without a number, a street or an area is left out.  ``from`` and ``to`` are
    the first and the last number of the range in the bin.  A side has 32 numbers in a bin, so a bin has 528 rows at
    most, however many ranges reach into it.  ``r`` is (order, high, ends).
    """
    turned = F.col("low") > F.col("high")

    def end(c: str, other: str) -> Column:
        return F.when(turned, F.col(other)).otherwise(F.col(c))

    book = ranges.select(
        street_key("street").alias("_street"),
        empty_to_null(F.upper(F.trim(area))).alias("_area"),
        F.least("low", "high").cast("int").alias("low"),
        F.greatest("low", "high").cast("int").alias("high"),
        F.struct(
            end("from_lon", "to_lon").alias("x0"),
            end("from_lat", "to_lat").alias("y0"),
            end("to_lon", "from_lon").alias("x1"),
            end("to_lat", "from_lat").alias("y1"),
        ).alias("ends"),
        "id",
        (turned.isNotNull()).alias("_whole"),
    )
    book = book.filter(F.col("_whole")).drop("_whole").dropna(subset=["_street", "_area"])
    # Of equal ranges one counts; the others need not be laid on bins.
    order = F.struct((F.col("high") - F.col("low")).alias("length"), "low", "id")
    same = ["_street", "_area", "low", "high"]
    book = book.groupBy(*same).agg(F.min(F.struct(order.alias("order"), "high", "ends")).alias("r"))
    bins = F.explode(F.sequence(_bin(F.col("low")), _bin(F.col("high"))))
    laid = book.select("*", (F.col("low") % 2).alias("_odd"), bins.alias("_bin"))
    # The numbers of the range's side in the bin: from the first of them, and the last as it is even or odd.
    side = F.pmod(F.col("low"), F.lit(2))
    first = F.greatest(F.col("low"), F.col("_bin") * BIN + side)
    last = F.least(F.col("high") - F.pmod(F.col("high") - F.col("low"), F.lit(2)), F.col("_bin") * BIN + (BIN - 2) + side)
    cut = [*_BIN_KEYS, first.alias("from"), last.alias("to")]
    # A range may reach into its last bin with a number of the other side only.
    return laid.select(*cut, "r").filter(F.col("from") <= F.col("to")).groupBy(*_BIN_KEYS, "from", "to").agg(F.min("r").alias("r"))


def place_in_ranges(df: DataFrame, ranges: DataFrame, *, house: str, street: str, area: str) -> DataFrame:
    """Every row with ``range_id``, ``range_lon`` and ``range_lat``, NULL where no range holds its house.

    Requests are taken once however many rows ask, and meet the ranges on street, area, side and bin of the number, so
    a long range meets only the requests of its bins and no two rows are compared that share none.  Of ranges that
    overlap the shortest counts, then the lowest, then the smallest id.  A range of one number lies half way.
    At most 32 requests of a bin meet at most 528 ranges, so what is compared does not grow with ranges times rows.
    """
    asked = computed(
        df,
        {
            "_street": street_key(street),
            "_area": empty_to_null(F.upper(F.trim(area))),
            "_n": house_in_block(house),
        },
    )
    requests = asked.select(*_KEYS).dropna().distinct()
    requests = requests.select("*", (F.col("_n") % 2).alias("_odd"), _bin(F.col("_n")).alias("_bin"))
    met = requests.join(range_book(ranges, area), _BIN_KEYS)
    met = met.filter(F.col("_n").between(F.col("from"), F.col("to")))
    best = met.groupBy(*_KEYS).agg(F.min("r").alias("r"))
    low, high, ends = F.col("r.order.low"), F.col("r.high"), F.col("r.ends")
    along = F.when(high > low, (F.col("_n") - low) / F.when(high > low, high - low)).otherwise(0.5)
    placed = best.select(
        *_KEYS,
        F.col("r.order.id").alias("range_id"),
        (ends["x0"] + along * (ends["x1"] - ends["x0"])).alias("range_lon"),
        (ends["y0"] + along * (ends["y1"] - ends["y0"])).alias("range_lat"),
    )
    return lookup_spread(asked, placed, _KEYS).drop(*_KEYS)
