"""Joins and unions with the semantics the jobs need.

No side is forced to broadcast: Spark broadcasts one only when its measured
size is under the session's threshold, and splits a hot join key at run time.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPREAD = 1024


def computed(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add or replace columns that are worked out once and for all.

    The optimizer writes a plain column's expression out wherever it is used,
    filters included, and costly steps built on one another grow without bound.
    It cannot look through an explode, here of a single element.
    """
    kept = [F.col(f"`{c}`") for c in df.columns if c not in columns]
    entry = F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))).alias("_computed")
    return df.select("*", entry).select(*kept, *[F.col(f"_computed.`{n}`").alias(n) for n in columns])


def moved_once(df: DataFrame) -> DataFrame:
    """The frame behind a shuffle of its own, which everything that reads the frame shares.

    A frame that is read twice, as by a lookup for its requests and for its
    rows, is planned twice.  Spark makes equal shuffles once, but each reader
    leaves out the columns it does not need, which makes them differ.  Packed
    as one column they stay equal, and what costs lies below.
    """
    plain = [f.name for f in df.schema.fields if isinstance(f.dataType, T.AtomicType)]
    packed = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_all"))
    dealt = packed.repartition(F.xxhash64(*[F.col(f"_all.`{c}`") for c in plain]))
    return dealt.select(F.explode(F.array("_all")).alias("_all")).select(*[F.col(f"_all.`{c}`").alias(c) for c in df.columns])


def lookup_left(df: DataFrame, dim: DataFrame, on: str | list[str]) -> DataFrame:
    """Every row, with the columns of all matching lookup rows.

    A lookup key that occurs twice doubles the row; that is kept (T21).
    """
    return df.join(dim, on, "left")


def lookup_spread(df: DataFrame, dim: DataFrame, on: list[str], by: list[str] | None = None) -> DataFrame:
    """``lookup_left`` for keys that are often NULL.

    Rows without a key find nothing, yet a plain join would send them all to
    one task.  They are dealt out over ``SPREAD`` groups by the content of the
    columns ``by``, or of all plain columns.
    """
    missing = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in on])
    by = by or [f.name for f in df.schema.fields if isinstance(f.dataType, T.AtomicType)]
    deal = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in by]), F.lit(SPREAD)).cast("int") + 1
    left = df.withColumn("_deal", F.when(missing, deal).otherwise(F.lit(0)))
    right = dim.withColumn("_deal", F.lit(0))
    return left.join(right, [*on, "_deal"], "left").drop("_deal")


# A key is hot if it has more than this share of the rows; there are at most so many of them.
HOT_KEYS = 1000


def join_hot_key(df: DataFrame, other: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Inner or left join on keys of which some hold a large share of ``df``.

    Keys are counted, partially before the shuffle.  Rows of a hot key, one with
    more than a thousandth of all rows, are dealt out by the content of the row
    over as many groups as its share asks for, and only the rows that the other
    side has for such keys are repeated, once for each group.  So no group holds
    much more than a thousandth of ``df``, whichever side is built.  There are
    fewer than a thousand hot keys, whatever the data; as one map they are a
    constant of the plan.  A NULL key finds nothing, as in any join; its rows
    are dealt out in the same way.
    """
    counts = df.groupBy(*on).agg(F.count("*").alias("_n"))
    total = counts.agg(F.sum("_n").alias("n")).scalar()
    pieces = F.ceil(F.col("_n") * HOT_KEYS / total).cast("int")
    # Keys go by a hash: two that share one are dealt alike on both sides.
    hot = counts.filter(F.col("_n") * HOT_KEYS > total).groupBy(F.xxhash64(*on).alias("h")).agg(F.max(pieces).alias("n"))
    table = hot.agg(F.map_from_entries(F.collect_list(F.struct("h", "n"))).alias("m")).scalar()
    groups = F.coalesce(F.try_element_at(table, F.xxhash64(*on)), F.lit(1))
    plain = [f.name for f in df.schema.fields if isinstance(f.dataType, T.AtomicType)]
    left = df.withColumn("_piece", F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in plain], F.lit(0)), groups).cast("int"))
    right = other.select("*", F.explode(F.sequence(F.lit(0), groups - 1)).alias("_piece"))
    return left.join(right, [*on, "_piece"], how).drop("_piece")


def null_safe_left(df: DataFrame, other: DataFrame, on: list[str]) -> DataFrame:
    """Left join in which NULL keys equal each other (J4, trap T8)."""
    right = other.withColumnsRenamed({k: f"_r_{k}" for k in on})
    match = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in on])
    return df.join(right, match, "left").drop(*[f"_r_{k}" for k in on])


def full_outer(df: DataFrame, other: DataFrame, on: list[str]) -> DataFrame:
    """Rows of both sides, matched where the keys are equal.

    Written as a left join plus the unmatched right rows: Spark splits a hot
    key in those two but not in a full outer join.
    """
    matched = df.join(other, on, "left")
    keys = df.select(*on).dropna().distinct()
    unmatched = other.join(keys, on, "left_anti")
    return matched.unionByName(unmatched, allowMissingColumns=True)


def not_in(df: DataFrame, key: Column, other: DataFrame, other_key: Column, flag: str) -> DataFrame:
    """Add what SQL says to ``key NOT IN (SELECT other_key ...)`` (J7, trap T9).

    TRUE for any key when the right side is empty; NULL when the key is NULL,
    or when it is unmatched and the right side holds a NULL.  The right side is
    reduced to distinct keys and joined, not broadcast as Spark does for the
    subquery form.
    """
    right = other.select(other_key.alias("_key"))
    keys = right.filter(F.col("_key").isNotNull()).distinct().withColumn("_hit", F.lit(True))
    both = F.struct(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("_key").isNull()).alias("nulls"))
    counts = right.agg(both).scalar()
    rows, nulls = counts["rows"], counts["nulls"]
    found = lookup_spread(df.withColumn("_key", key), keys, ["_key"])
    answer = (
        F.when(rows == 0, F.lit(True))
        .when(F.col("_key").isNull(), F.lit(None).cast("boolean"))
        .when(F.col("_hit"), F.lit(False))
        .when(nulls > 0, F.lit(None).cast("boolean"))
        .otherwise(F.lit(True))
    )
    return found.withColumn(flag, answer).drop("_key", "_hit")


def exists_flag(df: DataFrame, key: Column, other: DataFrame, other_key: Column, flag: str) -> DataFrame:
    """Add whether the key occurs in the other table, FALSE for NULL."""
    keys = other.select(other_key.alias("_key")).dropna().distinct().withColumn("_hit", F.lit(True))
    found = lookup_spread(df.withColumn("_key", key), keys, ["_key"])
    return found.withColumn(flag, F.coalesce(F.col("_hit"), F.lit(False))).drop("_key", "_hit")


def semi_join(df: DataFrame, key: Column, other: DataFrame, other_key: Column) -> DataFrame:
    """Rows whose key occurs in the other table."""
    keys = other.select(other_key.alias("_key")).dropna().distinct()
    return df.withColumn("_key", key).join(keys, "_key", "left_semi").drop("_key")


def known_or_blank(df: DataFrame, lookups: list[tuple[str, DataFrame, str]]) -> DataFrame:
    """Rows with any listed column blank or found in its lookup.

    Each entry is (column, lookup table, lookup column).
    """
    keep: Column = F.lit(False)
    columns = df.columns
    for i, (name, table, table_column) in enumerate(lookups):
        df = exists_flag(df, F.col(name), table, F.col(table_column), f"_known_{i}")
        keep = keep | F.col(f"_known_{i}") | F.coalesce(F.col(name) == "", F.lit(False))
    return df.filter(keep).select(*[F.col(f"`{c}`") for c in columns])


def differs(c: Column, value) -> Column:
    """Not equal, where NULL counts as different (F8, trap T16)."""
    return ~c.eqNullSafe(F.lit(value))


def override_by_key(
    df: DataFrame, key: str, target: str, corrections: DataFrame, corrected_key: str, value: Column, order: Column
) -> DataFrame:
    """Replace the target where the key has a correction; the last one wins."""
    last = (
        corrections.filter(F.col(corrected_key).isNotNull())
        .groupBy(F.col(corrected_key).alias(key))
        .agg(F.max_by(value, order).alias("_new"), F.lit(True).alias("_has"))
    )
    fixed = F.when(F.col("_has"), F.col("_new")).otherwise(F.col(target))
    columns = [F.col(f"`{c}`") for c in df.columns]
    joined = lookup_spread(df, last, [key]).withColumn(target, fixed)
    return joined.select(*columns)


def union_missing(*frames: DataFrame) -> DataFrame:
    """Union by name, absent columns NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def distinct_ids(df: DataFrame, columns: list[str], name: str) -> DataFrame:
    """Distinct values over several columns, in one scan."""
    values = F.explode(F.array(*[F.col(c) for c in columns])).alias(name)
    return df.select(values).filter(F.col(name).isNotNull()).distinct()
