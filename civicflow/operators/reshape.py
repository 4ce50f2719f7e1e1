"""Group sums, pivots, unpivots and roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def group_sum(df: DataFrame, keys: list[str], values: list[str], kind: str = "double") -> DataFrame:
    """Sums by key; rows with a NULL key are left out (A1, A2, trap T7)."""
    return df.dropna(subset=keys).groupBy(*keys).agg(*[F.sum(f"`{v}`").cast(kind).alias(v) for v in values])


def pivot_sum(df: DataFrame, keys: list[str], category: str, categories: dict, value: Column) -> DataFrame:
    """Sums by key with one column for each category, 0 when absent (A10).

    ``categories`` maps a category to its column name.  The sums are
    conditional, so one shuffle of partial sums does it.
    """
    sums = [
        F.coalesce(F.sum(F.when(F.col(category) == F.lit(c), value)), F.lit(0)).alias(name)
        for c, name in categories.items()
    ]
    return df.dropna(subset=keys).groupBy(*keys).agg(*sums)


def pivot_single(df: DataFrame, keys: list[str], category: str, categories: list[str], values: dict) -> DataFrame:
    """One struct column for each category, holding its only row's values.

    ``values`` maps a name to a numeric column; a missing category or NULL
    gives 0.  Two rows for one key and category are an error, as in a pivot
    without an aggregate.
    """
    aggs = []
    for c in categories:
        mine = F.col(category) == F.lit(c)
        fields = [F.coalesce(F.max(F.when(mine, v)), F.lit(0)).alias(n) for n, v in values.items()]
        twice = F.count_if(mine) > 1
        message = F.concat(F.lit(f"duplicate {category} {c} for "), F.to_json(F.struct(*keys)))
        checked = [F.when(twice, F.raise_error(message).cast("double")).otherwise(f) for f in fields]
        aggs.append(F.struct(*[x.alias(n) for x, n in zip(checked, values)]).alias(c))
    return df.dropna(subset=keys).groupBy(*keys).agg(*aggs)


def unpivot(df: DataFrame, keys: list[str], columns: list[str], variable: str, value: str) -> DataFrame:
    """One row for each key and column, NULL values kept."""
    quoted = [F.col(f"`{c}`") for c in columns]
    return df.unpivot([F.col(f"`{k}`") for k in keys], quoted, variable, value)


def unpivot_structs(df: DataFrame, keys: list[str], columns: list[str], variable: str, fields: list[str]) -> DataFrame:
    """``unpivot`` of struct columns, their fields side by side."""
    entries = F.array(*[F.struct(F.lit(c).alias("_name"), F.col(f"`{c}`").alias("_entry")) for c in columns])
    long = df.select(*keys, F.explode(entries).alias("_e"))
    return long.select(*keys, F.col("_e._name").alias(variable), *[F.col(f"_e._entry.{f}").alias(f) for f in fields])


def total(columns: list[Column]) -> Column:
    """Sum of several columns of one row."""
    out = columns[0]
    for c in columns[1:]:
        out = out + c
    return out


def root_sum_squares(columns: list[Column]) -> Column:
    """Square root of the sum of squares, for margins of error."""
    return F.sqrt(total([c * c for c in columns]))


def share(df: DataFrame, condition: Column, name: str) -> DataFrame:
    """Part of the rows for which the condition holds, as one row."""
    return df.agg(F.avg(F.coalesce(condition, F.lit(False)).cast("double")).alias(name))
