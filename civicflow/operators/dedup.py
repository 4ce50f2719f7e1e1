"""Newest record by key, best of adjacent runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_per_key(df: DataFrame, keys: list[Column], day: Column, tie_break: list[Column]) -> DataFrame:
    """One row by key: the newest, then the first by the tie-break.

    NULL keys form a group of their own and NULL days come last.  Filtering the
    rank to 1 lets Spark keep one row by key in every map task before the
    shuffle, so a key with most of the rows costs no more than any other.
    """
    newest = Window.partitionBy(*keys).orderBy(day.desc_nulls_last(), *tie_break)
    return df.withColumn("_rank", F.row_number().over(newest)).filter("_rank = 1").drop("_rank")


def adjacent_runs_best(
    df: DataFrame, keys: list[str], slices: list[Column], order: list[str], run_value: Column, weight: Column
) -> DataFrame:
    """From each run of neighbours with an equal value, the lightest row.

    Runs follow ``order`` within ``keys``; equal values that are not neighbours
    stay separate runs, and the first row wins between equal weights.
    ``slices`` cut the order into ever finer pieces, such as the day and the
    minute of a timestamp: each must grow with the order.  Runs are found in the
    finest pieces, and only piece summaries are brought together, level by
    level, to join the runs that cross a border.  No task has to hold all rows
    of a key, nor all pieces.
    """
    names = [f"_s{i}" for i in range(len(slices))]
    position = F.struct(*[F.col(c) for c in order])
    base = df.select(
        *[F.col(k) for k in keys],
        *[s.alias(n) for s, n in zip(slices, names)],
        position.alias("_pos"),
        run_value.alias("_value"),
        F.struct(weight.alias("w"), position.alias("p")).alias("_cost"),
        F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"),
    )
    within = Window.partitionBy(*keys, *names).orderBy("_pos")
    starts = F.lag("_pos").over(within).isNull() | ~F.lag("_value").over(within).eqNullSafe(F.col("_value"))
    numbered = base.withColumn("_start", starts.cast("long")).withColumn("_run", F.sum("_start").over(within))
    runs = numbered.groupBy(*keys, *names, "_run").agg(
        F.first("_value").alias("_value"),
        F.min_by("_row", "_cost").alias("_row"),
        F.min("_cost").alias("_cost"),
    )

    # How far the runs of a piece are numbered on from those before it.
    pieces = runs.groupBy(*keys, *names).agg(
        F.max("_run").alias("_count"),
        F.min_by("_value", "_run").alias("_head"),
        F.max_by("_value", "_run").alias("_tail"),
    )
    offsets = []
    for level in range(len(names), 0, -1):
        outer, own = [*keys, *names[: level - 1]], names[level - 1]
        before = Window.partitionBy(*outer).orderBy(own)
        follows = F.lag("_count").over(before).isNotNull() & F.lag("_tail").over(before).eqNullSafe(F.col("_head"))
        so_far = before.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        pieces = pieces.withColumn("_new", F.col("_count") - follows.cast("long")).withColumn(
            "_offset", F.sum("_new").over(so_far) - F.col("_count")
        )
        offsets.append(pieces.select(*outer, own, "_offset"))
        pieces = pieces.groupBy(*outer).agg(
            F.sum("_new").alias("_count"), F.min_by("_head", own).alias("_head"), F.max_by("_tail", own).alias("_tail")
        )
    # Only the pieces are joined level by level; the runs are joined once.
    total = offsets.pop()
    for level in range(2, len(names) + 1):
        finer = offsets.pop().withColumnRenamed("_offset", "_run")
        total = _add_offset(finer, total, [*keys, *names[: level - 1]]).withColumnRenamed("_run", "_offset")
    placed = _add_offset(runs, total, [*keys, *names])
    best = placed.groupBy(*keys, "_run").agg(F.min_by("_row", "_cost").alias("_row"))
    return best.select("_row.*")


def _add_offset(runs: DataFrame, pieces: DataFrame, on: list[str]) -> DataFrame:
    right = pieces.select(*[F.col(c).alias(f"_r{c}") for c in on], "_offset")
    same = [F.col(c).eqNullSafe(F.col(f"_r{c}")) for c in on]
    condition = same[0]
    for c in same[1:]:
        condition = condition & c
    joined = runs.join(right, condition).withColumn("_run", F.col("_run") + F.col("_offset"))
    return joined.select(*runs.columns)
