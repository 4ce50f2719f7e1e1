"""Mixing sources to target weights: a token budget, spread down a tree of domains, languages and sources.

Each node's budget goes to its children by weight, but no child gets more than its leaves can supply, which is
their tokens times the most epochs, without leaves that a weight of 0 below the child shuts out; what a child cannot take goes to its siblings by weight, and only what a
whole family cannot take goes up.  Going down from the root this is one water-filling by family: children are
sorted by supply to weight, and those that fill up come first.

A leaf's budget is whole epochs of its documents and a prefix of one more, in an order drawn anew by seed and
epoch.  The prefix is found by sums over 65,536 bins of the order, and document by document only in the one bin
where the budget ends, so a leaf with a third of all rows is never sorted in one task.  Everything is DataFrame
work; text is counted once, and moved only as the last join needs it.  Amounts are whole numbers throughout.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from civicflow.llm.components import if_small, kept_frame

LEAF = ["_domain", "_lang", "_source"]
WORD = r"[^\x20\x09-\x0D]+"
#: Leaves up to which the plan of all leaves is broadcast.
FEW_LEAVES = 10_000


@dataclass(frozen=True)
class Mix:
    """Domain of each source (others: ``other``); whole-number weights by name at each level (others: 1); the
    budget in hundredths of all tokens; the most epochs of a leaf; the seed of the orders."""

    domains: Mapping[str, str] = field(default_factory=dict)
    domain_weights: Mapping[str, int] = field(default_factory=dict)
    lang_weights: Mapping[str, int] = field(default_factory=dict)
    source_weights: Mapping[str, int] = field(default_factory=dict)
    percent: int = 100
    epochs: int = 2
    seed: int = 17


def n_tokens(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def _named(column: Column, names: Mapping, other) -> Column:
    out = F.lit(other)
    for name, value in names.items():
        out = F.when(column == name, F.lit(value)).otherwise(out)
    return out


def leaf_columns(m: Mix) -> list[Column]:
    """Domain, language and source of a row of documents; null is a name of its own."""
    source = F.col("source").cast("string")
    return [_named(source, m.domains, "other").alias("_domain"), F.col("lang").alias("_lang"), source.alias("_source")]


def _place(m: Mix, epoch: Column) -> Column:
    """Where a document stands in the order of an epoch, as hex."""
    return F.md5(F.concat_ws(":", F.lit(str(m.seed)), epoch.cast("string"), F.col("doc_id").cast("string")))


def share_out(children: DataFrame, family: list[str], name: str) -> DataFrame:
    """Children (family columns, name, weight, supply, given) with ``budget``, their part of the family's ``given``."""
    big = lambda c: F.col(c).cast("decimal(38,0)")
    ratio = F.col("supply").cast("double") / F.expr("nullif(weight, 0)").cast("double")
    order = [ratio.asc_nulls_last(), F.col(name).asc_nulls_first()]
    here = Window.partitionBy(*family) if family else Window.partitionBy(F.lit(0))
    before = here.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = children.withColumn("left", big("given") - F.coalesce(F.sum("supply").over(before), F.lit(0)))
    out = out.withColumn("open", F.sum("weight").over(here) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    some = (F.col("weight") > 0) | (F.col("supply") == 0)
    out = out.withColumn("full", some & (big("supply") * big("open") <= big("weight") * big("left")))
    filled = lambda c: F.coalesce(F.sum(F.when(F.col("full"), F.col(c))).over(here), F.lit(0))
    out = out.withColumn("rest", big("given") - filled("supply"))
    out = out.withColumn("rest_weight", F.sum("weight").over(here) - filled("weight"))
    part = F.expr("weight * rest div nullif(rest_weight, 0)")
    budget = F.when(F.col("full"), F.col("supply")).otherwise(F.coalesce(part, F.lit(0)))
    return out.withColumn("budget", budget.cast("bigint")).drop("left", "open", "full", "rest", "rest_weight")


def budgets(leaves: DataFrame, m: Mix) -> DataFrame:
    """(leaf, tokens, budget) of a table of leaves (leaf, tokens)."""
    tree = leaves.withColumn("most", F.col("tokens") * m.epochs)
    given = F.floor(F.sum("tokens").over(Window.partitionBy(F.lit(0))) * m.percent / F.lit(100)).cast("bigint")
    family: list[str] = []
    weights = [m.domain_weights, m.lang_weights, m.source_weights]
    parents = None
    for k, (name, weight) in enumerate(zip(LEAF, weights)):
        reached = F.lit(True)
        for below, its in zip(LEAF[k + 1 :], weights[k + 1 :]):
            reached = reached & (_named(F.col(below), its, 1) > 0)
        supply = F.sum(F.when(reached, F.col("most")).otherwise(0)).alias("supply")
        level = tree.groupBy(*family, name).agg(supply, F.sum("tokens").alias("tokens"))
        level = level.withColumn("weight", _named(F.col(name), weight, 1).cast("bigint"))
        if parents is None:
            level = level.withColumn("given", given)
        else:
            up = parents.select(*(F.col(c).alias(f"p{c}") for c in family), F.col("budget").alias("given"))
            level = level.join(up, _same([F.col(c) for c in family], [F.col(f"p{c}") for c in family]))
            level = level.drop(*(f"p{c}" for c in family))
        parents = share_out(level, family, name)
        family = [*family, name]
    return parents.select(*LEAF, "tokens", "budget")


def _same(one: list[Column], two: list[Column]) -> Column:
    out = F.lit(True)
    for a, b in zip(one, two):
        out = out & a.eqNullSafe(b)
    return out


def _cuts(docs: DataFrame, m: Mix) -> DataFrame:
    """(leaf, epochs, bin, place): whole epochs of each leaf, and where the prefix of one more ends."""
    rows = kept_frame(docs.select(*leaf_columns(m), "doc_id", n_tokens(F.col("text")).alias("n_tokens")))
    leaves = rows.groupBy(*LEAF).agg(F.sum("n_tokens").alias("tokens"))
    whole = F.coalesce(F.expr("budget div nullif(tokens, 0)"), F.lit(0)).cast("int")
    plan = budgets(leaves, m).withColumn("epochs", whole)
    plan = kept_frame(plan.withColumn("rest", F.col("budget") - F.col("epochs") * F.col("tokens")))
    plan = plan.select(*(F.col(c).alias(f"p{c}") for c in LEAF), "epochs", "rest")

    held = [F.col(c) for c in LEAF], [F.col(f"p{c}") for c in LEAF]
    placed = rows.join(if_small(plan, FEW_LEAVES), _same(*held)).withColumn("place", _place(m, F.col("epochs")))
    placed = placed.withColumn("bin", F.conv(F.substring("place", 1, 4), 16, 10).cast("int"))
    bins = placed.groupBy(*LEAF, "epochs", "rest", "bin").agg(F.sum("n_tokens").alias("n_tokens"))
    so_far = Window.partitionBy(*LEAF).orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    bins = bins.withColumn("through", F.sum("n_tokens").over(so_far))
    ends = bins.where("through > rest").groupBy(*LEAF, "epochs").agg(
        F.min("bin").alias("end"), F.min(F.col("through") - F.col("n_tokens")).alias("before")
    )
    ends = kept_frame(ends).select(*(F.col(c).alias(f"e{c}") for c in LEAF), "end", "before")
    ending = [F.col(c) for c in LEAF], [F.col(f"e{c}") for c in LEAF]
    last = placed.join(if_small(ends, FEW_LEAVES), _same(*ending) & (F.col("bin") == F.col("end")))
    by_place = Window.partitionBy(*LEAF).orderBy("place")  # rows that share a place share their fate
    last = last.withColumn("through", F.col("before") + F.sum("n_tokens").over(by_place)).where("through <= rest")
    last = last.groupBy(*LEAF).agg(F.max("place").alias("place"))
    last = last.select(*(F.col(c).alias(f"l{c}") for c in LEAF), "place")
    out = plan.join(ends, _same(held[1], ending[1]), "left")
    out = out.join(last, _same(held[1], [F.col(f"l{c}") for c in LEAF]), "left")
    return out.select(*(f"p{c}" for c in LEAF), "epochs", "end", F.coalesce("place", F.lit("")).alias("place"))


def mixed(docs: DataFrame, m: Mix, epoch: str | None = None) -> DataFrame:
    """The rows of docs that make up the mix, all columns; a row comes once for each of its epochs.

    docs has doc_id, text, lang and source.  ``epoch`` names a column to add with the number of the epoch, in place
    of one of docs of that name.  A null language or source is a name of its own, and a null text has no tokens.
    Documents without tokens cost nothing and go with the prefix they stand in.  Rows of a leaf that share a doc_id
    are taken together.  The budgets of a family are rounded down, and a prefix never goes beyond its budget.  Names
    of docs that start with ``_mix`` or ``_own`` are not for use.  An empty table gives no rows.
    """
    cuts = kept_frame(_cuts(docs.select("doc_id", "text", "lang", "source"), m))
    cuts = cuts.select(*(F.col(c).alias(f"_mix{c}") for c in cuts.columns))
    leaf = [F.col(f"_own{c}") for c in LEAF]
    own = [c.alias(f"_own{name}") for c, name in zip(leaf_columns(m), LEAF)]
    rows = docs.select(*(f"`{c}`" for c in docs.columns), *own)
    rows = rows.join(if_small(cuts, FEW_LEAVES), _same(leaf, [F.col(f"_mixp{c}") for c in LEAF]))
    rows = rows.withColumn("_mix_at", _place(m, F.col("_mixepochs")))
    at_bin = F.conv(F.substring("_mix_at", 1, 4), 16, 10).cast("int")
    inside = F.col("_mixend").isNull() | (at_bin < F.col("_mixend"))
    inside = inside | ((at_bin == F.col("_mixend")) & (F.col("_mix_at") <= F.col("_mixplace")))
    copies = F.col("_mixepochs") + inside.cast("int")
    rows = rows.withColumn("_mix_n", copies).where("_mix_n > 0")
    rows = rows.withColumn("_mix_epoch", F.explode(F.sequence(F.lit(0), F.col("_mix_n") - 1)))
    added = [] if epoch is None else [F.col("_mix_epoch").alias(epoch)]
    return rows.select(*(f"`{c}`" for c in docs.columns if c != epoch), *added)
