"""Codes to labels and ordered keyword rules."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from civicflow.functions.text import col


def label(c, mapping: dict, default=None) -> Column:
    """Label of a code, the default for unknown codes and NULL."""
    pairs = F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in mapping.items()))
    found = F.try_element_at(pairs, col(c))
    return found if default is None else F.coalesce(found, F.lit(default))


def range_label(c, ranges: list[tuple[int, int, str]]) -> Column:
    """Label of the closed range a number falls in, else NULL."""
    out = None
    for low, high, name in ranges:
        hit = col(c).between(low, high)
        out = F.when(hit, F.lit(name)) if out is None else out.when(hit, F.lit(name))
    return out


def weight(c, weights: dict[str, float]) -> Column:
    """Share that goes with a label, 0 for every other."""
    return label(c, weights, 0.0)


def first_match(rules: list[tuple[Column, str]]) -> Column:
    """Value of the first rule that holds, else NULL."""
    out = None
    for hit, value in rules:
        out = F.when(hit, F.lit(value)) if out is None else out.when(hit, F.lit(value))
    return out


def last_match(rules: list[tuple[Column, str]]) -> Column:
    """Value of the last rule that holds, else NULL.

    A later rule overwrites an earlier one, so the rules are tried backwards.
    """
    return first_match(list(reversed(rules)))


def keyword_rules(c, contains: list[tuple[str, str]], words: list[tuple[str, str]] = ()) -> Column:
    """First keyword contained in the text, then first whole word."""
    text = col(c)
    rules = [(text.contains(key), value) for key, value in contains]
    rules += [(text.rlike(rf"\b{word}\b"), value) for word, value in words]
    return first_match(rules)
