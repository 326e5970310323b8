"""Column expressions shared by the operators that use DataFrame functions only.

A word is a run of characters other than space, tab, line feed, vertical tab,
form feed and carriage return. A null text has no words.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACES = r"[\x20\x09-\x0D]+"


def own_columns(df: DataFrame) -> list[Column]:
    return [F.col(f"`{c}`") for c in df.columns]


def unused(df: DataFrame, name: str) -> str:
    """``name``, longer by underscores than any column of ``df`` that would clash with it."""
    held = {c.lower() for c in df.columns}
    while name.lower() in held:
        name += "_"
    return name


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` with ``value`` bound once.

    A lambda that names an outer column expression evaluates it again for each
    element once the optimizer has merged projections; a lambda variable is
    evaluated once a row.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def window_hashes(word_array: Column, width: int) -> Column:
    """64-bit hashes of all windows of ``width`` words, in order; empty if there are fewer words."""

    def of(w: Column) -> Column:
        last = F.size(w) - width
        spans = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
        return F.transform(spans, lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(width))))

    return let(F.transform(word_array, lambda x: F.xxhash64(x)), of)
