"""Shares of a total and rounding with exact decimal semantics.

Percentages are computed in DECIMAL (exact, half-up rounding like the source SQL engine)
and returned as DOUBLE. The total is a scalar subquery, so no single-partition window is
needed however many groups there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rnd(c: Column, scale: int) -> Column:
    """Round half-up on the exact decimal value, return DOUBLE."""
    return F.round(c.cast("decimal(38,10)"), scale).cast("double")


def pct(num: Column, den: Column, scale: int = 2) -> Column:
    """``round(num * 100.0 / den, scale)`` in exact decimal arithmetic; NULL when den is 0/NULL."""
    n = num.cast("decimal(30,4)")
    d = F.nullif(den.cast("decimal(30,4)"), F.lit(0).cast("decimal(30,4)"))
    return F.round(n * F.lit(100) / d, scale).cast("double")


def share_of_total(df: DataFrame, n: str, out: str, scale: int = 2,
                   partition: list[str] | None = None, many_groups: bool = False) -> DataFrame:
    """Add ``out = n * 100 / sum(n)`` over all rows of an already-grouped frame, or within
    ``partition``.

    The denominator is a window over the *grouped* rows: with a bounded grouping (tiers,
    categories, sentiments) that is a handful of rows in one task, and the grouped input is
    computed once. ``many_groups=True`` (high-cardinality groupings) uses a scalar-subquery
    total instead: no single task sees all groups, at the price of aggregating twice.
    """
    if partition:
        return df.withColumn(out, pct(F.col(n), F.sum(n).over(Window.partitionBy(*partition)), scale))
    if many_groups:
        return df.withColumn(out, pct(F.col(n), df.agg(F.sum(n)).scalar(), scale))
    return df.withColumn(out, pct(F.col(n), F.sum(n).over(Window.partitionBy()), scale))
