"""Positions and running sums over ordered groups, without a window over a whole group.

The rows are laid out by range of (group, order) and written once; the parts' sums, a row for each group
and part, give what lies before a part, and a window inside (group, part) does the rest. A group that
holds a third of all rows is thereby spread over as many parts as its share, and nothing but counts of
parts is gathered. The order should be total (end it with a row id): rows that are equal in all of it go
to one part.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

PART = "__part"


def running_sums(df: DataFrame, by: list[str], order: list[Column], sums: dict[str, Column | str],
                 totals: dict[str, str] | None = None, name: str = "ordered", parts: int | None = None) -> DataFrame:
    """``df`` with, for each ``out: value`` of ``sums``, the sum of the value over the rows of the same group
    that come before the row (0 for the first).

    ``totals`` maps names of ``sums`` to names of columns that get the group's whole sum; ``parts`` is the number of
    ranges, left to Spark by default. Null group keys are a group; null values count 0.
    """
    value = {out: f"__v_{out}" for out in sums}
    given = df.withColumns({value[o]: F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(0)) for o, c in sums.items()})
    ranges = ([parts] if parts else []) + [F.col(c) for c in by] + order
    laid = cut_lineage(given.repartitionByRange(*ranges).withColumn(PART, F.spark_partition_id()), name)
    sizes = laid.groupBy(*by, PART).agg(*[F.sum(v).alias(v) for v in value.values()])
    whole = Window.partitionBy(*by)
    earlier = whole.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    keys = [f"__k{i}" for i in range(len(by))]
    sizes = sizes.select(
        *[F.col(c).alias(k) for c, k in zip(by, keys, strict=True)], F.col(PART).alias("__p"),
        *[F.coalesce(F.sum(v).over(earlier), F.lit(0)).alias(f"__b_{o}") for o, v in value.items()],
        *[F.sum(value[o]).over(whole).alias(t) for o, t in (totals or {}).items()])
    inside = Window.partitionBy(*by, PART).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = laid.select("*", *[F.coalesce(F.sum(v).over(inside), F.lit(0)).alias(f"__i_{o}") for o, v in value.items()])
    same = reduce(Column.__and__, [local[c].eqNullSafe(sizes[k]) for c, k in zip(by, keys, strict=True)], local[PART] == sizes["__p"])
    return local.join(sizes, same).select(
        *[local[c] for c in df.columns], *[(F.col(f"__b_{o}") + F.col(f"__i_{o}")).alias(o) for o in sums],
        *[F.col(t) for t in (totals or {}).values()])


def positions(df: DataFrame, by: list[str], order: list[Column], pos: str = "pos", n: str = "n",
              name: str = "positions") -> DataFrame:
    """``df`` with the row's position in its group (from 0) and the group's number of rows."""
    return running_sums(df, by, order, {pos: F.lit(1).cast("bigint")}, {pos: n}, name)
