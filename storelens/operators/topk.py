"""Top-k and rank operators that never funnel a whole table into one task.

* ``top_k``: ORDER BY ... LIMIT k with a total tie-break -> TakeOrderedAndProject
  (k rows per partition, then k rows on one task).
* ``top_k_ranked``: top-k plus RANK/DENSE_RANK over the *whole* table. For any row of a
  top-k prefix, every row ranked strictly above it is also in the prefix, so the global
  rank equals the rank computed inside the k rows (exact, bounded).
* ``rank_at_most``: ``RANK() OVER (ORDER BY x) <= k`` keeping all ties, however many.
  The cut value is the k-th value of the top-k (scalar subquery); rows at or above it are
  kept by a streaming filter; their rank comes from a per-value count of at most k
  distinct values, broadcast back (size bound k, proven by construction).
* ``top_n_per_group``: ROW_NUMBER per group <= n -> partial + final WindowGroupLimit,
  so a hot group sends at most n rows per input partition through the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k(df: DataFrame, order: list[Column], k: int) -> DataFrame:
    return df.orderBy(*order).limit(k)


def top_k_ranked(df: DataFrame, order: list[Column], k: int, rank_order: list[Column],
                 out: str, dense: bool = False) -> DataFrame:
    top = df.orderBy(*order).limit(k)
    fn = F.dense_rank() if dense else F.rank()
    return top.withColumn(out, fn.over(Window.orderBy(*rank_order)).cast("bigint"))


def rank_at_most(df: DataFrame, value: str, k: int, out: str, descending: bool = True) -> DataFrame:
    v = F.col(value)
    ordered = v.desc() if descending else v.asc()
    top_values = df.select(value).where(v.isNotNull()).orderBy(ordered).limit(k)
    cut = (top_values.agg(F.min(value)) if descending else top_values.agg(F.max(value))).scalar()
    keep = df.where(v >= cut) if descending else df.where(v <= cut)
    per_value = keep.groupBy(value).agg(F.count(F.lit(1)).alias("__n"))
    w = Window.orderBy(ordered).rowsBetween(Window.unboundedPreceding, -1)
    ranks = per_value.select(
        value, (F.coalesce(F.sum("__n").over(w), F.lit(0)) + 1).cast("bigint").alias(out))
    return keep.join(F.broadcast(ranks), value, "inner")


def top_n_per_group(df: DataFrame, group: list[str], order: list[Column], n: int,
                    out: str) -> DataFrame:
    w = Window.partitionBy(*group).orderBy(*order)
    return (df.withColumn(out, F.row_number().over(w).cast("bigint"))
            .where(F.col(out) <= n))
