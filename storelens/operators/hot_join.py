"""Inner join with hot keys salted and replicated, the others hashed as usual.

A key with more than ``1 / parts`` of the left rows is hot; there are fewer than ``parts`` of them, counted with
map-side sums. A hot key's left rows are dealt over as many salts as it has such shares, its right rows are repeated for
each salt, and one join on (key, salt) does the rest, so no task gets more of a key than a share, whatever it holds
and whether or not the engine splits skewed partitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

PARTS = 256
C = F.col


def hot_keys(left: DataFrame, key: str, parts: int = PARTS) -> DataFrame:
    """``(__hot, __salts)``: the keys with more than ``1 / parts`` of the rows, fewer than ``parts``."""
    total = left.where(C(key).isNotNull()).agg(F.count(F.lit(1))).scalar()
    counts = left.where(C(key).isNotNull()).groupBy(C(key).alias("__hot")).agg(F.count(F.lit(1)).alias("__n"))
    return cut_lineage(counts.where(C("__n") * parts > total).select(
        "__hot", F.ceil(C("__n") * parts / total).cast("int").alias("__salts")), "hot-keys")


def hot_join(left: DataFrame, right: DataFrame, key: str, salt_by: list[str], parts: int = PARTS) -> DataFrame:
    """``left`` inner join ``right`` on ``key``, which both have under this name; ``salt_by`` are left columns that tell
    its rows apart."""
    hot = F.broadcast(hot_keys(left, key, parts))  # fewer than `parts` rows
    dealt = left.join(hot, C(key) == C("__hot"), "left").withColumn(
        "__salt", F.when(C("__salts").isNotNull(), F.pmod(F.xxhash64(*salt_by), C("__salts"))).otherwise(0).cast("int"))
    repeated = right.join(hot, C(key) == C("__hot"), "left").withColumn(
        "__salt", F.explode(F.sequence(F.lit(0), F.coalesce("__salts", F.lit(1)) - 1)))
    extra = ("__hot", "__salts")
    return dealt.drop(*extra).join(repeated.drop(*extra), [key, "__salt"]).drop("__salt")
