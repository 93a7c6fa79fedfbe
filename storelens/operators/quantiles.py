"""Exact quantiles by group through histogram refinement: no value-to-count map, no sort of a group.

The wanted order statistics of a group start in the interval of all its values. Each round counts the
values of every open interval in ``BINS`` equal bins (with each bin's least and greatest value), and an
order statistic moves into the bin that holds it. The bin is a monotone function of the value
in floating point too, so ranks stay exact. An interval of one value is done; intervals of at most ``FEW`` rows are finished
by counting their values. What is shuffled is bins, added up in the tasks first: a group with a third of
all rows, all distinct, costs a task ``BINS`` rows a round, and so do heavy ties.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

BINS, FEW = 1024, 1 << 16
C = F.col


def _renamed(df: DataFrame, keys: list[str]) -> tuple[DataFrame, Column]:
    """``df`` with its keys under other names, and the null-safe condition that joins it on them."""
    own = {k: f"__of{i}" for i, k in enumerate(keys)}
    return df.withColumnsRenamed(own), reduce(Column.__and__, [C(k).eqNullSafe(C(o)) for k, o in own.items()])


def _step(open_: DataFrame, values: DataFrame, keys: list[str], cell: Column) -> DataFrame:
    """``open_`` targets after one round: ``cell`` is what an interval's values are counted by."""
    spans, same = _renamed(open_.select(*keys, "lo", "hi").distinct(), keys)
    at = [*spans.columns]
    inside = values.join(spans, same & (C("x") >= C("lo")) & (C("x") <= C("hi"))).select(*at, "x")
    counts = inside.groupBy(*at, cell.alias("cell")).agg(F.count(F.lit(1)).alias("held"), F.min("x").alias("least"), F.max("x").alias("most"))
    before = Window.partitionBy(*at).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*at[:-2], C("lo").alias("__lo"), C("hi").alias("__hi"), "held", "least", "most",
                           F.coalesce(F.sum("held").over(before), F.lit(0)).alias("below"))
    hit = same & (C("lo") == C("__lo")) & (C("hi") == C("__hi")) & (C("rank") >= C("below")) & (C("rank") < C("below") + C("held"))
    return open_.join(counts, hit).select(*keys, "target", (C("rank") - C("below")).alias("rank"), C("held").alias("n"),
                                          C("least").alias("lo"), C("most").alias("hi"))


def exact_quantiles(df: DataFrame, by: list[str], value: Column | str, probs: list[float], names: list[str], n: str = "n",
                    bins: int = BINS, few: int = FEW) -> DataFrame:
    """``(*by, n, *names)``: for each group the number of non-null values and their quantiles at ``probs``, with linear
    interpolation, as doubles. Null keys are a group; groups without values have no row. Values are taken as
    doubles and must not be NaN."""
    x = (C(value) if isinstance(value, str) else value).cast("double")
    keys = by or ["__all"]
    values = cut_lineage(df.select(*by, x.alias("x")).where("x is not null"), "quantile-values")
    if not by:
        values = values.withColumn("__all", F.when(C("x").isNotNull(), 1))
    whole = cut_lineage(values.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")), "quantile-groups")
    place = [F.lit(float(p)) * (C("n") - 1) for p in probs]
    ranks = [f(p).cast("bigint") for p in place for f in (F.floor, F.ceil)]
    todo = whole.select(*keys, "n", "lo", "hi", F.posexplode(F.array(*ranks)).alias("target", "rank"))
    done = None
    small = C("n") <= few
    while True:
        todo = cut_lineage(todo.select(*keys, "target", "rank", "n", "lo", "hi"), "quantile-targets")
        ended = todo.where("lo = hi")
        ended = ended.unionByName(_step(todo.where((C("lo") < C("hi")) & small), values, keys, C("x")).select(todo.columns))
        done = ended if done is None else done.unionByName(ended)
        todo = todo.where((C("lo") < C("hi")) & ~small)
        if todo.isEmpty():
            break
        # halves, so that the width of the widest interval is still a number
        share = (C("x") / 2 - C("lo") / 2) / (C("hi") / 2 - C("lo") / 2)
        todo = _step(todo, values, keys, F.least(F.floor(share * bins), F.lit(bins - 1)))
    found = done.groupBy(*keys).agg(*[F.max(F.when(C("target") == t, C("lo"))).alias(f"__s{t}") for t in range(len(ranks))])
    found, same = _renamed(found, keys)
    out = whole.join(found, same)
    between = [F.when(F.floor(p) == F.ceil(p), C(f"__s{2 * i}")).otherwise(
        (F.ceil(p) - p) * C(f"__s{2 * i}") + (p - F.floor(p)) * C(f"__s{2 * i + 1}")) for i, p in enumerate(place)]
    return out.select(*by, C("n").alias(n), *[b.alias(c) for b, c in zip(between, names, strict=True)])
