"""Fused data-quality suite (V1.1-V13).

The source runs 38 separate statements. Here every count-type check on a table is one
conditional aggregate inside a *single* scan of that table; the per-table one-row results
are stacked into long rows ``(check_id, validation, metric_kind, value)``. Detail checks
(duplicates, unreviewed list, size samples, stats) are their own small jobs. The
violation collector keeps checks of kind ``violation`` with a value > 0.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.joins import anti
from ..operators.shares import rnd
from ..operators.topk import top_k
from ..sources.testdata import staging_apps, staging_reviews, star
from .star import build_dim_apps

C = F.col
#: The date of the given tables, for the registered queries; the operators default to today.
AS_OF = _dt.date(2001, 12, 31)

# Check ids and labels of the validation suite, in suite order.
# (check_id, validation label, metric kind)
CHECKS = [
    ("V1.1", "stg_google_play_apps", "row_count"),
    ("V1.2", "stg_google_play_reviews", "row_count"),
    ("V2.1", "dim_apps", "row_count"),
    ("V2.2", "fact_user_reviews", "row_count"),
    ("V3.1", "dim_apps.app_name IS NULL", "violation"),
    ("V3.2", "dim_apps.category IS NULL", "violation"),
    ("V3.3", "dim_apps.rating IS NULL", "violation"),
    ("V3.4", "dim_apps.installs_count IS NULL", "violation"),
    ("V3.5", "dim_apps.content_rating IS NULL", "violation"),
    ("V3.6", "fact_user_reviews.app_id IS NULL", "violation"),
    ("V3.7", "fact_user_reviews.sentiment IS NULL", "violation"),
    ("V5.1", "rating NOT BETWEEN 0 AND 5", "violation"),
    ("V5.2", "installs_count < 0", "violation"),
    ("V5.3", "price_usd < 0", "violation"),
    ("V5.5", "sentiment_polarity NOT BETWEEN -1 AND 1", "violation"),
    ("V5.6", "sentiment_subjectivity NOT BETWEEN 0 AND 1", "violation"),
    ("V6.1", "empty_or_null_review_text", "violation"),
    ("V7.1", "orphan_fact_user_reviews", "violation"),
    ("V7.1r", "orphan_raw_reviews", "violation"),
    ("V8.2", "apps_without_reviews", "count"),
    ("V9.1", "categories_with_null", "violation"),
    ("V9.2", "distinct_categories", "count"),
    ("V9.3", "distinct_genres", "count"),
    ("V10.1", "last_updated_date IS NULL", "violation"),
    ("V10.2", "last_updated_date > NOW()", "violation"),
    ("V11.1", "size_in_mb IS NULL", "violation"),
]
SENTIMENT_DOMAIN = ["Positive", "Negative", "Neutral"]


def _stack(one_row: DataFrame, ids: list[str]) -> DataFrame:
    meta = {c[0]: c for c in CHECKS}
    structs = [F.struct(F.lit(i).alias("check_id"), F.lit(meta[i][1]).alias("validation"),
                        F.lit(meta[i][2]).alias("metric_kind"),
                        C(_col(i)).cast("bigint").alias("value")) for i in ids]
    return one_row.select(F.inline(F.array(*structs)))


def _col(check_id: str) -> str:
    return "c_" + check_id.replace(".", "_")


def dim_expressions(as_of=None) -> dict[str, Column]:
    """The counts over the dimension. ``as_of`` is the date after which an update lies in the future; today if not given."""
    r, inst, price, cat = C("rating"), C("installs_count"), C("price_usd"), C("category")
    d = C("last_updated_date")
    today = F.current_date() if as_of is None else F.lit(as_of)
    return {
        "V2.1": F.count(F.lit(1)),
        "V3.1": F.count_if(C("app_name").isNull()),
        "V3.2": F.count_if(cat.isNull()),
        "V3.3": F.count_if(r.isNull()),
        "V3.4": F.count_if(inst.isNull()),
        "V3.5": F.count_if(C("content_rating").isNull()),
        "V5.1": F.count_if(r.isNotNull() & ((r < 0) | (r > 5))),
        "V5.2": F.count_if(inst < 0),
        "V5.3": F.count_if(price < 0),
        "V9.1": F.count_if(cat.isNull() | (F.trim(cat) == "")),
        "V9.2": F.count_distinct(cat),
        "V9.3": F.count_distinct(C("genres")),
        "V10.1": F.count_if(d.isNull()),
        "V10.2": F.count_if(d > today),
        "V11.1": F.count_if(C("size_in_mb").isNull()),
    }


def fact_expressions() -> dict[str, Column]:
    p, s, t = C("sentiment_polarity"), C("sentiment_subjectivity"), C("review_text")
    return {
        "V2.2": F.count(F.lit(1)),
        "V3.6": F.count_if(C("app_id").isNull()),
        "V3.7": F.count_if(C("sentiment").isNull()),
        "V5.5": F.count_if(p.isNotNull() & ((p < -1) | (p > 1))),
        "V5.6": F.count_if(s.isNotNull() & ((s < 0) | (s > 1))),
        "V6.1": F.count_if(t.isNull() | (F.trim(t) == "")),
    }


def dim_checks(dim: DataFrame, as_of=None, ids: list[str] | None = None) -> DataFrame:
    """The checks over the dimension (all, or ``ids``: only their aggregates are computed)."""
    asked = {i: c for i, c in dim_expressions(as_of).items() if ids is None or i in ids}
    return _stack(dim.agg(*[c.alias(_col(i)) for i, c in asked.items()]), list(asked))


def fact_checks(fact: DataFrame) -> DataFrame:
    checks = fact_expressions()
    return _stack(fact.agg(*[c.alias(_col(i)) for i, c in checks.items()]), list(checks))


def staging_checks(stg_apps: DataFrame, stg_reviews: DataFrame) -> DataFrame:
    a = _stack(stg_apps.agg(F.count(F.lit(1)).alias(_col("V1.1"))), ["V1.1"])
    b = _stack(stg_reviews.agg(F.count(F.lit(1)).alias(_col("V1.2"))), ["V1.2"])
    return a.unionAll(b)


def reviewed_keys(fact: DataFrame) -> DataFrame:
    return fact.where(C("review_id").isNotNull()).select("app_id")


def coverage_checks(dim: DataFrame, fact: DataFrame, stg_reviews: DataFrame,
                    built_dim: DataFrame) -> DataFrame:
    orphans = anti(fact.select("app_id"), dim.select("app_id"), "app_id").agg(
        F.count(F.lit(1)).alias(_col("V7.1")))
    raw = stg_reviews.select(F.trim(C("app")).alias("app_name"))
    raw_orphans = anti(raw, built_dim.select("app_name"), "app_name").agg(
        F.count(F.lit(1)).alias(_col("V7.1r")))
    unreviewed = anti(dim.select("app_id"), reviewed_keys(fact), "app_id").agg(
        F.count(F.lit(1)).alias(_col("V8.2")))
    return (_stack(orphans, ["V7.1"]).unionAll(_stack(raw_orphans, ["V7.1r"]))
            .unionAll(_stack(unreviewed, ["V8.2"])))


def dq_report(dim: DataFrame, fact: DataFrame, stg_apps: DataFrame, stg_reviews: DataFrame,
              as_of=None) -> DataFrame:
    built = build_dim_apps(stg_apps)
    return (staging_checks(stg_apps, stg_reviews).unionAll(dim_checks(dim, as_of))
            .unionAll(fact_checks(fact)).unionAll(coverage_checks(dim, fact, stg_reviews, built)))


def dq_issues(report: DataFrame) -> DataFrame:
    return report.where((C("metric_kind") == "violation") & (C("value") > 0))


def dq_summary(report: DataFrame) -> DataFrame:
    """A check that gave a value passes, one without a value failed; violations are issues."""
    return report.agg(
        F.count(F.lit(1)).cast("bigint").alias("total_checks"),
        F.count("value").cast("bigint").alias("passed"),
        F.count_if(C("value").isNull()).cast("bigint").alias("failed"),
        F.count_if((C("metric_kind") == "violation") & (C("value") > 0)).cast("bigint")
        .alias("issues"))


# ----------------------------------------------------------------------------- detail checks
def dup_apps(dim: DataFrame) -> DataFrame:
    return (dim.groupBy("app_name").agg(F.count(F.lit(1)).cast("bigint").alias("occurrence_count"))
            .where(C("occurrence_count") > 1))


def dup_reviews(fact: DataFrame, k: int = 20) -> DataFrame:
    g = (fact.where(C("review_text").isNotNull()).groupBy("app_id", "review_text")
         .agg(F.count(F.lit(1)).cast("bigint").alias("occurrence_count"))
         .where(C("occurrence_count") > 1))
    return top_k(g, [C("occurrence_count").desc(), C("app_id"), C("review_text")], k)


def bad_sentiment(fact: DataFrame) -> DataFrame:
    return (fact.where(C("sentiment").isNotNull() & ~C("sentiment").isin(SENTIMENT_DOMAIN))
            .groupBy("sentiment").agg(F.count(F.lit(1)).cast("bigint").alias("total_rows")))


def unreviewed_list(dim: DataFrame, fact: DataFrame, k: int = 25) -> DataFrame:
    rows = anti(dim.select("app_id", "app_name", "category"), reviewed_keys(fact), "app_id")
    return top_k(rows, [C("app_name"), C("app_id")], k)


def category_breakdown(dim: DataFrame) -> DataFrame:
    return dim.groupBy("category").agg(F.count(F.lit(1)).cast("bigint").alias("app_count"))


def date_range(dim: DataFrame) -> DataFrame:
    d = C("last_updated_date")
    return dim.where(d.isNotNull()).agg(F.min(d).alias("earliest_update"),
                                        F.max(d).alias("latest_update"))


def size_large(dim: DataFrame, k: int = 10, limit_mb: int = 500) -> DataFrame:
    rows = dim.where(C("size_in_mb") > limit_mb).select(
        "app_name", C("size_in_mb").cast("double").alias("size_in_mb"), "size_raw")
    return top_k(rows, [C("size_in_mb").desc(), C("app_name")], k)


def size_sample(dim: DataFrame, k: int = 10) -> DataFrame:
    rows = dim.where(C("size_in_mb").isNotNull()).select(
        "app_name", "size_raw", C("size_in_mb").cast("double").alias("size_in_mb"))
    return top_k(rows, [C("size_in_mb").desc(), C("app_name")], k)


def summary_stats(dim: DataFrame, fact: DataFrame) -> DataFrame:
    """V12.1-12.5: min / max / rounded avg / non-null count; one scan per table."""
    def block(df, specs):
        aggs = []
        for name, scale in specs:
            c = C(name)
            aggs += [F.min(c).cast("double").alias(f"{name}__min"),
                     F.max(c).cast("double").alias(f"{name}__max"),
                     rnd(F.avg(c), scale).alias(f"{name}__avg"),
                     F.count(c).cast("bigint").alias(f"{name}__n")]
        row = df.agg(*aggs)
        structs = [F.struct(F.lit(n).alias("metric"), C(f"{n}__min").alias("min_value"),
                            C(f"{n}__max").alias("max_value"), C(f"{n}__avg").alias("avg_value"),
                            C(f"{n}__n").alias("non_null_count")) for n, _ in specs]
        return row.select(F.inline(F.array(*structs)))
    return block(dim, [("rating", 2), ("installs_count", 0), ("price_usd", 2)]).unionAll(
        block(fact, [("sentiment_polarity", 4), ("sentiment_subjectivity", 4)]))


# ----------------------------------------------------------------------------- keyed jobs
def _report(spark: SparkSession, sf: str) -> DataFrame:
    dim, fact = star(spark, sf)
    return dq_report(dim, fact, staging_apps(spark, sf), staging_reviews(spark, sf), AS_OF)


_FACT_IDS = {"V2.2", "V3.6", "V3.7", "V5.5", "V5.6", "V6.1"}
_COVERAGE_IDS = {"V7.1", "V7.1r", "V8.2"}


def _block_of(check_id: str) -> str:
    if check_id.startswith("V1."):
        return "staging"
    if check_id in _FACT_IDS:
        return "fact"
    if check_id in _COVERAGE_IDS:
        return "coverage"
    return "dim"


def _checks(ids: list[str], label: str = "validation", value: str = "violation_count"):
    """A keyed slice of the report: only the table scans the slice needs are planned."""
    def run(spark: SparkSession, sf: str) -> DataFrame:
        dim, fact = star(spark, sf)
        stg_a, stg_r = staging_apps(spark, sf), staging_reviews(spark, sf)
        builders = {
            "staging": lambda: staging_checks(stg_a, stg_r),
            "dim": lambda: dim_checks(dim, AS_OF, ids),
            "fact": lambda: fact_checks(fact),
            "coverage": lambda: coverage_checks(dim, fact, stg_r, build_dim_apps(stg_a)),
        }
        blocks = sorted({_block_of(i) for i in ids})
        out = builders[blocks[0]]()
        for b in blocks[1:]:
            out = out.unionAll(builders[b]())
        return out.where(C("check_id").isin(ids)).select(
            C("validation").alias(label), C("value").alias(value))
    return run


def _on_star(fn):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        dim, fact = star(spark, sf)
        return fn(dim, fact)
    return run


QUERIES = {
    "v_report": _report,
    "v_issues": lambda spark, sf: dq_issues(_report(spark, sf)),
    "v_summary": lambda spark, sf: dq_summary(_report(spark, sf)),
    "v_rowcounts": _checks(["V1.1", "V1.2", "V2.1", "V2.2"], "table_name", "total_rows"),
    "v_nulls_dim": _checks(["V3.1", "V3.2", "V3.3", "V3.4", "V3.5"]),
    "v_nulls_fact": _checks(["V3.6", "V3.7"]),
    "v_dup_apps": _on_star(lambda d, f: dup_apps(d)),
    "v_dup_reviews": _on_star(lambda d, f: dup_reviews(f)),
    "v_ranges": _checks(["V5.1", "V5.2", "V5.3", "V5.5", "V5.6"]),
    "v_bad_sentiment": _on_star(lambda d, f: bad_sentiment(f)),
    "v_empty_text": _checks(["V6.1"]),
    "v_orphans": _checks(["V7.1", "V7.1r"]),
    "v_unreviewed_list": _on_star(unreviewed_list),
    "v_unreviewed_count": _checks(["V8.2"], "validation", "total_count"),
    "v_blank_category": _checks(["V9.1"]),
    "v_distincts": _checks(["V9.2", "V9.3"], "metric", "total_count"),
    "v_category_breakdown": _on_star(lambda d, f: category_breakdown(d)),
    "v_dates": _checks(["V10.1", "V10.2"]),
    "v_date_range": _on_star(lambda d, f: date_range(d)),
    "v_size_null": _checks(["V11.1"]),
    "v_size_large": _on_star(lambda d, f: size_large(d)),
    "v_size_sample": _on_star(lambda d, f: size_sample(d)),
    "v_stats": _on_star(summary_stats),
}
