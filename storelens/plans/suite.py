"""The validation suite as a whole: 38 statements, each judged for itself.

A statement passes if it runs, whatever it finds, and fails if it can't be analysed or its job ends in an error; what
it finds is a violation count or rows. Counts over one table are aggregates of one scan of it. A statement that can't
be analysed (a missing column, a wrong type) is found before anything runs; when a scan ends in an error, its
statements are run in halves until those that cause it stand alone, so one bad value fails one statement and not the suite.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.joins import anti
from ..sources.testdata import dirty_star, staging_apps, staging_reviews, star
from . import quality as Q

C = F.col


@dataclass(frozen=True)
class Statement:
    """``count``: an aggregate over ``table``; ``rows``: a frame from all tables, of which the rows are counted."""
    id: str
    label: str
    kind: str
    table: str = ""
    count: Column | None = None
    rows: Callable[[dict[str, DataFrame]], DataFrame] | None = None


def _stat(column: str, table: str) -> Statement:
    return Statement("", f"{column} statistics", "rows", rows=lambda t: t[table].agg(
        F.min(column), F.max(column), F.avg(column), F.count(column)))


def statements(as_of=None) -> list[Statement]:
    """The suite, in its order."""
    labels = {i: (label, kind) for i, label, kind in Q.CHECKS}
    everything = F.count(F.lit(1))
    counts = {"stg_apps": {"V1.1": everything}, "stg_reviews": {"V1.2": everything},
              "dim": Q.dim_expressions(as_of), "fact": Q.fact_expressions()}
    out = [Statement(i, *labels[i], table=t, count=c) for t, checks in counts.items() for i, c in checks.items()]
    rows = {
        "V4.1": ("duplicate app names", lambda t: Q.dup_apps(t["dim"])),
        "V4.2": ("duplicate reviews", lambda t: Q.dup_reviews(t["fact"])),
        "V5.4": ("sentiment outside the domain", lambda t: Q.bad_sentiment(t["fact"])),
        "V7.1": ("orphan_fact_user_reviews", lambda t: anti(t["fact"].select("app_id"), t["dim"].select("app_id"), "app_id")),
        "V8.1": ("apps without reviews, by name", lambda t: Q.unreviewed_list(t["dim"], t["fact"])),
        "V8.2": ("apps_without_reviews", lambda t: anti(t["dim"].select("app_id"), Q.reviewed_keys(t["fact"]), "app_id")),
        "V9.4": ("apps by category", lambda t: Q.category_breakdown(t["dim"])),
        "V10.3": ("range of update dates", lambda t: Q.date_range(t["dim"])),
        "V11.2": ("implausible sizes", lambda t: Q.size_large(t["dim"])),
        "V11.3": ("largest sizes", lambda t: Q.size_sample(t["dim"])),
    }
    out += [Statement(i, label, "violation" if i in ("V4.1", "V4.2", "V5.4", "V7.1", "V11.2") else "rows", rows=f) for i, (label, f) in rows.items()]
    stats = [("rating", "dim"), ("installs_count", "dim"), ("price_usd", "dim"), ("sentiment_polarity", "fact"), ("sentiment_subjectivity", "fact")]
    out += [Statement(f"V12.{k}", s.label, s.kind, rows=s.rows) for k, s in enumerate((_stat(*x) for x in stats), 1)]
    return sorted(out, key=lambda s: [int(x) for x in s.id[1:].split(".")])


def _analysed(table: DataFrame, asked: list[Statement], errors: dict[str, str]) -> list[Statement]:
    good = []
    for s in asked:
        try:
            table.agg(s.count)
            good.append(s)
        except PySparkException as e:
            errors[s.id] = type(e).__name__
    return good


def _counted(table: DataFrame, asked: list[Statement], errors: dict[str, str]) -> dict[str, int]:
    """One scan for all of ``asked``; in halves if it ends in an error."""
    if not asked:
        return {}
    try:
        return table.agg(*[s.count.cast("bigint").alias(s.id.replace(".", "_")) for s in asked]).first().asDict()
    except PySparkException as e:
        if len(asked) == 1:
            errors[asked[0].id] = type(e).__name__
            return {}
    half = len(asked) // 2
    return _counted(table, asked[:half], errors) | _counted(table, asked[half:], errors)


def run_suite(tables: dict[str, DataFrame], suite: list[Statement]) -> DataFrame:
    """``(check_id, validation, status, value, error)``: a row for each statement, with the count it gave or the number of its rows."""
    spark = next(iter(tables.values())).sparkSession
    errors: dict[str, str] = {}
    values: dict[str, int] = {}
    for name, table in tables.items():
        mine = _analysed(table, [s for s in suite if s.count is not None and s.table == name], errors)
        values |= {i.replace("_", "."): v for i, v in _counted(table, mine, errors).items()}
    for s in suite:
        if s.rows is not None:
            try:
                values[s.id] = s.rows(tables).count()
            except PySparkException as e:
                errors[s.id] = type(e).__name__
    rows = [(s.id, s.label, s.kind, "failed" if s.id in errors else "passed", values.get(s.id), errors.get(s.id)) for s in suite]
    return spark.createDataFrame(rows, "check_id string, validation string, metric_kind string, status string, value long, error string")


def suite_summary(results: DataFrame) -> DataFrame:
    """Statements, those that ran, those that ended in an error, and those that found violations."""
    return results.agg(
        F.count(F.lit(1)).cast("bigint").alias("total_checks"),
        F.count_if(C("status") == "passed").cast("bigint").alias("passed"),
        F.count_if(C("status") == "failed").cast("bigint").alias("failed"),
        F.count_if((C("metric_kind") == "violation") & (C("value") > 0)).cast("bigint").alias("issues"))


def _tables(spark: SparkSession, sf: str, dirty: bool) -> dict[str, DataFrame]:
    dim, fact = (dirty_star if dirty else star)(spark, sf)
    return {"stg_apps": staging_apps(spark, sf), "stg_reviews": staging_reviews(spark, sf), "dim": dim, "fact": fact}


def _suite(dirty: bool):
    return lambda spark, sf: run_suite(_tables(spark, sf, dirty), statements(Q.AS_OF)).drop("error")


def _dirty_star(fn):
    return lambda spark, sf: fn(*dirty_star(spark, sf))


QUERIES = {
    "v_suite": _suite(False),
    "v_suite_dirty": _suite(True),
    "v_suite_summary": lambda spark, sf: suite_summary(_suite(False)(spark, sf)),
    "v_dup_apps_dirty": _dirty_star(lambda d, f: Q.dup_apps(d)),
    "v_bad_sentiment_dirty": _dirty_star(lambda d, f: Q.bad_sentiment(f)),
    "v_size_large_dirty": _dirty_star(lambda d, f: Q.size_large(d)),
}
