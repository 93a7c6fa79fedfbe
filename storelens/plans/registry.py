"""Key -> (builder, oracle SQL) registry consumed by ``__spark_entry__``.

Every builder takes ``(spark, sf_dir)``, reads the given parquet tables (or views Spark
derives from them) and returns a DataFrame; keys that take several passes (quantiles, models, the suite) run the
earlier ones while it is built.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.testdata import star
from ..oracle import analytics as oracle_analytics
from ..oracle import corpus as oracle_corpus
from ..oracle import dashboard as oracle_dashboard
from ..oracle import evaluation as oracle_evaluation
from ..oracle import quality as oracle_quality
from ..oracle import star_build as oracle_star_build
from . import analytics, classifier, corpus, dashboard, evaluation, modeling, quality, suite
from . import star as star_plans

Builder = Callable[[SparkSession, str], DataFrame]


def _on_star(fn) -> Builder:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        dim, fact = star(spark, sf_dir)
        return fn(dim, fact)
    run.__name__ = getattr(fn, "__name__", "query")
    return run


def queries() -> dict[str, Builder]:
    out: dict[str, Builder] = {k: _on_star(v) for k, v in analytics.QUERIES.items()}
    for mod in (star_plans, quality, suite, dashboard, corpus, evaluation, modeling, classifier):
        out |= mod.QUERIES
    return out


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for mod in (oracle_analytics, oracle_star_build, oracle_quality, oracle_dashboard, oracle_corpus, oracle_evaluation):
        out |= mod.ORACLE
    return out
