"""Defaults that must not depend on the given tables, and checks that can fail."""

import datetime

from pyspark.sql import functions as F

from storelens.operators.joins import anti
from storelens.plans import analytics, quality


def test_as_of_defaults_to_today(spark):
    today = datetime.date.today()
    dim = spark.createDataFrame([("a", "c", 4.5, today - datetime.timedelta(days=3))], "app_name string, category string, rating double, last_updated_date date")
    assert analytics.q04_recent_high_rated(dim).first().days_since_update in (3, 4)


def test_summary_counts_checks_without_a_value_as_failed(spark):
    report = spark.createDataFrame([("a", "violation", 2), ("b", "violation", None), ("c", "count", 0)], "check_id string, metric_kind string, value long")
    assert tuple(quality.dq_summary(report).first()) == (3, 2, 1, 1)


def test_anti_join_reduces_the_right_side_first(spark):
    left, right = spark.range(10), spark.range(100).select((F.col("id") % 4).alias("id"))
    out = anti(left, right, "id")
    assert sorted(r.id for r in out.collect()) == list(range(4, 10))
    assert "HashAggregate" in out._jdf.queryExecution().executedPlan().toString()
