"""Per-app pre-aggregation of the review fact.

Every fact-side query first collapses reviews to one row per ``app_id`` (partial
aggregation map-side, so a hot app costs one row per partition in the shuffle), and only
then joins the dimension. The join input shrinks from |reviews| to |reviewed apps|.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def per_app_reviews(fact: DataFrame, keys: tuple[str, ...] = ("app_id",)) -> DataFrame:
    s = F.col("sentiment")
    pol = F.col("sentiment_polarity")
    subj = F.col("sentiment_subjectivity")
    return fact.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count("review_id").alias("n_review_id"),
        F.count(s).alias("n_sentiment"),
        F.count_if(s == "Positive").alias("n_positive"),
        F.count_if(s == "Negative").alias("n_negative"),
        F.count_if(s == "Neutral").alias("n_neutral"),
        F.sum(pol).alias("sum_polarity"),
        F.count(pol).alias("n_polarity"),
        F.sum(subj).alias("sum_subjectivity"),
        F.count(subj).alias("n_subjectivity"),
    )
