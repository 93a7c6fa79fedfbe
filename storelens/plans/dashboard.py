"""Dashboard computations (D1-D16) as DataFrame jobs.

D1-D11 run on the dashboard's own frames (C14 apps, C15 reviews, built from staging), as
the source dashboard does; D12-D16 are the SQL statements it shows, run on the star.
The two frames are plain lazy DataFrames; a caller that renders many tabs should
``cache()`` them once (``dashboard(...)`` does).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.quantiles import exact_quantiles
from ..operators.shares import rnd, share_of_total
from ..operators.topk import top_k
from ..sources.testdata import popular_staging_apps, staging_apps, staging_reviews, star
from .star import dashboard_apps, dashboard_reviews

C = F.col


@dataclass(frozen=True)
class Filters:
    """Optional equality filters; category / type never filter the reviews."""
    category: str | None = None
    app_type: str | None = None
    sentiment: str | None = None


def apply_filters(apps: DataFrame, reviews: DataFrame, f: Filters) -> tuple[DataFrame, DataFrame]:
    if f.category is not None:
        apps = apps.where(C("category") == f.category)
    if f.app_type is not None:
        apps = apps.where(C("type") == f.app_type)
    if f.sentiment is not None:
        reviews = reviews.where(C("sentiment") == f.sentiment)
    return apps, reviews


def filter_values(apps: DataFrame) -> DataFrame:
    return apps.where(C("category").isNotNull()).select("category").distinct().orderBy("category")


def kpis(apps: DataFrame, reviews: DataFrame) -> DataFrame:
    a = apps.agg(F.count(F.lit(1)).cast("bigint").alias("total_apps"),
                 rnd(F.avg("rating"), 4).alias("avg_rating"),
                 F.sum("installs_clean").alias("total_installs"))
    n_reviews = reviews.agg(F.count(F.lit(1))).scalar()
    return a.withColumn("total_reviews", n_reviews.cast("bigint"))


ALL = "(all)"


def filter_cube(apps: DataFrame, reviews: DataFrame) -> DataFrame:
    """The KPIs under every choice of the filters (D1-D3) in one pass over each frame: a row for each category and
    type and each sentiment, ``(all)`` where there is no filter. As small as the lists of values the filters offer."""
    def name(c):
        return F.when(F.grouping(c) == 1, ALL).otherwise(C(c)).alias(c)

    no = F.lit(None)
    a = apps.where(C("category").isNotNull() & C("type").isNotNull()).cube("category", "type").agg(
        name("category").alias("c"), name("type").alias("t"), F.count(F.lit(1)).cast("bigint").alias("total"),
        rnd(F.avg("rating"), 4).alias("avg_rating"), F.sum("installs_clean").alias("total_installs"))
    r = reviews.rollup("sentiment").agg(name("sentiment").alias("s"), F.count(F.lit(1)).cast("bigint").alias("total"))
    return a.select(F.lit("apps").alias("frame"), C("c").alias("category"), C("t").alias("type"), F.lit(ALL).alias("sentiment"),
                    "total", "avg_rating", "total_installs").unionByName(r.select(
        F.lit("reviews").alias("frame"), F.lit(ALL).alias("category"), F.lit(ALL).alias("type"), C("s").alias("sentiment"),
        "total", no.cast("double").alias("avg_rating"), no.cast("double").alias("total_installs")))


def kpis_of(cube: DataFrame, f: Filters) -> DataFrame:
    """D3 for any filters, looked up in the cube."""
    is_app = (C("frame") == "apps") & (C("category") == (f.category or ALL)) & (C("type") == (f.app_type or ALL))
    is_review = (C("frame") == "reviews") & (C("sentiment") == (f.sentiment or ALL))
    pick = lambda cond, c: F.max(F.when(cond, C(c)))
    return cube.agg(F.coalesce(pick(is_app, "total"), F.lit(0)).cast("bigint").alias("total_apps"), pick(is_app, "avg_rating").alias("avg_rating"),
                    pick(is_app, "total_installs").alias("total_installs"),
                    F.coalesce(pick(is_review, "total"), F.lit(0)).cast("bigint").alias("total_reviews"))


def top_apps(apps: DataFrame, k: int = 15) -> DataFrame:
    rows = apps.select("raw_app_id", "app", "category", "installs_clean", "rating", "reviews")
    return top_k(rows, [C("installs_clean").desc_nulls_last(), C("rating").desc_nulls_last(),
                        C("raw_app_id")], k)


def low_rated_popular(apps: DataFrame, k: int = 10, min_installs: float = 1e7) -> DataFrame:
    rows = apps.where(C("installs_clean") >= min_installs).select(
        "raw_app_id", "app", "category", "installs_clean", "rating", "reviews")
    return top_k(rows, [C("rating").asc_nulls_last(), C("raw_app_id")], k)


def sentiment_counts(reviews: DataFrame) -> DataFrame:
    return (reviews.where(C("sentiment").isNotNull()).groupBy("sentiment")
            .agg(F.count(F.lit(1)).cast("bigint").alias("count")))


def polarity_by_sentiment(reviews: DataFrame) -> DataFrame:
    return (reviews.where(C("sentiment").isNotNull()).groupBy("sentiment")
            .agg(rnd(F.avg("sentiment_polarity"), 6).alias("mean_polarity")))


def rating_by_type(apps: DataFrame) -> DataFrame:
    return (apps.where(C("type").isNotNull()).groupBy("type")
            .agg(F.count("rating").cast("bigint").alias("count"),
                 rnd(F.avg("rating"), 6).alias("mean")))


def price_box(apps: DataFrame) -> DataFrame:
    """Per-category five-number summary of paid prices with 1.5 IQR fences.

    The quantiles (linear interpolation) are exact order statistics by histogram refinement, so a category with
    very many distinct prices is no task of its own; the quantiles at 0 and 1 are the least and greatest price.
    """
    paid = apps.where((C("price_clean") > 0) & C("category").isNotNull())
    q = exact_quantiles(paid, ["category"], "price_clean", [0, 0.25, 0.5, 0.75, 1], ["min_price", "q1", "med", "q3", "max_price"], "n_paid")
    q1, med, q3 = C("q1"), C("med"), C("q3")
    return q.select("category", "n_paid", rnd(C("min_price"), 6).alias("min_price"),
                    rnd(q1, 6).alias("q1"), rnd(med, 6).alias("median"), rnd(q3, 6).alias("q3"),
                    rnd(C("max_price"), 6).alias("max_price"),
                    rnd(q1 - (q3 - q1) * 1.5, 6).alias("lower_fence"),
                    rnd(q3 + (q3 - q1) * 1.5, 6).alias("upper_fence"))


def category_summary(apps: DataFrame, k: int = 15) -> DataFrame:
    g = (apps.where(C("category").isNotNull()).groupBy("category")
         .agg(F.count("app").cast("bigint").alias("total_apps"),
              rnd(F.avg("rating"), 6).alias("avg_rating"),
              F.sum("installs_clean").alias("total_installs")))
    return top_k(g, [C("total_installs").desc_nulls_last(), C("category")], k)


def rating_histogram(apps: DataFrame, bins: int = 20, lo: int = 1, hi: int = 5) -> DataFrame:
    """Fixed-width bins over [lo, hi]; values outside are clamped to the edge bins."""
    width = (hi - lo) / bins
    r = C("rating").cast("decimal(10,4)")
    idx = F.floor((r - F.lit(lo)) * F.lit(bins) / F.lit(hi - lo))
    idx = F.greatest(F.lit(0), F.least(F.lit(bins - 1), idx)).cast("bigint")
    g = (apps.where(C("rating").isNotNull()).groupBy(idx.alias("bin_index"))
         .agg(F.count(F.lit(1)).cast("bigint").alias("app_count")))
    return g.select("bin_index", rnd(F.lit(lo) + C("bin_index") * F.lit(width), 4).alias("bin_start"),
                    rnd(F.lit(lo) + (C("bin_index") + 1) * F.lit(width), 4).alias("bin_end"),
                    "app_count")


# ------------------------------------------------------------- the shown SQL (on the star)
def sentiment_share_all(fact: DataFrame) -> DataFrame:
    g = fact.groupBy("sentiment").agg(F.count(F.lit(1)).cast("bigint").alias("total_reviews"))
    return share_of_total(g, "total_reviews", "pct_of_total")


def paid_avg(dim: DataFrame) -> DataFrame:
    return dim.groupBy("is_paid").agg(F.count(F.lit(1)).cast("bigint").alias("total_apps"),
                                      rnd(F.avg("rating"), 6).alias("avg_rating"))


def category_installs(dim: DataFrame) -> DataFrame:
    return dim.groupBy("category").agg(
        F.count(F.lit(1)).cast("bigint").alias("total_apps"),
        F.sum("installs_count").cast("bigint").alias("total_installs"))


def rating_counts(dim: DataFrame) -> DataFrame:
    return (dim.where(C("rating").isNotNull()).groupBy(C("rating").cast("double").alias("rating"))
            .agg(F.count(F.lit(1)).cast("bigint").alias("app_count")))


def low_rated_sql(dim: DataFrame, k: int = 15) -> DataFrame:
    rows = dim.where(C("installs_count") >= 10000000).select(
        "app_name", "category", "installs_count", C("rating").cast("double").alias("rating"),
        "reviews_count")
    return top_k(rows, [C("rating").asc_nulls_first(), C("app_name")], k)


def dashboard(spark: SparkSession, sf_dir: str, filters: Filters = Filters()) -> dict[str, DataFrame]:
    """All tab frames for one filter selection; the two base frames are cached once."""
    apps = dashboard_apps(staging_apps(spark, sf_dir)).cache()
    reviews = dashboard_reviews(staging_reviews(spark, sf_dir)).cache()
    a, r = apply_filters(apps, reviews, filters)
    return {"kpis": kpis(a, r), "top_apps": top_apps(a), "low_rated_popular": low_rated_popular(a),
            "sentiment_counts": sentiment_counts(r), "polarity": polarity_by_sentiment(r),
            "rating_by_type": rating_by_type(a), "price_box": price_box(a),
            "category_summary": category_summary(a), "rating_histogram": rating_histogram(a),
            "filter_values": filter_values(apps)}


# ----------------------------------------------------------------------------- keyed jobs
def _frames(spark, sf, filters: Filters = Filters()):
    apps = dashboard_apps(staging_apps(spark, sf))
    reviews = dashboard_reviews(staging_reviews(spark, sf))
    return apply_filters(apps, reviews, filters)


def _apps(fn, filters: Filters = Filters()):
    return lambda spark, sf: fn(_frames(spark, sf, filters)[0])


def _reviews(fn, filters: Filters = Filters()):
    return lambda spark, sf: fn(_frames(spark, sf, filters)[1])


def _dim(fn):
    return lambda spark, sf: fn(star(spark, sf)[0])


def _fact(fn):
    return lambda spark, sf: fn(star(spark, sf)[1])


EXAMPLE_FILTERS = Filters(category="2-HIGH", app_type="Free", sentiment="Positive")

QUERIES = {
    "d_filters": _apps(lambda a: a, EXAMPLE_FILTERS),
    "d_filters_reviews": _reviews(lambda r: r, EXAMPLE_FILTERS),
    "d_filter_values": _apps(filter_values),
    "d_kpis": lambda spark, sf: kpis(*_frames(spark, sf)),
    "d_kpis_filtered": lambda spark, sf: kpis(*_frames(spark, sf, EXAMPLE_FILTERS)),
    "d_filter_cube": lambda spark, sf: filter_cube(*_frames(spark, sf)),
    "d_kpis_from_cube": lambda spark, sf: kpis_of(filter_cube(*_frames(spark, sf)), EXAMPLE_FILTERS),
    "d_top_apps": _apps(top_apps),
    "d_low_rated_popular": _apps(low_rated_popular),
    "d_low_rated_popular_dirty": lambda spark, sf: low_rated_popular(dashboard_apps(popular_staging_apps(spark, sf))),
    "d_sentiment_counts": _reviews(sentiment_counts),
    "d_polarity_by_sentiment": _reviews(polarity_by_sentiment),
    "d_rating_by_type": _apps(rating_by_type),
    "d_price_box": _apps(price_box),
    "d_category_summary": _apps(category_summary),
    "d_rating_histogram": _apps(rating_histogram),
    "d_sentiment_share_all": _fact(sentiment_share_all),
    "d_paid_avg": _dim(paid_avg),
    "d_category_installs": _dim(category_installs),
    "d_rating_counts": _dim(rating_counts),
    "d_low_rated_sql": _dim(low_rated_sql),
}
