"""The 37 analytical queries over ``dim_apps`` / ``fact_user_reviews``.

Each ``qNN(dim, fact, **params)`` returns a lazy DataFrame. Shape rules used throughout:

* fact-side queries pre-aggregate reviews per ``app_id`` before touching the dimension
  (``per_app_reviews``), so the join input is one row per reviewed app;
* global RANK / LIMIT goes through ``top_k_ranked`` / ``rank_at_most`` (bounded work,
  exact ranks), never a single-partition window over a whole table;
* per-group top-n uses ``row_number <= n`` (partial WindowGroupLimit before the shuffle);
* shares of a total divide by a window over the already-grouped (few) rows;
* rounding happens on exact decimals (``rnd`` / ``pct``); results are DOUBLE / BIGINT.

Ties under LIMIT / ROW_NUMBER get an explicit tie-break (app name, then key) so results
are deterministic; the source SQL leaves them to the engine.
"""

from __future__ import annotations

import datetime as _dt
from functools import partial

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tiers import (INSTALL_BUCKETS, RATING_TIERS, lower_bound_tiers, price_tier,
                               pricing_model)
from ..operators.joins import anti
from ..operators.quantiles import exact_quantiles
from ..operators.reviews import per_app_reviews
from ..operators.shares import pct, rnd, share_of_total
from ..operators.topk import rank_at_most, top_k, top_k_ranked, top_n_per_group

C = F.col
#: The date of the given tables, for the registered query; the operator defaults to today.
AS_OF = _dt.date(2001, 12, 31)


def _dbl(name: str, alias: str | None = None):
    return C(name).cast("double").alias(alias or name)


def _count():
    return F.count(F.lit(1)).cast("bigint")


def _ratio(num, den):
    """num / den with NULL (not an ANSI error) when den is 0 or NULL."""
    return num / F.nullif(den, F.lit(0))


# ----------------------------------------------------------------------------- performance
def q01_top_installs(dim: DataFrame, fact: DataFrame | None = None, k: int = 15) -> DataFrame:
    rows = dim.where(C("installs_count").isNotNull()).select(
        "app_name", "category", "installs_count", _dbl("rating"), "reviews_count")
    return top_k_ranked(
        rows, [C("installs_count").desc(), C("rating").desc_nulls_last(), C("app_name")], k,
        [C("installs_count").desc()], "install_rank")


def q02_quality_rank(dim: DataFrame, fact: DataFrame | None = None, k: int = 15,
                     min_installs: int = 1000000) -> DataFrame:
    rows = dim.where((C("installs_count") >= min_installs) & C("rating").isNotNull()).select(
        "app_name", "category", _dbl("rating"), "installs_count")
    order = [C("rating").desc(), C("installs_count").desc()]
    return top_k_ranked(rows, order + [C("app_name")], k, order, "quality_rank", dense=True)


def q03_category_top3(dim: DataFrame, fact: DataFrame | None = None, n: int = 3) -> DataFrame:
    rows = dim.where(C("installs_count").isNotNull()).select(
        "app_name", "category", "installs_count", _dbl("rating"))
    return top_n_per_group(rows, ["category"], [C("installs_count").desc(), C("app_name")], n,
                           "category_rank")


def q04_recent_high_rated(dim: DataFrame, fact: DataFrame | None = None, k: int = 15,
                          as_of: _dt.date | None = None) -> DataFrame:
    rows = dim.where((C("rating") >= 4.0) & C("last_updated_date").isNotNull()).select(
        "app_name", "category", _dbl("rating"), "last_updated_date",
        F.datediff(F.current_date() if as_of is None else F.lit(as_of), C("last_updated_date")).cast("bigint").alias("days_since_update"))
    return top_k(rows, [C("last_updated_date").desc(), C("app_name")], k)


# ----------------------------------------------------------------------------- ratings
def q05_rating_tiers(dim: DataFrame, fact: DataFrame | None = None) -> DataFrame:
    g = (dim.where(C("rating").isNotNull())
         .groupBy(lower_bound_tiers(C("rating"), RATING_TIERS).alias("rating_tier"))
         .agg(_count().alias("app_count"), F.min("rating").alias("_min")))
    return share_of_total(g, "app_count", "pct_of_total").orderBy(C("_min").desc()).drop("_min")


def q06_free_vs_paid_rating(dim: DataFrame, fact: DataFrame | None = None) -> DataFrame:
    return (dim.where(C("rating").isNotNull())
            .groupBy(pricing_model(C("is_paid")).alias("pricing_model"))
            .agg(_count().alias("total_apps"),
                 rnd(F.avg("rating"), 2).alias("avg_rating"),
                 rnd(F.min("rating"), 2).alias("min_rating"),
                 rnd(F.max("rating"), 2).alias("max_rating"),
                 rnd(F.avg("installs_count"), 0).alias("avg_installs")))


def q07_content_rating(dim: DataFrame, fact: DataFrame | None = None) -> DataFrame:
    g = (dim.where(C("rating").isNotNull()).groupBy("content_rating")
         .agg(_count().alias("total_apps"),
              rnd(F.avg("rating"), 2).alias("avg_rating"),
              rnd(F.avg("installs_count"), 0).alias("avg_installs")))
    return share_of_total(g, "total_apps", "pct_of_store").orderBy(C("avg_rating").desc())


def q08_rating_outliers(dim: DataFrame, fact: DataFrame | None = None, k: int = 20,
                        z: float = 1.5) -> DataFrame:
    rated = dim.where(C("rating").isNotNull())
    stats = rated.groupBy("category").agg(F.avg("rating").alias("cat_avg"),
                                          F.stddev_pop("rating").alias("cat_std"))
    # one row per category: AQE broadcasts it from the measured size of the aggregate
    j = rated.select("app_name", "category", "rating").join(stats, "category", "inner")
    delta = C("rating") - C("cat_avg")
    rows = j.where((C("cat_std") > 0) & (delta.cast("double") > F.lit(z) * C("cat_std"))).select(
        "app_name", "category", _dbl("rating"),
        rnd(C("cat_avg"), 2).alias("category_avg"),
        rnd(delta, 2).alias("delta_vs_avg"))
    return top_k(rows, [C("delta_vs_avg").desc(), C("app_name")], k)


# ----------------------------------------------------------------------------- categories
def q09_category_health(dim: DataFrame, fact: DataFrame | None = None) -> DataFrame:
    g = (dim.where(C("rating").isNotNull()).groupBy("category")
         .agg(_count().alias("total_apps"), F.avg("rating").alias("_avg"),
              F.sum("installs_count").cast("bigint").alias("total_installs")))
    # one row per category: the window runs over the grouped rows only
    return g.select("category", "total_apps", rnd(C("_avg"), 2).alias("avg_rating"),
                    "total_installs",
                    F.rank().over(Window.orderBy(C("_avg").desc())).cast("bigint")
                    .alias("rating_rank"))


def q10_category_share(dim: DataFrame, fact: DataFrame | None = None) -> DataFrame:
    g = dim.groupBy("category").agg(_count().alias("total_apps"),
                                    rnd(F.avg("rating"), 2).alias("avg_rating"))
    return share_of_total(g, "total_apps", "pct_of_store").select(
        "category", "total_apps", "pct_of_store", "avg_rating")


def q11_genre_rating(dim: DataFrame, fact: DataFrame | None = None, k: int = 20,
                     min_apps: int = 10) -> DataFrame:
    g = (dim.where(C("rating").isNotNull()).groupBy("genres")
         .agg(_count().alias("total_apps"), rnd(F.avg("rating"), 2).alias("avg_rating"),
              rnd(F.avg("installs_count"), 0).alias("avg_installs"))
         .where(C("total_apps") >= min_apps))
    return top_k(g, [C("avg_rating").desc(), C("genres")], k)


def q12_size_by_category(dim: DataFrame, fact: DataFrame | None = None) -> DataFrame:
    return (dim.where(C("size_in_mb").isNotNull()).groupBy("category")
            .agg(_count().alias("total_apps"),
                 rnd(F.avg("size_in_mb"), 2).alias("avg_size_mb"),
                 rnd(F.min("size_in_mb"), 2).alias("min_size_mb"),
                 rnd(F.max("size_in_mb"), 2).alias("max_size_mb")))


# ----------------------------------------------------------------------------- pricing
def q13_paid_price_dist(dim: DataFrame, fact: DataFrame | None = None) -> DataFrame:
    return (dim.where(C("is_paid") == 1).groupBy("category")
            .agg(_count().alias("paid_app_count"),
                 rnd(F.min("price_usd"), 2).alias("min_price"),
                 rnd(F.avg("price_usd"), 2).alias("avg_price"),
                 rnd(F.max("price_usd"), 2).alias("max_price"),
                 rnd(F.sum("price_usd"), 2).alias("total_listed_price")))


def q14_most_expensive(dim: DataFrame, fact: DataFrame | None = None, k: int = 15) -> DataFrame:
    paid = dim.where(C("is_paid") == 1).select(
        "app_name", "category", "price_usd", "rating", "installs_count")
    ranked = rank_at_most(paid, "price_usd", k, "price_rank")
    return ranked.select("app_name", "category", _dbl("price_usd"), _dbl("rating"),
                         "installs_count", "price_rank")


def q15_price_tiers(dim: DataFrame, fact: DataFrame | None = None) -> DataFrame:
    g = (dim.where(C("rating").isNotNull())
         .groupBy(price_tier(C("price_usd")).alias("price_tier"))
         .agg(_count().alias("total_apps"), rnd(F.avg("rating"), 2).alias("avg_rating"),
              rnd(F.avg("installs_count"), 0).alias("avg_installs"),
              F.min("price_usd").alias("_min")))
    return share_of_total(g, "total_apps", "pct_of_total").orderBy("_min").drop("_min")


def q16_paid_share(dim: DataFrame, fact: DataFrame | None = None) -> DataFrame:
    g = dim.groupBy("category").agg(_count().alias("total_apps"),
                                    F.sum("is_paid").cast("bigint").alias("paid_apps"))
    return g.select("category", "total_apps", "paid_apps",
                    (C("total_apps") - C("paid_apps")).alias("free_apps"),
                    pct(C("paid_apps"), C("total_apps")).alias("paid_pct"))


# ----------------------------------------------------------------------------- installs
def q17_install_buckets(dim: DataFrame, fact: DataFrame | None = None) -> DataFrame:
    g = (dim.where(C("installs_count").isNotNull())
         .groupBy(lower_bound_tiers(C("installs_count"), INSTALL_BUCKETS).alias("install_bucket"))
         .agg(_count().alias("app_count"), F.min("installs_count").alias("_min")))
    return share_of_total(g, "app_count", "pct_of_total").orderBy(C("_min").desc()).drop("_min")


def q18_category_installs(dim: DataFrame, fact: DataFrame | None = None) -> DataFrame:
    g = (dim.where(C("installs_count").isNotNull()).groupBy("category")
         .agg(_count().alias("total_apps"),
              F.sum("installs_count").cast("bigint").alias("total_installs"),
              rnd(F.avg("installs_count"), 0).alias("avg_installs_per_app")))
    return share_of_total(g, "total_installs", "pct_of_total_installs")


def q19_popular_low_rated(dim: DataFrame, fact: DataFrame | None = None, k: int = 15,
                          min_installs: int = 10000000) -> DataFrame:
    rows = dim.where((C("installs_count") >= min_installs) & C("rating").isNotNull()).select(
        "app_name", "category", "installs_count", _dbl("rating"), "reviews_count")
    return top_k(rows, [C("rating").asc(), C("installs_count").desc(), C("app_name")], k)


def q20_median_installs(dim: DataFrame, fact: DataFrame | None = None) -> DataFrame:
    return exact_quantiles(dim, ["category"], "installs_count", [0.5], ["median"]).select(
        "category", rnd(C("median"), 0).alias("median_installs"))


# ----------------------------------------------------------------------------- reviews
def q21_most_reviewed(dim: DataFrame, fact: DataFrame, k: int = 15) -> DataFrame:
    per_app = per_app_reviews(fact, ("app_id", "app_name"))
    j = per_app.join(dim.select("app_id", "category"), "app_id", "inner")
    g = j.groupBy("app_name", "category").agg(
        F.sum("n_rows").cast("bigint").alias("total_reviews"),
        _ratio(F.sum("sum_polarity"), F.sum("n_polarity")).alias("_avg_pol"))
    g = g.select("app_name", "category", "total_reviews",
                 rnd(C("_avg_pol"), 3).alias("avg_polarity"))
    return top_k_ranked(g, [C("total_reviews").desc(), C("app_name"), C("category")], k,
                        [C("total_reviews").desc()], "review_rank")


def q22_text_completeness(dim: DataFrame | None, fact: DataFrame) -> DataFrame:
    t = C("review_text")
    g = fact.groupBy(
        F.when(t.isNull() | (F.trim(t) == ""), F.lit("Empty / NULL")).otherwise(F.lit("Has Text"))
        .alias("review_quality")).agg(_count().alias("review_count"))
    return share_of_total(g, "review_count", "pct_of_total")


def q23_reviews_per_app(dim: DataFrame, fact: DataFrame) -> DataFrame:
    per_app = per_app_reviews(fact)
    j = per_app.join(dim.select("app_id", "category"), "app_id", "inner")
    # per_app has one row per app_id and app_id is the dimension key: COUNT(DISTINCT) = COUNT
    g = j.groupBy("category").agg(_count().alias("apps_with_reviews"),
                                  F.sum("n_review_id").cast("bigint").alias("total_reviews"))
    return g.select("category", "apps_with_reviews", "total_reviews",
                    rnd(C("total_reviews").cast("decimal(30,4)") / C("apps_with_reviews"), 1)
                    .alias("reviews_per_app"))


def q24_reviewed_vs_not(dim: DataFrame, fact: DataFrame) -> DataFrame:
    with_reviews = (fact.where(C("app_id").isNotNull()).select("app_id").distinct()
                    .agg(_count().alias("app_count"))
                    .select(F.lit("Apps WITH reviews").alias("segment"), "app_count"))
    without = (anti(dim.select("app_id"), fact.where(C("review_id").isNotNull()).select("app_id"),
                    "app_id")
               .agg(_count().alias("app_count"))
               .select(F.lit("Apps WITHOUT reviews").alias("segment"), "app_count"))
    return with_reviews.unionAll(without)


# ----------------------------------------------------------------------------- sentiment
def q25_sentiment_split(dim: DataFrame | None, fact: DataFrame) -> DataFrame:
    g = (fact.where(C("sentiment").isNotNull()).groupBy("sentiment")
         .agg(_count().alias("total_reviews")))
    return share_of_total(g, "total_reviews", "pct_of_total").orderBy(C("total_reviews").desc())


def q26_negative_share(dim: DataFrame | None, fact: DataFrame, k: int = 15,
                       min_reviews: int = 20) -> DataFrame:
    g = (fact.where(C("sentiment").isNotNull()).groupBy("app_name")
         .agg(_count().alias("total_reviews"),
              F.count_if(C("sentiment") == "Negative").cast("bigint").alias("negative_count"))
         .where(C("total_reviews") >= min_reviews))
    g = g.withColumn("negative_pct", pct(C("negative_count"), C("total_reviews")))
    return top_k(g, [C("negative_pct").desc(), C("app_name")], k)


def q27_category_polarity(dim: DataFrame, fact: DataFrame) -> DataFrame:
    per_app = per_app_reviews(fact.where(C("sentiment_polarity").isNotNull()))
    j = per_app.join(dim.select("app_id", "category"), "app_id", "inner")
    return j.groupBy("category").agg(
        F.sum("n_review_id").cast("bigint").alias("total_reviews"),
        rnd(_ratio(F.sum("sum_polarity"), F.sum("n_polarity")), 4).alias("avg_polarity"),
        rnd(_ratio(F.sum("sum_subjectivity"), F.sum("n_subjectivity")), 4).alias("avg_subjectivity"))


def q28_sentiment_by_content(dim: DataFrame, fact: DataFrame) -> DataFrame:
    per_app = (fact.where(C("sentiment").isNotNull()).groupBy("app_id", "sentiment")
               .agg(_count().alias("n")))
    j = per_app.join(dim.select("app_id", "content_rating"), "app_id", "inner")
    g = j.groupBy("content_rating", "sentiment").agg(F.sum("n").cast("bigint").alias("review_count"))
    return share_of_total(g, "review_count", "pct_within_tier", partition=["content_rating"])


def q29_polarity_gap(dim: DataFrame | None, fact: DataFrame, k: int = 15,
                     min_reviews: int = 20) -> DataFrame:
    g = (fact.where(C("sentiment_polarity").isNotNull() & C("sentiment_subjectivity").isNotNull())
         .groupBy("app_name")
         .agg(_count().alias("total_reviews"),
              F.round(F.avg("sentiment_polarity"), 4).alias("_p"),
              F.round(F.avg("sentiment_subjectivity"), 4).alias("_s"))
         .where(C("total_reviews") >= min_reviews))
    g = g.select("app_name", "total_reviews", rnd(C("_p"), 4).alias("avg_polarity"),
                 rnd(C("_s"), 4).alias("avg_subjectivity"),
                 rnd(F.abs(C("_p") - C("_s")), 4).alias("polarity_subjectivity_gap"))
    return top_k(g, [C("polarity_subjectivity_gap").desc(), C("app_name")], k)


# ----------------------------------------------------------------------------- BI
def q30_update_trend(dim: DataFrame, fact: DataFrame | None = None) -> DataFrame:
    return (dim.where(C("last_updated_date").isNotNull())
            .groupBy(F.year("last_updated_date").cast("bigint").alias("update_year"))
            .agg(_count().alias("apps_updated"),
                 rnd(F.avg("rating"), 2).alias("avg_rating_that_year")))


def q31_quality_reach(dim: DataFrame, fact: DataFrame | None = None) -> DataFrame:
    g = (dim.where(C("rating").isNotNull() & C("installs_count").isNotNull()).groupBy("category")
         .agg(_count().alias("total_apps"), F.avg("rating").alias("_avg"),
              F.sum("installs_count").cast("bigint").alias("total_installs")))
    g = g.select("category", "total_apps", rnd(C("_avg"), 2).alias("avg_rating"), "total_installs",
                 rnd(C("_avg").cast("double") * F.log10(C("total_installs") + 1), 2)
                 .alias("quality_reach_score"))
    return g.withColumn("composite_rank",
                        F.rank().over(Window.orderBy(C("quality_reach_score").desc())).cast("bigint"))


def q32_polarity_by_model(dim: DataFrame, fact: DataFrame) -> DataFrame:
    per_app = per_app_reviews(fact.where(C("sentiment").isNotNull()))
    j = per_app.join(dim.select("app_id", "is_paid"), "app_id", "inner")
    g = j.groupBy(pricing_model(C("is_paid")).alias("pricing_model")).agg(
        F.sum("n_review_id").cast("bigint").alias("total_reviews"),
        F.sum("n_rows").alias("_rows"),
        _ratio(F.sum("sum_polarity"), F.sum("n_polarity")).alias("_p"),
        (_ratio(F.sum("sum_subjectivity"), F.sum("n_subjectivity"))).alias("_s"),
        F.sum("n_positive").cast("bigint").alias("positive_count"),
        F.sum("n_negative").cast("bigint").alias("negative_count"))
    return g.select("pricing_model", "total_reviews", rnd(C("_p"), 4).alias("avg_polarity"),
                    rnd(C("_s"), 4).alias("avg_subjectivity"), "positive_count", "negative_count",
                    pct(C("positive_count"), C("_rows")).alias("positive_pct"))


def q33_composite_leaders(dim: DataFrame, fact: DataFrame, n: int = 3) -> DataFrame:
    apps = dim.where(C("rating").isNotNull() & (C("installs_count") > 0)).select(
        "app_id", "app_name", "category", "rating", "installs_count")
    pol = (fact.groupBy("app_id")
           .agg(_ratio(F.sum("sentiment_polarity").cast("double"), F.count("sentiment_polarity"))
                .alias("_pol")))
    j = apps.join(pol, "app_id", "left")
    max_inst = apps.agg(F.max("installs_count")).scalar()
    avg_pol = F.coalesce(C("_pol"), F.lit(0.0))
    score = ((C("rating").cast("double") / 5.0) * 0.4
             + (F.log10(C("installs_count") + 1) / F.log10(max_inst + 1)) * 0.3
             + (avg_pol + 1) / 2.0 * 0.3)
    scored = j.select("app_id", "app_name", "category", _dbl("rating"), "installs_count",
                      rnd(avg_pol, 3).alias("avg_polarity"), rnd(score, 4).alias("composite_score"))
    top = top_n_per_group(scored, ["category"], [C("composite_score").desc(), C("app_id")], n,
                          "category_rank")
    return top.drop("app_id")


def q34_android_versions(dim: DataFrame, fact: DataFrame | None = None, k: int = 15,
                         min_apps: int = 5) -> DataFrame:
    g = (dim.where(C("min_android_ver").isNotNull() & C("rating").isNotNull())
         .groupBy("min_android_ver")
         .agg(_count().alias("total_apps"), rnd(F.avg("rating"), 2).alias("avg_rating"),
              rnd(F.avg("installs_count"), 0).alias("avg_installs"))
         .where(C("total_apps") >= min_apps))
    g = share_of_total(g, "total_apps", "pct_of_store")
    return top_k(g, [C("total_apps").desc(), C("min_android_ver")], k)


# ----------------------------------------------------------------------------- KPIs
def q35_store_kpis(dim: DataFrame, fact: DataFrame | None = None) -> DataFrame:
    paid = C("is_paid") == 1
    return dim.agg(
        _count().alias("total_apps"),
        F.count_distinct("category").cast("bigint").alias("total_categories"),
        F.count_distinct("genres").cast("bigint").alias("total_genres"),
        F.count_if(paid).cast("bigint").alias("paid_apps"),
        F.count_if(C("is_paid") == 0).cast("bigint").alias("free_apps"),
        rnd(F.avg("rating"), 2).alias("avg_rating"),
        rnd(F.min("rating"), 2).alias("min_rating"),
        rnd(F.max("rating"), 2).alias("max_rating"),
        F.sum("installs_count").cast("bigint").alias("total_installs"),
        rnd(F.avg("installs_count"), 0).alias("avg_installs"),
        F.max("installs_count").cast("bigint").alias("max_installs"),
        rnd(F.avg(F.when(paid, C("price_usd"))), 2).alias("avg_paid_price"),
        rnd(F.max("price_usd"), 2).alias("max_price"),
        rnd(F.avg("size_in_mb"), 2).alias("avg_size_mb"),
        rnd(F.max("size_in_mb"), 2).alias("max_size_mb"))


def q36_sentiment_kpis(dim: DataFrame | None, fact: DataFrame) -> DataFrame:
    s = C("sentiment")
    pos = F.count_if(s == "Positive")
    return fact.agg(
        _count().alias("total_reviews"),
        pos.cast("bigint").alias("positive_reviews"),
        F.count_if(s == "Negative").cast("bigint").alias("negative_reviews"),
        F.count_if(s == "Neutral").cast("bigint").alias("neutral_reviews"),
        pct(pos, F.count(s)).alias("positive_pct"),
        rnd(F.avg("sentiment_polarity"), 4).alias("avg_polarity"),
        rnd(F.avg("sentiment_subjectivity"), 4).alias("avg_subjectivity"),
        F.count_distinct("app_id").cast("bigint").alias("apps_with_reviews"))


def q37_category_matrix(dim: DataFrame, fact: DataFrame, dedup: bool = False) -> DataFrame:
    """Category KPIs after ``dim LEFT JOIN fact``.

    The source query aggregates the raw join, so SUM(installs), AVG(rating) and AVG(price)
    count an app once per review. We keep that meaning without materialising the fan-out:
    each app row carries the weight ``w = max(reviews, 1)``. ``dedup=True`` is the
    corrected variant (w = 1).
    """
    per_app = per_app_reviews(fact)
    j = dim.select("app_id", "category", "rating", "installs_count", "price_usd").join(
        per_app, "app_id", "left")
    w = F.lit(1) if dedup else F.greatest(F.coalesce(C("n_rows"), F.lit(0)), F.lit(1))
    rating, price = C("rating"), C("price_usd")
    g = j.groupBy("category").agg(
        F.count("app_id").cast("bigint").alias("total_apps"),  # one row per dimension key
        _ratio(F.sum(rating * w), F.sum(F.when(rating.isNotNull(), w))).alias("_r"),
        F.sum(C("installs_count") * w).cast("bigint").alias("total_installs"),
        F.coalesce(F.sum("n_review_id"), F.lit(0)).cast("bigint").alias("total_reviews"),
        F.sum("n_positive").alias("_pos"), F.sum("n_sentiment").alias("_sent"),
        _ratio(F.sum("sum_polarity"), F.sum("n_polarity")).alias("_p"),
        _ratio(F.sum(price * w), F.sum(F.when(price.isNotNull(), w))).alias("_price"))
    return g.select("category", "total_apps", rnd(C("_r"), 2).alias("avg_rating"),
                    "total_installs", "total_reviews",
                    pct(C("_pos"), C("_sent")).alias("positive_review_pct"),
                    rnd(C("_p"), 4).alias("avg_polarity"), rnd(C("_price"), 2).alias("avg_price"))


QUERIES = {
    "q01_top_installs": q01_top_installs,
    "q02_quality_rank": q02_quality_rank,
    "q03_category_top3": q03_category_top3,
    "q04_recent_high_rated": partial(q04_recent_high_rated, as_of=AS_OF),
    "q05_rating_tiers": q05_rating_tiers,
    "q06_free_vs_paid_rating": q06_free_vs_paid_rating,
    "q07_content_rating": q07_content_rating,
    "q08_rating_outliers": q08_rating_outliers,
    "q09_category_health": q09_category_health,
    "q10_category_share": q10_category_share,
    "q11_genre_rating": q11_genre_rating,
    "q12_size_by_category": q12_size_by_category,
    "q13_paid_price_dist": q13_paid_price_dist,
    "q14_most_expensive": q14_most_expensive,
    "q15_price_tiers": q15_price_tiers,
    "q16_paid_share": q16_paid_share,
    "q17_install_buckets": q17_install_buckets,
    "q18_category_installs": q18_category_installs,
    "q19_popular_low_rated": q19_popular_low_rated,
    "q20_median_installs": q20_median_installs,
    "q21_most_reviewed": q21_most_reviewed,
    "q22_text_completeness": q22_text_completeness,
    "q23_reviews_per_app": q23_reviews_per_app,
    "q24_reviewed_vs_not": q24_reviewed_vs_not,
    "q25_sentiment_split": q25_sentiment_split,
    "q26_negative_share": q26_negative_share,
    "q26_negative_share_min10": lambda d, f: q26_negative_share(d, f, min_reviews=10),
    "q27_category_polarity": q27_category_polarity,
    "q28_sentiment_by_content": q28_sentiment_by_content,
    "q29_polarity_gap": q29_polarity_gap,
    "q29_polarity_gap_min10": lambda d, f: q29_polarity_gap(d, f, min_reviews=10),
    "q30_update_trend": q30_update_trend,
    "q31_quality_reach": q31_quality_reach,
    "q32_polarity_by_model": q32_polarity_by_model,
    "q33_composite_leaders": q33_composite_leaders,
    "q34_android_versions": q34_android_versions,
    "q35_store_kpis": q35_store_kpis,
    "q36_sentiment_kpis": q36_sentiment_kpis,
    "q37_category_matrix": q37_category_matrix,
    "q37_category_matrix_dedup": lambda d, f: q37_category_matrix(d, f, dedup=True),
}
