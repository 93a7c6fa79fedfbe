"""Cleaning and star build (C1-C15) plus table profiling.

The dimension build is one projection pipeline over the staging table:
drop shifted rows -> latest-record dedupe per raw name -> typed parsing. The fact build is
one inner equi-join on the trimmed name. Nothing is collected; the dedupe is a
``row_number() == 1`` filter that Spark plans as a partial WindowGroupLimit before the
shuffle, so a heavily duplicated name ships one row per input partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import parsing as P
from ..operators.hot_join import hot_join
from ..sources.testdata import dim_apps, staging_apps, staging_reviews, table

C = F.col


# ----------------------------------------------------------------------------- operators
def drop_shifted(stg: DataFrame) -> DataFrame:
    """``category <> '1.9'`` (three-valued: NULL category is dropped too)."""
    return stg.where(C("category") != "1.9")


def dedupe_latest(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """Keep the first row per ``keys`` under ``order``."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).where(C("__rn") == 1).drop("__rn")


def latest_order() -> list:
    return [P.parse_count(F.coalesce(F.nullif(C("reviews"), F.lit("")), F.lit("0"))).desc(),
            P.parse_long_date(C("last_updated")).desc_nulls_last(),
            C("raw_app_id").desc()]


def build_dim_apps(stg: DataFrame) -> DataFrame:
    """C11: C1 -> C10 -> C2..C9."""
    kept = dedupe_latest(drop_shifted(stg), ["app"], latest_order())
    price = P.parse_price(C("price"))
    return kept.select(
        C("raw_app_id").alias("app_id"),
        F.trim(C("app")).alias("app_name"),
        "category",
        P.parse_rating(C("rating")).alias("rating"),
        P.parse_count(C("reviews")).alias("reviews_count"),
        P.parse_size_mb(C("size")).alias("size_in_mb"),
        C("size").alias("size_raw"),
        P.parse_installs(C("installs")).alias("installs_count"),
        P.is_paid(price).alias("is_paid"),
        price.alias("price_usd"),
        "content_rating", "genres",
        P.parse_long_date(C("last_updated")).alias("last_updated_date"),
        C("current_ver").alias("current_version"),
        C("android_ver").alias("min_android_ver"),
    )


def build_fact_reviews(stg_reviews: DataFrame, dim: DataFrame) -> DataFrame:
    """Inner join on the trimmed raw name; unmatched reviews drop, duplicates stay. Names with a large share of
    the reviews are salted."""
    r = stg_reviews.withColumn("__name", F.trim(C("app")))
    d = dim.select(C("app_id"), C("app_name").alias("__name"))
    return hot_join(r, d, "__name", ["raw_review_id"]).select(
        C("raw_review_id").alias("review_id"),
        "app_id",
        C("__name").alias("app_name"),
        C("translated_review").alias("review_text"),
        "sentiment",
        P.parse_polarity(C("sentiment_polarity")).alias("sentiment_polarity"),
        P.parse_subjectivity(C("sentiment_subjectivity")).alias("sentiment_subjectivity"),
    )


def dashboard_apps(stg: DataFrame) -> DataFrame:
    """C14: the dashboard's app frame (not the same rows as C11).

    Not '1.9' (NULL category kept), first row per raw name in load order, rated, Type in
    (Free, Paid); loose installs / price parses and the paid flag from Type.
    """
    s = stg.where(C("category").isNull() | (C("category") != "1.9"))
    first = dedupe_latest(s, ["app"], [C("raw_app_id").asc()])
    rating = P.na_to_null(C("rating")).try_cast("double")
    typ = P.na_to_null(C("type"))
    return (first.withColumn("rating_value", rating).withColumn("type_value", typ)
            .where(C("rating_value").isNotNull() & C("type_value").isin("Free", "Paid"))
            .select(
                "raw_app_id", C("app").alias("app"), "category",
                C("rating_value").alias("rating"),
                C("reviews"),
                C("type_value").alias("type"),
                P.loose_installs(C("installs")).alias("installs_clean"),
                P.loose_price(C("price")).alias("price_clean"),
                (F.trim(C("type_value")) == "Paid").cast("int").alias("is_paid")))


def dashboard_reviews(stg_reviews: DataFrame) -> DataFrame:
    """Reviews with text and sentiment present (after NA normalisation), no dedupe."""
    text = P.na_to_null(C("translated_review"))
    sent = P.na_to_null(C("sentiment"))
    return (stg_reviews.withColumn("translated_review", text).withColumn("sentiment", sent)
            .where(C("translated_review").isNotNull() & C("sentiment").isNotNull())
            .select("raw_review_id", "app", "translated_review", "sentiment",
                    P.na_to_null(C("sentiment_polarity")).try_cast("double")
                    .alias("sentiment_polarity")))


# ----------------------------------------------------------------------------- keyed jobs
def _stg(spark, sf):
    return staging_apps(spark, sf)


def c_parse_rating(spark: SparkSession, sf: str) -> DataFrame:
    return _stg(spark, sf).select("raw_app_id", C("rating").alias("rating_raw"),
                                  P.parse_rating(C("rating")).cast("double").alias("rating"))


def c_parse_reviews(spark: SparkSession, sf: str) -> DataFrame:
    return _stg(spark, sf).select("raw_app_id", C("reviews").alias("reviews_raw"),
                                  P.parse_count(C("reviews")).alias("reviews_count"))


def c_parse_size(spark: SparkSession, sf: str) -> DataFrame:
    return _stg(spark, sf).select("raw_app_id", C("size").alias("size_raw"),
                                  P.parse_size_mb(C("size")).cast("double").alias("size_in_mb"))


def c_parse_installs(spark: SparkSession, sf: str) -> DataFrame:
    return _stg(spark, sf).select("raw_app_id", C("installs").alias("installs_raw"),
                                  P.parse_installs(C("installs")).alias("installs_count"))


def c_parse_price(spark: SparkSession, sf: str) -> DataFrame:
    return _stg(spark, sf).select("raw_app_id", C("price").alias("price_raw"),
                                  P.parse_price(C("price")).cast("double").alias("price_usd"),
                                  P.is_paid(P.parse_price(C("price"))).alias("is_paid"))


def c_parse_date(spark: SparkSession, sf: str) -> DataFrame:
    return _stg(spark, sf).select("raw_app_id", C("last_updated").alias("last_updated_raw"),
                                  P.parse_long_date(C("last_updated")).alias("last_updated_date"))


def c_parse_polarity(spark: SparkSession, sf: str) -> DataFrame:
    r = staging_reviews(spark, sf)
    return r.select("raw_review_id",
                    P.parse_polarity(C("sentiment_polarity")).cast("double").alias("sentiment_polarity"),
                    P.parse_subjectivity(C("sentiment_subjectivity")).cast("double")
                    .alias("sentiment_subjectivity"))


def c_drop_shifted(spark: SparkSession, sf: str) -> DataFrame:
    return drop_shifted(_stg(spark, sf)).select("raw_app_id", "app", "category")


def c_dedupe_latest(spark: SparkSession, sf: str) -> DataFrame:
    kept = dedupe_latest(drop_shifted(_stg(spark, sf)), ["app"], latest_order())
    return kept.select("raw_app_id", "app")


def _typed_dim(df: DataFrame) -> DataFrame:
    return df.select(*[C(c).cast("double").alias(c) if t.startswith("decimal") else C(c)
                       for c, t in df.dtypes])


def c_build_dim(spark: SparkSession, sf: str) -> DataFrame:
    return _typed_dim(build_dim_apps(_stg(spark, sf)))


def c_build_fact(spark: SparkSession, sf: str) -> DataFrame:
    dim = build_dim_apps(_stg(spark, sf))
    return _typed_dim(build_fact_reviews(staging_reviews(spark, sf), dim))


def c_parse_loose(spark: SparkSession, sf: str) -> DataFrame:
    return _stg(spark, sf).select("raw_app_id", "installs", "price",
                                  P.loose_installs(C("installs")).alias("installs_clean"),
                                  P.loose_price(C("price")).alias("price_clean"))


def c_dashboard_apps(spark: SparkSession, sf: str) -> DataFrame:
    return dashboard_apps(_stg(spark, sf))


def c_dashboard_reviews(spark: SparkSession, sf: str) -> DataFrame:
    return dashboard_reviews(staging_reviews(spark, sf))


# ----------------------------------------------------------------------------- profiling
PROFILE_TABLES = ("region nation customer supplier part orders lineitem events documents "
                  "embeddings pages benchmark labels conversations").split()


def table_profile(tables: dict[str, DataFrame]) -> DataFrame:
    """Per table its column count, row count and column names (one row each)."""
    parts = []
    for name, df in tables.items():
        parts.append(df.agg(F.count(F.lit(1)).cast("bigint").alias("row_count")).select(
            F.lit(name).alias("table_name"),
            F.lit(len(df.columns)).cast("bigint").alias("column_count"),
            "row_count",
            F.lit(",".join(df.columns)).alias("column_names")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def s_table_profile(spark: SparkSession, sf: str) -> DataFrame:
    return table_profile({t: table(spark, sf, t) for t in PROFILE_TABLES})


def s_dim_sample(spark: SparkSession, sf: str, n: int = 10) -> DataFrame:
    """Head sample of three columns in key order (a LIMIT is the feature)."""
    return (dim_apps(spark, sf).select("app_id", "app_name", C("price_usd").cast("double"),
                                       "is_paid")
            .orderBy("app_id").limit(n))


def s_csv_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """S1 + S4: export the staging apps as a raw CSV (original headers, quoted), append-write
    it into a fresh folder under the shared checkpoint dir, and ingest it back with the
    all-string reader (NA strings -> NULL, snake_case names)."""
    import uuid

    from ..session import ensure_checkpoint_dir
    from ..sources.raw import APPS_COLUMNS, read_raw, snake

    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/csv-roundtrip-{uuid.uuid4().hex}"
    stg = _stg(spark, sf)
    raw = stg.select(*[C(snake(c)).alias(c) for c in APPS_COLUMNS])
    raw.write.mode("append").option("header", True).option("escape", '"').csv(root)
    return read_raw(spark, root, APPS_COLUMNS)


def s_reviews_csv(spark: SparkSession, sf: str) -> DataFrame:
    """S2 + S3: export the staging reviews as raw CSV files in id order and ingest them back with load ids;
    ``out_of_order`` is 1 where a review's load id is after that of a later review (looked for in runs of 4,096 load ids)."""
    import uuid

    from ..session import ensure_checkpoint_dir
    from ..sources.raw import REVIEWS_COLUMNS, read_raw, snake

    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/csv-reviews-{uuid.uuid4().hex}"
    stg = staging_reviews(spark, sf)
    raw = stg.select("raw_review_id", *[C(snake(c)).alias(c) for c in REVIEWS_COLUMNS])
    ordered = raw.repartitionByRange("raw_review_id").sortWithinPartitions("raw_review_id")
    (ordered.write.option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False)
     .option("ignoreTrailingWhiteSpace", False).csv(root))
    back = read_raw(spark, root, ["raw_review_id", *REVIEWS_COLUMNS], load_id="load_id")
    by_file = Window.partitionBy(F.expr("load_id div 4096")).orderBy("load_id")
    ids = C("raw_review_id").cast("bigint")
    late = (ids < F.lag(ids).over(by_file)).cast("int")
    return back.select(ids.alias("raw_review_id"), *[snake(c) for c in REVIEWS_COLUMNS], F.coalesce(late, F.lit(0)).cast("bigint").alias("out_of_order"))


QUERIES = {
    "s_csv_roundtrip": s_csv_roundtrip,
    "s_reviews_csv": s_reviews_csv,
    "c_parse_rating": c_parse_rating,
    "c_parse_reviews": c_parse_reviews,
    "c_parse_size": c_parse_size,
    "c_parse_installs": c_parse_installs,
    "c_parse_price": c_parse_price,
    "c_parse_date": c_parse_date,
    "c_parse_polarity": c_parse_polarity,
    "c_drop_shifted": c_drop_shifted,
    "c_dedupe_latest": c_dedupe_latest,
    "c_build_dim": c_build_dim,
    "c_build_fact": c_build_fact,
    "c_parse_loose": c_parse_loose,
    "c_dashboard_apps": c_dashboard_apps,
    "c_dashboard_reviews": c_dashboard_reviews,
    "s_table_profile": s_table_profile,
    "s_dim_sample": s_dim_sample,
}
