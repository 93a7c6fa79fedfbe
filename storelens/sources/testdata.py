"""Star-schema views derived from the driver's TPC-H-style parquet tables.

The app-store exports are not shipped, so `dim_apps` / `fact_user_reviews` (and a dirty
staging table for the cleaning operators) are *derived* deterministically from
``orders ⋈ customer ⋈ nation`` and ``lineitem``. Work therefore grows with the given
tables. The same derivation is written as SQL in ``storelens.oracle.star`` so DuckDB can
check every key independently.

All derivations are narrow projections (no shuffle) except the two dimension joins,
which join ``orders`` to ``customer`` (shuffle / AQE-broadcast) and to ``nation``
(25 rows, size-checked broadcast).
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


DEFAULT_SF_DIR = "/root/testdata/sf0.01"

# The nine install levels of the derived dimension, chosen by o_orderkey % 9.
INSTALL_LEVELS = [0, 1000, 10000, 100000, 1000000, 5000000, 10000000, 100000000, 1000000000]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _hundredths(num: Column, precision: int, scale: int) -> Column:
    """Exact decimal ``num / 100`` (num is an integral column)."""
    return (num.cast("decimal(20,0)") / F.lit(100)).cast(f"decimal({precision},{scale})")


def _case_by(key: Column, values: list) -> Column:
    expr = None
    for i, v in enumerate(values):
        expr = F.when(key == i, F.lit(v)) if expr is None else expr.when(key == i, F.lit(v))
    return expr


def dim_apps(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    # join strategies are left to the planner: it broadcasts a side only when its size
    # (file statistics, or AQE's measured shuffle output) is under the threshold
    cust = customer.join(nation, customer.c_nationkey == nation.n_nationkey, "inner")
    j = orders.join(cust, orders.o_custkey == cust.c_custkey, "inner")
    k = F.col("o_orderkey")
    paid = (k % 10) == 3
    return j.select(
        k.alias("app_id"),
        F.concat(F.lit("app_"), k.cast("string")).alias("app_name"),
        F.col("n_name").alias("category"),
        F.when(k % 7 == 0, F.lit(None))
        .otherwise(_hundredths(k * 37 % 401 + 100, 3, 2)).cast("decimal(3,2)").alias("rating"),
        (k * 97 % 100003).alias("reviews_count"),
        F.when(k % 5 == 0, F.lit(None))
        .otherwise(_hundredths(k * 29 % 10000 + 1, 12, 6)).cast("decimal(12,6)").alias("size_in_mb"),
        F.when(k % 5 == 0, F.lit("Varies with device"))
        .otherwise(F.concat((k * 29 % 10000 + 1).cast("string"), F.lit(" cMB"))).alias("size_raw"),
        _case_by(k % 9, INSTALL_LEVELS).cast("bigint").alias("installs_count"),
        paid.cast("int").alias("is_paid"),
        F.when(paid, _hundredths(k * 13 % 2000 + 49, 8, 2))
        .otherwise(F.lit(0).cast("decimal(8,2)")).cast("decimal(8,2)").alias("price_usd"),
        F.col("c_mktsegment").alias("content_rating"),
        F.concat(F.col("c_mktsegment"), F.lit(";"), F.col("o_orderpriority")).alias("genres"),
        F.col("o_orderdate").cast("date").alias("last_updated_date"),
        F.concat(F.lit("1."), (k % 13).cast("string")).alias("current_version"),
        F.when(k % 11 == 0, F.lit(None).cast("string"))
        .otherwise(F.concat(F.lit("4."), (k % 5).cast("string"), F.lit(" and up")))
        .alias("min_android_ver"),
    )


def fact_user_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_linestatus")
    ln = F.col("l_linenumber")
    missing = ln == 7
    return li.select(
        (F.col("l_orderkey") * 1000000 + F.col("l_partkey") * 10 + ln).alias("review_id"),
        F.col("l_orderkey").alias("app_id"),
        F.concat(F.lit("app_"), F.col("l_orderkey").cast("string")).alias("app_name"),
        F.when(missing, F.lit(None).cast("string")).when(ln == 6, F.lit("  "))
        .otherwise(F.concat("l_returnflag", "l_linestatus", F.col("l_suppkey").cast("string")))
        .alias("review_text"),
        F.when(missing, F.lit(None).cast("string"))
        .when(F.col("l_returnflag") == "A", "Positive")
        .when(F.col("l_returnflag") == "R", "Negative")
        .when(F.col("l_returnflag") == "N", "Neutral").alias("sentiment"),
        F.when(missing, F.lit(None))
        .otherwise((((F.col("l_partkey") * 31) % 20001 - 10000).cast("decimal(20,0)")
                    / F.lit(10000)).cast("decimal(6,5)")).cast("decimal(6,5)")
        .alias("sentiment_polarity"),
        F.when(missing, F.lit(None))
        .otherwise((((F.col("l_suppkey") * 17) % 10001).cast("decimal(20,0)")
                    / F.lit(10000)).cast("decimal(6,5)")).cast("decimal(6,5)")
        .alias("sentiment_subjectivity"),
    )


def star(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return dim_apps(spark, sf_dir), fact_user_reviews(spark, sf_dir)


def dirty_star(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The star with faults that the clean one can't have: names shared by two apps, sizes beyond any app's, sentiments
    outside the domain, ratings above 5 as the type allows, categories blank, installs negative."""
    dim, fact = star(spark, sf_dir)
    k, name = F.col("app_id"), F.col("app_name")
    dim = dim.withColumns({
        "app_name": F.when(k % 50 == 0, F.concat(F.lit("app_"), F.floor(k / 100).cast("string"))).otherwise(name),
        "category": F.when(k % 83 == 0, " ").otherwise(F.col("category")),
        "rating": F.when(k % 61 == 0, F.lit(5.5)).otherwise(F.col("rating")).cast("decimal(3,2)"),
        "installs_count": F.when(k % 71 == 0, -F.col("installs_count") - 1).otherwise(F.col("installs_count")),
        "size_in_mb": F.when(k % 13 == 0, F.col("size_in_mb") * 10).otherwise(F.col("size_in_mb")).cast("decimal(12,6)")})
    s = F.col("sentiment")
    return dim, fact.withColumn("sentiment", F.when(F.col("review_id") % 17 == 0, F.lower(s)).when(F.col("review_id") % 19 == 0, "Mixed").otherwise(s))


# --------------------------------------------------------------------------- dirty staging
# Staging labels for o_orderstatus (content rating) of the dirty view.
CONTENT_BY_STATUS = {"F": "Everyone", "O": "Teen", "P": "Mature 17+"}


def _long_date(d: Column) -> Column:
    return F.date_format(d, "MMMM d, yyyy")


def staging_apps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All-string staging table with shifted rows, duplicates and unparsable values."""
    o = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_orderstatus", "o_orderdate", "o_orderpriority")
    k = F.col("o_orderkey")
    m4 = k % 4
    status = F.col("o_orderstatus")
    content = (F.when(status == "F", CONTENT_BY_STATUS["F"])
               .when(status == "O", CONTENT_BY_STATUS["O"])
               .when(status == "P", CONTENT_BY_STATUS["P"]))
    return o.select(
        k.alias("raw_app_id"),
        F.concat(F.lit("app_"), F.when(k % 5 == 0, k + 1).otherwise(k).cast("string")).alias("app"),
        F.when(k % 997 == 0, F.lit("1.9")).otherwise(F.col("o_orderpriority")).alias("category"),
        F.when(k % 7 == 0, F.lit("NaN"))
        .otherwise((F.lit(1) + (k * 37 % 41).cast("decimal(20,0)") / F.lit(10))
                   .cast("decimal(3,1)").cast("string")).alias("rating"),
        F.when(k % 501 == 0, F.lit("3.0M")).otherwise((k * 97 % 1003).cast("string")).alias("reviews"),
        F.when(m4 == 0, F.concat((k % 97).cast("string"), F.lit("M")))
        .when(m4 == 1, F.concat((k % 900).cast("string"), F.lit("k")))
        .when(m4 == 2, F.lit("Varies with device"))
        .otherwise(F.concat((k % 9).cast("string"), F.lit(".5M"))).alias("size"),
        F.when(m4 == 0, F.lit("1,000+")).when(m4 == 1, F.lit("5,000,000+"))
        .when(m4 == 2, F.lit("0")).otherwise(F.lit("Free")).alias("installs"),
        F.when(k % 10 == 3, F.lit("Paid")).when(k % 10 == 4, F.lit(None).cast("string"))
        .otherwise(F.lit("Free")).alias("type"),
        F.when(k % 10 == 3, F.lit("$4.99")).when(k % 10 == 4, F.lit("Everyone"))
        .otherwise(F.lit("0")).alias("price"),
        content.alias("content_rating"),
        F.col("o_orderpriority").alias("genres"),
        F.when(k % 301 == 0, F.lit("1.0.19")).otherwise(_long_date(F.col("o_orderdate")))
        .alias("last_updated"),
        F.concat(F.lit("1."), (k % 7).cast("string")).alias("current_ver"),
        F.concat(F.lit("4."), (k % 5).cast("string"), F.lit(" and up")).alias("android_ver"),
    )


def popular_staging_apps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The staging table with apps of 10 million installs and more, which the plain one has none of."""
    k = F.col("raw_app_id")
    return staging_apps(spark, sf_dir).withColumn("installs", F.when(k % 6 == 1, "50,000,000+").when(k % 6 == 2, "10,000,000+").otherwise(F.col("installs")))


def staging_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All-string raw reviews; names carry a leading blank, order keys divisible by 5 are orphans."""
    f = fact_user_reviews(spark, sf_dir)
    return f.select(
        F.col("review_id").alias("raw_review_id"),
        F.concat(F.lit(" app_"), F.col("app_id").cast("string")).alias("app"),
        F.col("review_text").alias("translated_review"),
        F.col("sentiment"),
        F.col("sentiment_polarity").cast("string").alias("sentiment_polarity"),
        F.col("sentiment_subjectivity").cast("string").alias("sentiment_subjectivity"),
    )
