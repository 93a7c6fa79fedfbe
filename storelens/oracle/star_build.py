"""DuckDB oracles for the cleaning / star-build keys (C1-C15) and S10/S11."""

from __future__ import annotations

from ..functions.parsing import NA_STRINGS

from .star import STG_REVIEWS_SQL, with_staging, with_star

UNSIGNED = r"'^[0-9]+(\.[0-9]+)?$'"
SIGNED = r"'^-?[0-9]+(\.[0-9]+)?$'"
DIGITS = r"'^[0-9]+$'"
_NA_LIST = ", ".join("'" + s.replace("'", "''") + "'" for s in NA_STRINGS)


def na(x: str) -> str:
    return f"(CASE WHEN {x} IN ({_NA_LIST}) THEN NULL ELSE {x} END)"


def dec(x: str, p: int, s: int, gate: str = UNSIGNED, default: str | None = None) -> str:
    other = f" ELSE CAST({default} AS DECIMAL({p},{s}))" if default is not None else ""
    return (f"(CASE WHEN regexp_matches({x}, {gate}) THEN TRY_CAST({x} AS DECIMAL({p},{s})){other} END)")


def count(x: str) -> str:
    return f"(CASE WHEN regexp_matches({x}, {DIGITS}) THEN TRY_CAST({x} AS BIGINT) ELSE 0 END)"


def size_mb(x: str) -> str:
    low = f"lower({x})"
    return (f"(CASE WHEN {low} LIKE '%m' THEN CAST(TRY_CAST(replace({low}, 'm', '') AS DECIMAL(8,2)) AS DECIMAL(12,6))"
            f" WHEN {low} LIKE '%k' THEN CAST(round(TRY_CAST(replace({low}, 'k', '') AS DECIMAL(8,2))"
            f" * CAST(0.0009765625 AS DECIMAL(12,10)), 6) AS DECIMAL(12,6)) END)")


def long_date(x: str) -> str:
    return f"CAST(try_strptime({x}, '%B %-d, %Y') AS DATE)"


def price(x: str) -> str:
    return dec(f"replace({x}, '$', '')", 8, 2, default="0")


DIM_BUILT = f"""
dim_built AS (
  SELECT raw_app_id AS app_id, trim(app) AS app_name, category,
    {dec('rating', 3, 2)} AS rating,
    {count('reviews')} AS reviews_count,
    {size_mb('size')} AS size_in_mb,
    size AS size_raw,
    {count("replace(replace(installs, '+', ''), ',', '')")} AS installs_count,
    CAST({price('price')} > 0 AS INTEGER) AS is_paid,
    {price('price')} AS price_usd,
    content_rating, genres,
    {long_date('last_updated')} AS last_updated_date,
    current_ver AS current_version, android_ver AS min_android_ver
  FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY app ORDER BY
          {count("COALESCE(NULLIF(reviews, ''), '0')")} DESC,
          {long_date('last_updated')} DESC NULLS LAST, raw_app_id DESC) AS rn
        FROM stg_apps WHERE category <> '1.9') ranked_apps
  WHERE rn = 1)"""


def _dbl_dim(prefix: str = "") -> str:
    p = prefix
    return (f"{p}app_id, {p}app_name, {p}category, CAST({p}rating AS DOUBLE) AS rating, "
            f"{p}reviews_count, CAST({p}size_in_mb AS DOUBLE) AS size_in_mb, {p}size_raw, "
            f"{p}installs_count, {p}is_paid, CAST({p}price_usd AS DOUBLE) AS price_usd, "
            f"{p}content_rating, {p}genres, {p}last_updated_date, {p}current_version, "
            f"{p}min_android_ver")


LOOSE_INSTALLS = ("TRY_CAST(NULLIF(regexp_extract(replace(replace(installs, '+', ''), ',', ''), "
                  "'(\\d+)', 1), '') AS DOUBLE)")
LOOSE_PRICE = ("COALESCE(TRY_CAST(NULLIF(regexp_extract(replace(price, '$', ''), '([\\d\\.]+)', 1), '')"
               " AS DOUBLE), 0.0)")

DASH_APPS = f"""
dash_apps AS (
  SELECT raw_app_id, app, category, rating_value AS rating, reviews, type_value AS type,
    {LOOSE_INSTALLS} AS installs_clean, {LOOSE_PRICE} AS price_clean,
    CAST(trim(type_value) = 'Paid' AS INTEGER) AS is_paid
  FROM (SELECT *, TRY_CAST({na('rating')} AS DOUBLE) AS rating_value, {na('type')} AS type_value,
          ROW_NUMBER() OVER (PARTITION BY app ORDER BY raw_app_id) AS rn
        FROM stg_apps WHERE category IS NULL OR category <> '1.9') first_rows
  WHERE rn = 1 AND rating_value IS NOT NULL AND type_value IN ('Free', 'Paid'))"""

DASH_REVIEWS = f"""
dash_reviews AS (
  SELECT raw_review_id, app, {na('translated_review')} AS translated_review,
    {na('sentiment')} AS sentiment, TRY_CAST({na('sentiment_polarity')} AS DOUBLE) AS sentiment_polarity
  FROM stg_reviews
  WHERE {na('translated_review')} IS NOT NULL AND {na('sentiment')} IS NOT NULL)"""

PROFILE_TABLES = ("region nation customer supplier part orders lineitem events documents "
                  "embeddings pages benchmark labels conversations").split()

ORACLE: dict[str, str] = {
    "c_parse_rating": with_staging(f"""
SELECT raw_app_id, rating AS rating_raw, CAST({dec('rating', 3, 2)} AS DOUBLE) AS rating
FROM stg_apps"""),
    "c_parse_reviews": with_staging(f"""
SELECT raw_app_id, reviews AS reviews_raw, {count('reviews')} AS reviews_count FROM stg_apps"""),
    "c_parse_size": with_staging(f"""
SELECT raw_app_id, size AS size_raw, CAST({size_mb('size')} AS DOUBLE) AS size_in_mb FROM stg_apps"""),
    "c_parse_installs": with_staging(f"""
SELECT raw_app_id, installs AS installs_raw,
    {count("replace(replace(installs, '+', ''), ',', '')")} AS installs_count FROM stg_apps"""),
    "c_parse_price": with_staging(f"""
SELECT raw_app_id, price AS price_raw, CAST({price('price')} AS DOUBLE) AS price_usd,
    CAST({price('price')} > 0 AS INTEGER) AS is_paid FROM stg_apps"""),
    "c_parse_date": with_staging(f"""
SELECT raw_app_id, last_updated AS last_updated_raw, {long_date('last_updated')} AS last_updated_date
FROM stg_apps"""),
    "c_parse_polarity": with_staging(f"""
SELECT raw_review_id,
    CAST({dec('sentiment_polarity', 6, 5, SIGNED)} AS DOUBLE) AS sentiment_polarity,
    CAST({dec('sentiment_subjectivity', 6, 5)} AS DOUBLE) AS sentiment_subjectivity
FROM stg_reviews"""),
    "c_drop_shifted": with_staging("""
SELECT raw_app_id, app, category FROM stg_apps WHERE category <> '1.9'"""),
    "c_dedupe_latest": with_staging("""
SELECT app_id AS raw_app_id, concat('app_', substr(app_name, 5)) AS app FROM dim_built""", DIM_BUILT),
    "c_build_dim": with_staging(f"SELECT {_dbl_dim()} FROM dim_built", DIM_BUILT),
    "c_build_fact": with_staging(f"""
SELECT r.raw_review_id AS review_id, d.app_id, d.app_name, r.translated_review AS review_text,
    r.sentiment,
    CAST({dec('r.sentiment_polarity', 6, 5, SIGNED)} AS DOUBLE) AS sentiment_polarity,
    CAST({dec('r.sentiment_subjectivity', 6, 5)} AS DOUBLE) AS sentiment_subjectivity
FROM stg_reviews r JOIN dim_built d ON trim(r.app) = d.app_name""", DIM_BUILT),
    "c_parse_loose": with_staging(f"""
SELECT raw_app_id, installs, price, {LOOSE_INSTALLS} AS installs_clean, {LOOSE_PRICE} AS price_clean
FROM stg_apps"""),
    "c_dashboard_apps": with_staging("SELECT * FROM dash_apps", DASH_APPS),
    "c_dashboard_reviews": with_staging("SELECT * FROM dash_reviews", DASH_REVIEWS),
    "s_table_profile": """
SELECT c.table_name, CAST(COUNT(*) AS BIGINT) AS column_count, r.row_count,
    string_agg(c.column_name, ',' ORDER BY c.ordinal_position) AS column_names
FROM information_schema.columns c JOIN (
""" + "\nUNION ALL\n".join(
        f"SELECT '{t}' AS t, CAST(COUNT(*) AS BIGINT) AS row_count FROM {t}" for t in PROFILE_TABLES
    ) + """) r ON r.t = c.table_name
GROUP BY c.table_name, r.row_count""",
    "s_csv_roundtrip": with_staging("SELECT " + ", ".join(
        f"{na(c)} AS {c}" for c in ["app", "category", "rating", "reviews", "size", "installs", "type",
                                    "price", "content_rating", "genres", "last_updated",
                                    "current_ver", "android_ver"]) + " FROM stg_apps"),
    "s_reviews_csv": with_star("SELECT raw_review_id, " + ", ".join(
        f"{na(c)} AS {c}" for c in ["app", "translated_review", "sentiment", "sentiment_polarity", "sentiment_subjectivity"])
        + ", CAST(0 AS BIGINT) AS out_of_order FROM stg_reviews", STG_REVIEWS_SQL),
    "s_dim_sample": with_star("""
SELECT app_id, app_name, CAST(price_usd AS DOUBLE) AS price_usd, is_paid
FROM dim_apps ORDER BY app_id LIMIT 10"""),
}
