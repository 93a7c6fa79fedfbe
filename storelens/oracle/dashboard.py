"""DuckDB oracles for the dashboard computations."""

from __future__ import annotations

from .star import PCT, R, STG_APPS_SQL, with_staging, with_star
from .star_build import DASH_APPS, DASH_REVIEWS


def _dash(body: str) -> str:
    return with_staging(body, DASH_APPS, DASH_REVIEWS)


KPIS = f"""
SELECT CAST(COUNT(*) AS BIGINT) AS total_apps, {R('AVG(rating)', 4)} AS avg_rating,
    SUM(installs_clean) AS total_installs,
    (SELECT CAST(COUNT(*) AS BIGINT) FROM {{reviews}}) AS total_reviews
FROM {{apps}}"""

FILTERED_APPS = "(SELECT * FROM dash_apps WHERE category = '2-HIGH' AND type = 'Free')"
FILTERED_REVIEWS = "(SELECT * FROM dash_reviews WHERE sentiment = 'Positive')"

ORACLE: dict[str, str] = {
    "d_filters": _dash(f"SELECT * FROM {FILTERED_APPS} t"),
    "d_filters_reviews": _dash(f"SELECT * FROM {FILTERED_REVIEWS} t"),
    "d_filter_values": _dash("SELECT DISTINCT category FROM dash_apps WHERE category IS NOT NULL ORDER BY category"),
    "d_kpis": _dash(KPIS.format(apps="dash_apps", reviews="dash_reviews")),
    "d_kpis_filtered": _dash(KPIS.format(apps=FILTERED_APPS + " a", reviews=FILTERED_REVIEWS + " r")),
    "d_top_apps": _dash("""
SELECT raw_app_id, app, category, installs_clean, rating, reviews FROM dash_apps
ORDER BY installs_clean DESC NULLS LAST, rating DESC NULLS LAST, raw_app_id LIMIT 15"""),
    "d_low_rated_popular": _dash("""
SELECT raw_app_id, app, category, installs_clean, rating, reviews FROM dash_apps
WHERE installs_clean >= 10000000 ORDER BY rating ASC NULLS LAST, raw_app_id LIMIT 10"""),
    "d_sentiment_counts": _dash("""
SELECT sentiment, CAST(COUNT(*) AS BIGINT) AS count FROM dash_reviews
WHERE sentiment IS NOT NULL GROUP BY sentiment"""),
    "d_polarity_by_sentiment": _dash(f"""
SELECT sentiment, {R('AVG(sentiment_polarity)', 6)} AS mean_polarity FROM dash_reviews
WHERE sentiment IS NOT NULL GROUP BY sentiment"""),
    "d_rating_by_type": _dash(f"""
SELECT type, CAST(COUNT(rating) AS BIGINT) AS count, {R('AVG(rating)', 6)} AS mean FROM dash_apps
WHERE type IS NOT NULL GROUP BY type"""),
    "d_price_box": _dash(f"""
SELECT category, n_paid, {R('min_price', 6)} AS min_price, {R('q1', 6)} AS q1,
    {R('med', 6)} AS median, {R('q3', 6)} AS q3, {R('max_price', 6)} AS max_price,
    {R('q1 - (q3 - q1) * 1.5', 6)} AS lower_fence, {R('q3 + (q3 - q1) * 1.5', 6)} AS upper_fence
FROM (SELECT category, CAST(COUNT(*) AS BIGINT) AS n_paid, MIN(price_clean) AS min_price,
        quantile_cont(price_clean, 0.25) AS q1, quantile_cont(price_clean, 0.5) AS med,
        quantile_cont(price_clean, 0.75) AS q3, MAX(price_clean) AS max_price
      FROM dash_apps WHERE price_clean > 0 AND category IS NOT NULL GROUP BY category) b"""),
    "d_category_summary": _dash(f"""
SELECT category, CAST(COUNT(app) AS BIGINT) AS total_apps, {R('AVG(rating)', 6)} AS avg_rating,
    SUM(installs_clean) AS total_installs
FROM dash_apps WHERE category IS NOT NULL GROUP BY category
ORDER BY total_installs DESC NULLS LAST, category LIMIT 15"""),
    "d_rating_histogram": _dash(f"""
SELECT bin_index, {R('1 + bin_index * 0.2', 4)} AS bin_start, {R('1 + (bin_index + 1) * 0.2', 4)} AS bin_end,
    CAST(COUNT(*) AS BIGINT) AS app_count
FROM (SELECT CAST(greatest(0, least(19, floor((CAST(rating AS DECIMAL(10,4)) - 1) * 20 / 4))) AS BIGINT)
        AS bin_index FROM dash_apps WHERE rating IS NOT NULL) b
GROUP BY bin_index"""),
    "d_sentiment_share_all": with_star(f"""
SELECT sentiment, CAST(COUNT(*) AS BIGINT) AS total_reviews,
    {PCT('COUNT(*)', 'SUM(COUNT(*)) OVER ()')} AS pct_of_total
FROM fact_user_reviews GROUP BY sentiment"""),
    "d_paid_avg": with_star(f"""
SELECT is_paid, CAST(COUNT(*) AS BIGINT) AS total_apps, {R('AVG(rating)', 6)} AS avg_rating
FROM dim_apps GROUP BY is_paid"""),
    "d_category_installs": with_star("""
SELECT category, CAST(COUNT(*) AS BIGINT) AS total_apps, CAST(SUM(installs_count) AS BIGINT) AS total_installs
FROM dim_apps GROUP BY category ORDER BY total_installs DESC"""),
    "d_rating_counts": with_star("""
SELECT CAST(rating AS DOUBLE) AS rating, CAST(COUNT(*) AS BIGINT) AS app_count
FROM dim_apps WHERE rating IS NOT NULL GROUP BY rating"""),
    "d_low_rated_sql": with_star("""
SELECT app_name, category, installs_count, CAST(rating AS DOUBLE) AS rating, reviews_count
FROM dim_apps WHERE installs_count >= 10000000 ORDER BY rating ASC NULLS FIRST, app_name LIMIT 15"""),
}

POPULAR_SQL = STG_APPS_SQL.replace("stg_apps AS (", "stg_plain AS (") + """,
stg_apps AS (SELECT * REPLACE (CASE raw_app_id % 6 WHEN 1 THEN '50,000,000+' WHEN 2 THEN '10,000,000+' ELSE installs END AS installs) FROM stg_plain)"""

ORACLE |= {
    "d_low_rated_popular_dirty": ORACLE["d_low_rated_popular"].replace(STG_APPS_SQL.strip(), POPULAR_SQL.strip()),
    "d_kpis_from_cube": ORACLE["d_kpis_filtered"],
    "d_filter_cube": _dash(f"""
SELECT 'apps' AS frame, c AS category, t AS type, '(all)' AS sentiment, COUNT(*) AS total, {R('AVG(rating)', 4)} AS avg_rating, SUM(installs_clean) AS total_installs
FROM (SELECT unnest([category, '(all)']) AS c, type, rating, installs_clean FROM dash_apps WHERE category IS NOT NULL AND type IS NOT NULL) x,
  LATERAL (SELECT unnest([type, '(all)']) AS t) y GROUP BY ALL
UNION ALL
SELECT 'reviews', '(all)', '(all)', s, COUNT(*), NULL, NULL FROM (SELECT unnest([sentiment, '(all)']) AS s FROM dash_reviews) z GROUP BY ALL"""),
}
