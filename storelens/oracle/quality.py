"""DuckDB oracles for the validation suite, built from a table of checks.

A check is its source and the condition of the rows it counts (none: all rows); missing partners are
found with anti joins.
"""

from __future__ import annotations

from .star import STG_APPS_SQL, STG_REVIEWS_SQL, R, dirty, with_star
from .star_build import DIM_BUILT

AS_OF = "DATE '2001-12-31'"
DIM, FACT = "dim_apps", "fact_user_reviews"
ORPHANS = f"{FACT} ANTI JOIN {DIM} USING (app_id)"
UNREVIEWED = f"{DIM} ANTI JOIN {FACT} USING (app_id)"
RAW_ORPHANS = "(SELECT trim(app) AS app_name FROM stg_reviews) ANTI JOIN dim_built USING (app_name)"


def _outside(column: str, low: int, high: int) -> str:
    return f"NOT {column} BETWEEN {low} AND {high}"


# id: (label of the report, kind, source, counted rows or "distinct <column>"). The labels and the conditions are the
# definition of the checks.
CHECKS = {
    "V1.1": ("stg_google_play_apps", "row_count", "stg_apps", ""),
    "V1.2": ("stg_google_play_reviews", "row_count", "stg_reviews", ""),
    "V2.1": (DIM, "row_count", DIM, ""),
    "V2.2": (FACT, "row_count", FACT, ""),
    **{f"V3.{i}": (f"{t}.{c} IS NULL", "violation", t, f"{c} IS NULL") for i, (t, c) in enumerate(
        [*((DIM, c) for c in ("app_name", "category", "rating", "installs_count", "content_rating")), (FACT, "app_id"), (FACT, "sentiment")], 1)},
    "V5.1": ("rating NOT BETWEEN 0 AND 5", "violation", DIM, _outside("rating", 0, 5)),
    "V5.2": ("installs_count < 0", "violation", DIM, "installs_count < 0"),
    "V5.3": ("price_usd < 0", "violation", DIM, "price_usd < 0"),
    "V5.5": ("sentiment_polarity NOT BETWEEN -1 AND 1", "violation", FACT, _outside("sentiment_polarity", -1, 1)),
    "V5.6": ("sentiment_subjectivity NOT BETWEEN 0 AND 1", "violation", FACT, _outside("sentiment_subjectivity", 0, 1)),
    "V6.1": ("empty_or_null_review_text", "violation", FACT, "coalesce(trim(review_text), '') = ''"),
    "V7.1": ("orphan_fact_user_reviews", "violation", ORPHANS, ""),
    "V7.1r": ("orphan_raw_reviews", "violation", RAW_ORPHANS, ""),
    "V8.2": ("apps_without_reviews", "count", UNREVIEWED, ""),
    "V9.1": ("categories_with_null", "violation", DIM, "coalesce(trim(category), '') = ''"),
    "V9.2": ("distinct_categories", "count", DIM, "distinct category"),
    "V9.3": ("distinct_genres", "count", DIM, "distinct genres"),
    "V10.1": ("last_updated_date IS NULL", "violation", DIM, "last_updated_date IS NULL"),
    "V10.2": ("last_updated_date > NOW()", "violation", DIM, f"last_updated_date > {AS_OF}"),
    "V11.1": ("size_in_mb IS NULL", "violation", DIM, "size_in_mb IS NULL"),
}


def _counted(rule: str) -> str:
    if rule.startswith("distinct "):
        return f"count({rule})"
    return f"count(*) FILTER ({rule})" if rule else "count(*)"


def _stack(ids, label: str = "validation", value: str = "violation_count", meta: bool = False) -> str:
    rows = []
    for i in ids:
        name, kind, source, rule = CHECKS[i]
        first = f"'{i}' AS check_id, '{kind}' AS metric_kind, " if meta else ""
        rows.append(f"(SELECT {first}'{name}' AS {label}, CAST({_counted(rule)} AS BIGINT) AS {value} FROM {source})")
    return " UNION ALL ".join(rows)


def _all(body: str) -> str:
    return with_star(body, STG_APPS_SQL, STG_REVIEWS_SQL, DIM_BUILT)


def _stats(column: str, source: str, places: int) -> str:
    return (f"SELECT '{column}' AS metric, CAST(min({column}) AS DOUBLE) AS min_value, CAST(max({column}) AS DOUBLE) AS max_value, "
            f"{R(f'avg({column})', places)} AS avg_value, count({column}) AS non_null_count FROM {source}")


def _repeated(source: str, keys: str, tail: str) -> str:
    return with_star(f"SELECT {keys}, count(*) AS occurrence_count FROM {source} GROUP BY ALL HAVING count(*) > 1 {tail}")


def _sizes(more: str) -> str:
    return with_star(f"SELECT app_name, size_raw, CAST(size_in_mb AS DOUBLE) AS size_in_mb FROM {DIM} WHERE {more} "
                     "ORDER BY dim_apps.size_in_mb DESC, app_name LIMIT 10")


REPORT = _stack(CHECKS, "validation", "value", meta=True)

ORACLE: dict[str, str] = {
    "v_report": _all(REPORT),
    "v_issues": _all(f"FROM ({REPORT}) WHERE value > 0 AND metric_kind = 'violation'"),
    "v_summary": _all(f"""
SELECT count(*) AS total_checks, count(value) AS passed, count(*) - count(value) AS failed,
  count(*) FILTER (value > 0 AND metric_kind = 'violation') AS issues FROM ({REPORT})"""),
    "v_rowcounts": _all(_stack(["V1.1", "V1.2", "V2.1", "V2.2"], "table_name", "total_rows")),
    "v_nulls_dim": _all(_stack([f"V3.{i}" for i in range(1, 6)])),
    "v_nulls_fact": _all(_stack(["V3.6", "V3.7"])),
    "v_dup_apps": _repeated(DIM, "app_name", ""),
    "v_dup_reviews": _repeated(f"(FROM {FACT} WHERE review_text IS NOT NULL)", "app_id, review_text", "ORDER BY 3 DESC, 1, 2 LIMIT 20"),
    "v_ranges": _all(_stack(["V5.1", "V5.2", "V5.3", "V5.5", "V5.6"])),
    "v_bad_sentiment": with_star(
        f"SELECT sentiment, count(*) AS total_rows FROM {FACT} WHERE NOT list_contains(['Positive', 'Negative', 'Neutral'], sentiment) GROUP BY ALL"),
    "v_empty_text": _all(_stack(["V6.1"])),
    "v_orphans": _all(_stack(["V7.1", "V7.1r"])),
    "v_unreviewed_list": with_star(f"SELECT app_id, app_name, category FROM {UNREVIEWED} ORDER BY app_name, app_id LIMIT 25"),
    "v_unreviewed_count": _all(_stack(["V8.2"], "validation", "total_count")),
    "v_blank_category": _all(_stack(["V9.1"])),
    "v_distincts": _all(_stack(["V9.2", "V9.3"], "metric", "total_count")),
    "v_category_breakdown": with_star(f"SELECT category, count(*) AS app_count FROM {DIM} GROUP BY ALL"),
    "v_dates": _all(_stack(["V10.1", "V10.2"])),
    "v_date_range": with_star(f"SELECT min(last_updated_date) AS earliest_update, max(last_updated_date) AS latest_update FROM {DIM}"),
    "v_size_null": _all(_stack(["V11.1"])),
    "v_size_large": _sizes("size_in_mb > 500"),
    "v_size_sample": _sizes("size_in_mb IS NOT NULL"),
    "v_stats": with_star(" UNION ALL ".join([
        _stats("rating", DIM, 2), _stats("installs_count", DIM, 0), _stats("price_usd", DIM, 2),
        _stats("sentiment_polarity", FACT, 4), _stats("sentiment_subjectivity", FACT, 4)])),
}

# the whole suite: the counts from the table of checks, and the number of rows of the statements that return rows
_PLAIN = {
    "V4.1": ("duplicate app names", "violation", f"(SELECT app_name FROM {DIM} GROUP BY ALL HAVING count(*) > 1)"),
    "V4.2": ("duplicate reviews", "violation",
             f"(SELECT app_id FROM {FACT} WHERE review_text IS NOT NULL GROUP BY app_id, review_text HAVING count(*) > 1 LIMIT 20)"),
    "V5.4": ("sentiment outside the domain", "violation",
             f"(SELECT DISTINCT sentiment FROM {FACT} WHERE NOT list_contains(['Positive', 'Negative', 'Neutral'], sentiment))"),
    "V7.1": ("orphan_fact_user_reviews", "violation", ORPHANS),
    "V8.1": ("apps without reviews, by name", "rows", f"(FROM {UNREVIEWED} LIMIT 25)"),
    "V8.2": ("apps_without_reviews", "rows", UNREVIEWED),
    "V9.4": ("apps by category", "rows", f"(SELECT DISTINCT category FROM {DIM})"),
    "V10.3": ("range of update dates", "rows", "(SELECT 1)"),
    "V11.2": ("implausible sizes", "violation", f"(FROM {DIM} WHERE size_in_mb > 500 LIMIT 10)"),
    "V11.3": ("largest sizes", "rows", f"(FROM {DIM} WHERE size_in_mb IS NOT NULL LIMIT 10)"),
    **{f"V12.{k}": (f"{c} statistics", "rows", "(SELECT 1)") for k, c in enumerate(
        ("rating", "installs_count", "price_usd", "sentiment_polarity", "sentiment_subjectivity"), 1)},
}
SUITE = " UNION ALL ".join(
    [f"(SELECT '{i}' AS check_id, '{label}' AS validation, '{kind}' AS metric_kind, 'passed' AS status, CAST({_counted(rule)} AS BIGINT) AS value FROM {source})"
     for i, (label, kind, source, rule) in CHECKS.items() if i not in ("V7.1", "V7.1r", "V8.2")]
    + [f"(SELECT '{i}', '{label}', '{kind}', 'passed', count(*) FROM {source})" for i, (label, kind, source) in _PLAIN.items()])


ORACLE |= {
    "v_suite": _all(SUITE),
    "v_suite_dirty": dirty(_all(SUITE)),
    "v_suite_summary": _all(f"""
SELECT count(*) AS total_checks, count(value) AS passed, count(*) - count(value) AS failed,
  count(*) FILTER (metric_kind = 'violation' AND value > 0) AS issues FROM ({SUITE})"""),
    **{f"{k}_dirty": dirty(ORACLE[k]) for k in ("v_dup_apps", "v_bad_sentiment", "v_size_large")},
}
