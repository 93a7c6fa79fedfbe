"""Typed parsing of raw string columns (C2-C8, C13), as native column expressions.

Each parser keeps the source ETL's regex gate before the cast: a value that does not match
gives the parser's default instead of whatever a permissive cast would make of it
(e.g. ``5.55E-17`` is NULL, not 0.00000).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The regex gates of the source ETL.
UNSIGNED_DECIMAL = r"^[0-9]+(\.[0-9]+)?$"
SIGNED_DECIMAL = r"^-?[0-9]+(\.[0-9]+)?$"
DIGITS = r"^[0-9]+$"
# The long date layout "January 7, 2018".
LONG_DATE = "MMMM d, yyyy"

# Strings a pandas CSV import turns into NULL (its default NA list).
NA_STRINGS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
    "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]


def na_to_null(c: Column) -> Column:
    return F.when(c.isin(NA_STRINGS), F.lit(None).cast("string")).otherwise(c)


def parse_decimal(c: Column, precision: int, scale: int, signed: bool = False,
                  default=None) -> Column:
    gate = SIGNED_DECIMAL if signed else UNSIGNED_DECIMAL
    t = f"decimal({precision},{scale})"
    parsed = F.when(c.rlike(gate), c.try_cast(t))
    if default is not None:
        parsed = parsed.otherwise(F.lit(default).cast(t))
    return parsed.cast(t)


def parse_count(c: Column) -> Column:
    return F.when(c.rlike(DIGITS), c.try_cast("bigint")).otherwise(F.lit(0)).cast("bigint")


def parse_installs(c: Column) -> Column:
    return parse_count(F.translate(c, "+,", ""))


def parse_price(c: Column) -> Column:
    return parse_decimal(F.replace(c, F.lit("$"), F.lit("")), 8, 2, default=0)


def parse_size_mb(c: Column) -> Column:
    low = F.lower(c)
    mb = F.replace(low, F.lit("m"), F.lit("")).try_cast("decimal(8,2)")
    kb = F.replace(low, F.lit("k"), F.lit("")).try_cast("decimal(8,2)")
    return (F.when(low.like("%m"), mb.cast("decimal(12,6)"))
            .when(low.like("%k"), (kb / F.lit(1024)).cast("decimal(12,6)"))
            .cast("decimal(12,6)"))


def parse_long_date(c: Column) -> Column:
    return F.try_to_date(c, LONG_DATE)


def parse_rating(c: Column) -> Column:
    return parse_decimal(c, 3, 2)


def parse_polarity(c: Column) -> Column:
    return parse_decimal(c, 6, 5, signed=True)


def parse_subjectivity(c: Column) -> Column:
    return parse_decimal(c, 6, 5)


def is_paid(price: Column) -> Column:
    return (price > 0).cast("int")


def loose_installs(c: Column) -> Column:
    """Dashboard parse: strip '+' and ',', first digit run, as DOUBLE."""
    digits = F.regexp_extract(F.translate(c, "+,", ""), r"(\d+)", 1)
    return F.nullif(digits, F.lit("")).try_cast("double")


def loose_price(c: Column) -> Column:
    """Dashboard parse: strip '$', first run of digits/dots, as DOUBLE, NULL -> 0.0."""
    run = F.regexp_extract(F.replace(c, F.lit("$"), F.lit("")), r"([\d\.]+)", 1)
    return F.coalesce(F.nullif(run, F.lit("")).try_cast("double"), F.lit(0.0))
