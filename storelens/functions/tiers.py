"""Bucketing helpers and the fixed tier labels of the analytical queries."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

# Rating tier labels (lower bound, label), checked top-down; the last is the
# ELSE branch. En-dashes and double blanks are part of the labels.
RATING_TIERS = [
    (4.5, "4.5 – 5.0  (Excellent)"),
    (4.0, "4.0 – 4.4  (Very Good)"),
    (3.5, "3.5 – 3.9  (Good)"),
    (3.0, "3.0 – 3.4  (Average)"),
    (2.0, "2.0 – 2.9  (Below Avg)"),
    (None, "0.0 – 1.9  (Poor)"),
]

# Price tiers (upper bound inclusive, label); 'Free' is price = 0.
PRICE_TIERS = [
    (0.0, "Free"),
    (0.99, "$0.01 – $0.99"),
    (4.99, "$1.00 – $4.99"),
    (9.99, "$5.00 – $9.99"),
    (None, "$10.00+"),
]

# Install buckets (lower bound, label), checked top-down.
INSTALL_BUCKETS = [
    (1000000000, "1 B+"),
    (100000000, "100 M – 999 M"),
    (10000000, "10 M – 99 M"),
    (1000000, "1 M – 9.9 M"),
    (100000, "100 K – 999 K"),
    (10000, "10 K – 99 K"),
    (None, "< 10 K"),
]


def _num(b):
    """Exact literal: floats become DECIMAL so comparisons with DECIMAL columns stay exact."""
    return F.lit(Decimal(str(b))) if isinstance(b, float) else F.lit(b)


def lower_bound_tiers(c: Column, tiers) -> Column:
    """CASE WHEN c >= b1 THEN l1 WHEN c >= b2 ... ELSE last."""
    expr = None
    for bound, label in tiers:
        if bound is None:
            return expr.otherwise(F.lit(label))
        cond = c >= _num(bound)
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr


def price_tier(c: Column) -> Column:
    expr = F.when(c == 0, F.lit(PRICE_TIERS[0][1]))
    for bound, label in PRICE_TIERS[1:]:
        if bound is None:
            return expr.otherwise(F.lit(label))
        expr = expr.when(c <= _num(bound), F.lit(label))
    return expr


def pricing_model(is_paid: Column) -> Column:
    return F.when(is_paid == 1, F.lit("Paid")).otherwise(F.lit("Free"))
