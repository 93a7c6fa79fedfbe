"""Anti joins for NOT EXISTS."""

from __future__ import annotations

from pyspark.sql import DataFrame


def anti(left: DataFrame, right: DataFrame, on) -> DataFrame:
    """``LEFT JOIN ... WHERE right.key IS NULL`` written as a left-anti join.

    With key names in ``on`` the right side is reduced to its distinct keys first, map-side too, so a
    key that many rows hold is shuffled once for each task.
    """
    if isinstance(on, str):
        on = [on]
    if isinstance(on, list) and all(isinstance(c, str) for c in on):
        right = right.select(*on).distinct()
    return left.join(right, on, "left_anti")
