"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Words between ASCII white space, as a Java pattern.
SPACE_WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder and read it back."""
    return cut_lineage(df, f"llm-{name}")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` with ``value`` evaluated once: a lambda variable, which the optimizer can't inline.

    A plain column that is used inside a lambda is put into it by the optimizer and then
    evaluated for each element.
    """
    return F.transform(F.array(value), body)[0]


def up_to(n: Column, body: Callable[[Column], Column]) -> Column:
    """``[body(0), ..., body(n - 1)]``; empty if ``n`` is not positive."""
    return F.transform(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")), body)


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, other letters unchanged (texts of ASCII alone take the faster function)."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, LOWER))


def text_key(text: Column) -> Column:
    """Identity of a text: SHA-256 as 32 bytes, null for a null text."""
    return F.unhex(F.sha2(text, 256))


def private(df: DataFrame, *names: str) -> list[str]:
    """Names like ``names`` that no column of ``df`` has, whatever the case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out
