"""Corpus preparation: the stages in order, each from the documents that its predecessor kept.

Every stage but the last returns the columns of ``documents``: documents whose language can't be told go,
repeated lines go (and documents that lose all their text), one document of each group of near copies
stays, documents with a benchmark passage go; the last stage draws the mix and returns, for each
document, the words that it takes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storelens.llm.common import cut, table
from storelens.llm.decontamination import drop_contaminated
from storelens.llm.language import keep_identified
from storelens.llm.lines import EXACT_CHARS, drop_lines
from storelens.llm.mixing import mix_report
from storelens.llm.simhash import MAX_BITS, SHINGLE_WORDS, keep_one_per_group


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_identified(docs)


def dedupe_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_lines(docs, exact_chars=EXACT_CHARS).withColumn("n_chars", F.char_length("text").cast("bigint"))


def dedupe_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one_per_group(docs, SHINGLE_WORDS, MAX_BITS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix_report(docs)


STAGES = [
    ("language ID", identify_language),
    ("line dedup", dedupe_lines),
    ("SimHash near-dedup", dedupe_documents),
    ("benchmark decontamination", decontaminate),
    ("mixing sources to target weights", mix_sources),
]

#: SQL has neither the network, the edit join's reassembly nor the seeded draws; the tests compare
#: every stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
