"""Benchmark decontamination by winnowing (DataFrame functions only).

Fingerprints: for spans of ``L`` words, hash every run of k = (L + 1) // 2 words and keep the
least hash of every L - k + 1 neighbouring runs. Two texts that share L words in a row share
the least hash of that span, so every shared span is a candidate. A candidate fingerprint is
then extended to the whole L words around it, which are compared word by word.

Items of at least ``span`` words have windows of ``span`` words; a shorter item that has a word
is one window of its own length, found by the same scheme with its own k.

Defined results: a null or wordless text has no words and is never hit; a null or wordless item
has no window; an item without an id hits words but is not counted or listed; items that share
an id count once; repeated rows each get their own result; empty tables give empty or all-clean
results. Other columns are not looked at and may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, let, lower_ascii, text_key, up_to

#: Fixed values of the contract: a word after lower-casing, and before it.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
RAW_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
SPAN = 10


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(lower_ascii(text), F.lit(WORD), F.lit(0))


def n_words_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(RAW_WORD)), F.lit(0)).cast("bigint")


def _window_minima(words: Column, length: int) -> Column:
    """For each window of ``length`` words, the least hash of its runs of k words."""
    k = (length + 1) // 2
    w = length - k + 1

    def minima(runs: Column) -> Column:
        if w == 1:
            return runs
        return up_to(F.size(runs) - (w - 1), lambda i: F.least(*[F.get(runs, i + j) for j in range(w)]))

    def hashed(h: Column) -> Column:
        return let(up_to(F.size(h) - (k - 1), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(k)])), minima)

    return let(F.transform(words, lambda x: F.xxhash64(x)), hashed)


def _runs(words: Column, length: int) -> Column:
    """Structs (fp, pos, part): windows in a row with the same least hash, from word ``pos`` on;
    ``part`` is the words that they cover, joined by spaces."""
    def cut_up(w: Column, m: Column) -> Column:
        starts = F.filter(up_to(F.size(m), lambda i: i),
                          lambda i: (i == 0) | (F.get(m, i) != F.get(m, i - 1)))
        return let(starts, lambda at: F.transform(at, lambda s, k: F.struct(
            F.get(m, s).alias("fp"), s.alias("pos"),
            F.array_join(F.slice(w, s + 1, F.coalesce(F.get(at, k + 1), F.size(m)) - s + (length - 1)), " ").alias("part"))))

    return let(words, lambda w: let(_window_minima(w, length), lambda m: cut_up(w, m)))


def _windows(runs: Column, length: int) -> Column:
    """Structs (pos, win) of the windows in a run."""
    return let(F.split(runs["part"], " "), lambda w: up_to(F.size(w) - (length - 1), lambda i: F.struct(
        (runs["pos"] + i).alias("pos"), F.array_join(F.slice(w, i + 1, F.lit(length)), " ").alias("win"))))


def benchmark_windows(benchmark: DataFrame, span: int = SPAN, item_id: str = "item_id",
                      text: str = "text") -> DataFrame:
    """``(len, fp, win, item)`` of every window of the benchmark."""
    items = benchmark.select(F.col(item_id).cast("string").alias("item"), words_of(F.col(text)).alias("w"))
    items = items.withColumn("len", F.least(F.size("w"), F.lit(span))).where("len > 0")
    parts = []
    for length in range(1, span + 1):  # a plan for each length that may occur; most are empty
        parts.append(items.where(F.col("len") == length).select(
            "len", "item", F.explode(_runs(F.col("w"), length)).alias("x")))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.select("len", "x.fp", "item", F.explode(F.when(F.col("len") == span, _windows(F.col("x"), span)).otherwise(
        F.array(F.struct(F.col("x.pos"), F.col("x.part").alias("win"))))).alias("y")).select(
        "len", "fp", "y.win", "item").distinct()


def contaminated_texts(documents: DataFrame, benchmark: DataFrame, span: int = SPAN, text: str = "text",
                       item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row for each distinct text that holds a benchmark window:
    ``(key, n_hit, n_items, items)``; ``key`` is ``text_key`` of the text, ``items`` the sorted ids."""
    bench = cut(benchmark_windows(benchmark, span, item_id, item_text), "bench")
    lengths = sorted(r[0] for r in bench.select("len").distinct().collect())  # at most ``span`` values
    docs = documents.select(text_key(F.col(text)).alias("key"), F.col(text).alias("t")).where("t IS NOT NULL")
    spans = docs.select("key", F.lit(0).alias("pos"), F.lit(0).alias("len"), F.lit("").alias("item")).limit(0)
    for length in lengths:
        own = bench.where(F.col("len") == length)
        runs = docs.select("key", F.explode(_runs(words_of(F.col("t")), length)).alias("x")).select("key", "x.*")
        hits = cut(runs.join(own.select("fp").distinct(), "fp", "left_semi").distinct(), "hits")
        grown = hits.select("key", "fp", F.explode(_windows(F.struct("pos", "part"), length)).alias("x"))
        spans = spans.union(grown.select("key", "fp", "x.*").join(own, ["fp", "win"]).select(
            "key", "pos", F.lit(length).alias("len"), "item"))
    covered = F.flatten(F.transform("at", lambda a: F.sequence(a["pos"], a["pos"] + a["len"] - 1)))
    return spans.groupBy("key").agg(
        F.collect_set(F.struct("pos", "len")).alias("at"), F.array_sort(F.collect_set("item")).alias("items")
    ).select("key", F.size(F.array_distinct(covered)).cast("bigint").alias("n_hit"),
             F.size("items").cast("bigint").alias("n_items"), "items")


def decontamination_report(documents: DataFrame, benchmark: DataFrame, span: int = SPAN, doc_id: str = "doc_id",
                           text: str = "text") -> DataFrame:
    """A row for each document: its words, hit words and the items found in it."""
    found = cut(contaminated_texts(documents, benchmark, span, text), "contaminated")
    docs = documents.select(F.col(doc_id).alias("doc_id"), text_key(F.col(text)).alias("key"),
                            n_words_of(F.col(text)).alias("n_words"))
    zero = F.lit(0).cast("bigint")
    return docs.join(found, "key", "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", zero).alias("n_hit"), F.coalesce("n_items", zero).alias("n_items"),
        F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")), 256).alias("items_sha256"),
        F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"))


def drop_contaminated(documents: DataFrame, benchmark: DataFrame, span: int = SPAN, text: str = "text") -> DataFrame:
    """The documents without a hit, all columns as they were."""
    keys = cut(contaminated_texts(documents, benchmark, span, text).select("key"), "contaminated")
    return documents.join(keys, text_key(documents[text]) == keys["key"], "left_anti")
