"""Quality rules with adaptive thresholds from mergeable quantile sketches (DataFrame functions only).

Every document gets four whole-number rates: mean word length (hundredths of a code point), symbols per 1,000
words, repeated lines per 1,000 lines, repeated words per 1,000 words. For each language and source a
rate's distribution is a sketch: counts of logarithmic cells, ``2 ** CELL_BITS`` of them for each power of two, so a
quantile is off by less than 1/64 of its value (values under 128 are exact). Sketches merge by adding counts: the sum
is the same in whatever order, so reruns agree, and the sketches of a language and of the whole corpus are sums of
those of its sources. Tasks add up their rows first, so what is shuffled is cells, not documents.

A rate is out of line if it lies more than ``FENCE`` spreads above the upper quartile (mean word length: or
below the lower one) of its language and source; the spread is the distance of the quartiles, ``LEAST_SPREAD`` at
least, since rates that are nearly always 0 have none. A language and source with fewer than ``LEAST_DOCS`` documents
with words uses its language's limits, and these failing the corpus's. The limits are joined back; a document stays if it
passes the base rules and no rate is out of line.

Repeated words are found without comparing windows: the three-word windows of a text are hashed, a text
whose hashes all differ has none; else hashes are sorted with their positions and only windows that share their leading bits
with a neighbour are compared as text.

Defined results: null, empty and wordless texts have no words, all counts 0, fail the base rules and enter no sketch;
null languages and sources are groups of their own; repeated rows are documents of their own; an empty
table gives no rows. Other columns are not looked at and may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, let, private, up_to

#: Fixed values of the contract.
WHITE, SYMBOLS = " \t\n\x0b\x0c\r", "#*$%&|<>"
LEAST_WORDS, MOST_REPEATED_PCT, WINDOW = 50, 50, 3

CELL_BITS, FENCE, LEAST_DOCS = 6, 3, 30
RATES = ("word_length", "symbols", "repeated_lines", "repeated_words")
LEAST_SPREAD = {"word_length": 50, "symbols": 50, "repeated_lines": 200, "repeated_words": 120}
LOW_TOO = ("word_length",)
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def words_of(text: Column) -> Column:
    bare = F.btrim(text, F.lit(WHITE))
    return F.when(F.length(bare) > 0, F.split(bare, r"[\x20\x09-\x0D]+")).otherwise(F.array().cast("array<string>"))


def _lines_with_words(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: F.length(F.btrim(x, F.lit(WHITE))) > 0)


def repeated_words(words: Column) -> Column:
    """Words in windows of three that are found twice or more in the text, each word once."""
    def window(w: Column, i: Column) -> list[Column]:
        return [F.get(w, i + j) for j in range(WINDOW)]

    def covered(at: Column) -> Column:
        return F.size(F.array_distinct(F.flatten(F.transform(at, lambda p: F.array(*[p + j for j in range(WINDOW)])))))

    def neighbours(sorted_: Column, same) -> Column:
        """Elements that are the same as the one before or after."""
        return F.filter(sorted_, lambda x, j: ((j > 0) & same(F.get(sorted_, j - 1), x)) | (
            (j + 1 < F.size(sorted_)) & same(F.get(sorted_, j + 1), x)))

    def found(w: Column, h: Column) -> Column:
        bits = F.length(F.bin(F.size(h).cast("bigint")))
        high = lambda x: F.call_function("shiftright", x, bits)
        keyed = F.sort_array(F.transform(h, lambda x, i: F.call_function("shiftleft", high(x), bits).bitwiseOR(i.cast("bigint"))))
        near = let(keyed, lambda k: neighbours(k, lambda a, b: high(a) == high(b)))
        places = F.transform(near, lambda k: (k - F.call_function("shiftleft", high(k), bits)).cast("int"))
        told = F.sort_array(F.transform(places, lambda p: F.struct(F.concat_ws(" ", *window(w, p)).alias("text"), p.alias("at"))))
        return covered(F.transform(let(told, lambda t: neighbours(t, lambda a, b: a["text"] == b["text"])), lambda x: x["at"]))

    def counted(w: Column) -> Column:
        hashes = up_to(F.size(w) - (WINDOW - 1), lambda i: F.xxhash64(*window(w, i)))
        return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(found(w, h)))

    return let(words, counted).cast("bigint")


def measured(documents: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> tuple[DataFrame, dict[str, str]]:
    """``documents`` with the counts and rates of each text, and the names of these columns."""
    keys = ("lang", "source", *COUNTS, "n_lines", *RATES)
    names = dict(zip(keys, private(documents, *(f"q_{k}" for k in keys)), strict=True))
    t, w, lines, bare = private(documents, "q_text", "q_word_list", "q_line_list", "q_bare")
    c = {k: F.col(n) for k, n in names.items()}
    out = documents.withColumn(t, F.coalesce(F.col(text), F.lit("")))
    out = out.withColumns({w: words_of(F.col(t)), lines: _lines_with_words(F.col(t)), bare: F.translate(t, WHITE, "")})
    out = out.withColumns({
        names["lang"]: F.col(lang).cast("string"), names["source"]: F.col(source).cast("string"),
        names["n_words"]: F.size(w).cast("bigint"), names["word_chars"]: F.char_length(bare).cast("bigint"),
        names["n_symbols"]: (F.char_length(bare) - F.char_length(F.translate(bare, SYMBOLS, ""))).cast("bigint"),
        names["n_lines"]: F.size(lines).cast("bigint"),
        names["n_dup_lines"]: (F.size(lines) - F.size(F.array_distinct(lines))).cast("bigint"),
        names["n_repeat_words"]: repeated_words(F.col(w))})
    per = lambda a, scale, b: F.when(c["n_words"] > 0, F.floor(c[a] * scale / c[b])).cast("bigint")
    out = out.withColumns({names["word_length"]: per("word_chars", 100, "n_words"), names["symbols"]: per("n_symbols", 1000, "n_words"),
                           names["repeated_lines"]: per("n_dup_lines", 1000, "n_lines"),
                           names["repeated_words"]: per("n_repeat_words", 1000, "n_words")})
    return out.drop(t, w, lines, bare), names


def cell(value: Column) -> Column:
    """Least value of the sketch cell that holds a whole number of at least 0."""
    shift = F.greatest(F.length(F.bin(value)) - (CELL_BITS + 1), F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, shift), shift)


def sketches(rates: DataFrame, lang: str = "lang", source: str = "source", columns: dict[str, str] | None = None) -> DataFrame:
    """``(lang, source, rate, cell, n)``: a sketch of each rate for each language and source."""
    columns = columns or {r: r for r in RATES}
    each = F.inline(F.array(*[F.struct(F.lit(r).alias("rate"), F.col(c).alias("value")) for r, c in columns.items()]))
    return rates.select(F.col(lang).alias("lang"), F.col(source).alias("source"), each).where("value is not null").groupBy(
        "lang", "source", "rate", cell(F.col("value")).alias("cell")).agg(F.count(F.lit(1)).alias("n"))


def merged(sketch: DataFrame, keys: list[str]) -> DataFrame:
    return sketch.groupBy(*keys, "rate", "cell").agg(F.sum("n").alias("n"))


def quartiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """``(*keys, rate, docs, low, high)``: the lower and upper quartile of each sketch."""
    of = Window.partitionBy(*keys, "rate")
    upto = F.sum("n").over(of.orderBy("cell").rowsBetween(Window.unboundedPreceding, 0))
    cells = sketch.select(*keys, "rate", "cell", upto.alias("upto"), F.sum("n").over(of).alias("docs"))
    at = lambda q: F.min(F.when(F.col("upto") * 4 >= F.col("docs") * q, F.col("cell")))
    return cells.groupBy(*keys, "rate").agg(F.max("docs").alias("docs"), at(1).alias("low"), at(3).alias("high"))


def limits(sketch: DataFrame, fence: int = FENCE, least_docs: int = LEAST_DOCS) -> DataFrame:
    """``(lang, source, <rate>_low, <rate>_high ...)``: the limits of each language and source of ``sketch``."""
    spread = F.greatest(F.col("high") - F.col("low"), F.coalesce(*[F.when(F.col("rate") == r, F.lit(s)) for r, s in LEAST_SPREAD.items()]))

    def wide(keys: list[str], tag: str) -> DataFrame:
        q = quartiles(merged(sketch, keys), keys).select(
            *[F.col(k).alias(f"{tag}_{k}") for k in keys], "rate", "docs", (F.col("low") - fence * spread).alias("low"),
            (F.col("high") + fence * spread).alias("high"))
        of = lambda r, c: F.max(F.when(F.col("rate") == r, F.col(c)))
        return q.groupBy(*[f"{tag}_{k}" for k in keys]).agg(
            F.max("docs").alias(f"{tag}_docs"), *[of(r, c).alias(f"{tag}_{r}_{c}") for r in RATES for c in ("low", "high")])

    own, by_lang, every = wide(["lang", "source"], "own"), wide(["lang"], "lang"), wide([], "all")
    out = own.join(by_lang, F.col("own_lang").eqNullSafe(F.col("lang_lang")), "left")
    out = out.withColumn("one", F.lit(1)).join(every.withColumn("one", F.lit(1)), "one")
    pick = lambda c: F.when(F.col("own_docs") >= least_docs, F.col(f"own_{c}")).when(
        F.col("lang_docs") >= least_docs, F.col(f"lang_{c}")).otherwise(F.col(f"all_{c}"))
    return out.select(F.col("own_lang").alias("lim_lang"), F.col("own_source").alias("lim_source"),
                      *[pick(f"{r}_{c}").alias(f"lim_{r}_{c}") for r in RATES for c in ("low", "high")])


def judged(table: DataFrame, names: dict[str, str], lim: DataFrame) -> tuple[DataFrame, Column, Column]:
    """``(rows, base_failed, out_of_line)``: ``table`` with the limits of its language and source joined, and, as
    columns over it, whether the base rules fail and the rates that are out of line, comma-joined."""
    c = {k: F.col(n) for k, n in names.items()}
    own = dict(zip(lim.columns, private(table, *lim.columns), strict=True))
    lim = lim.withColumnsRenamed(own)
    rows = table.join(lim, c["lang"].eqNullSafe(F.col(own["lim_lang"])) & c["source"].eqNullSafe(F.col(own["lim_source"])), "left")
    failed = (c["n_words"] < LEAST_WORDS) | (100 * c["n_repeat_words"] > MOST_REPEATED_PCT * c["n_words"])
    bound = lambda r, end: F.col(own[f"lim_{r}_{end}"])
    beyond = [F.when((c[r] > bound(r, "high")) | ((c[r] < bound(r, "low")) if r in LOW_TOO else F.lit(False)), F.lit(r)) for r in RATES]
    return rows, failed, F.concat_ws(",", *beyond)


def quality_report(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source",
                   fence: int = FENCE, least_docs: int = LEAST_DOCS) -> DataFrame:
    """A row for each document: its counts, whether the base rules fail, whether it stays, and the rates out of line."""
    table, names = measured(documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang"),
                                             F.col(source).alias("source")))
    table = cut(table.drop("text", "lang", "source"), "quality-rates")
    sketch = cut(sketches(table, names["lang"], names["source"], {r: names[r] for r in RATES}), "quality-sketches")
    rows, failed, beyond = judged(table, names, cut(limits(sketch, fence, least_docs), "quality-limits"))
    return rows.select("doc_id", *[F.col(names[k]).alias(k) for k in COUNTS], failed.alias("base_failed"),
                       (~failed & (beyond == "")).alias("kept"), beyond.alias("out_of_line"))


def keep_good(documents: DataFrame, text: str = "text", lang: str = "lang", source: str = "source",
              fence: int = FENCE, least_docs: int = LEAST_DOCS) -> DataFrame:
    """The rows of ``documents`` that pass, with their columns."""
    table, names = measured(documents, text, lang, source)
    sketch = cut(sketches(table, names["lang"], names["source"], {r: names[r] for r in RATES}), "quality-sketches")
    rows, failed, beyond = judged(table, names, cut(limits(sketch, fence, least_docs), "quality-limits"))
    return rows.where(~failed & (beyond == "")).select(documents.columns)
