"""Review corpus preparation and profiling (P1-P9, E1-E7) over the ``documents`` table.

``documents`` stands in for the labelled review export: ``text`` is the review and the
3-class sentiment is derived from ``lang`` (en -> Positive, fr -> Neutral, other ->
Negative). Texts are processed whole, with built-in string / array functions only.

Scale notes
* P1 dedupes on (text hash, sentiment) with a hash aggregate (partial aggregation collapses a
  hot group of copies map-side); the kept row is the first in load order (min doc_id). The texts themselves
  are only joined with the places of the copies that go.
* Quantiles (E2, E6) are exact order statistics by histogram refinement over a table of lengths.
* P5 gives *exact* stratified cuts without a window over a whole class: rows are bucketed
  by the leading hex digits of their hash, bucket sizes are prefix-summed per class (a
  table of at most classes x 16^digits rows, broadcast), and rows are ranked only inside
  their own bucket.
* Term statistics explode tokens and aggregate by term (partial aggregation); the
  vocabulary is a top-N (N is the size bound of the broadcast); per-document L2 norms
  use a window partitioned by document over at most N vocabulary terms.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import ENGLISH_STOP_WORDS, clean_text, content_terms, label_of, name_of, ngrams, terms, words
from ..operators.shares import rnd, share_of_total
from ..operators.parallelism import spread
from ..operators.quantiles import exact_quantiles
from ..operators.topk import top_k
from ..session import cut_lineage
from ..sources.testdata import table

C = F.col
SENTIMENTS = ["Positive", "Neutral", "Negative"]

# Language -> sentiment class used to label the documents corpus.
LANG_SENTIMENT = {"en": "Positive", "fr": "Neutral"}
OTHER_SENTIMENT = "Negative"


def _sentiment():
    return (F.when(C("lang") == "en", F.lit(LANG_SENTIMENT["en"]))
            .when(C("lang") == "fr", F.lit(LANG_SENTIMENT["fr"]))
            .when(C("lang").isNotNull(), F.lit(OTHER_SENTIMENT)))


def reviews_from_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return d.select("doc_id", "text", _sentiment().alias("sentiment"))


# ----------------------------------------------------------------------------- P1-P4
def load_corpus(raw: DataFrame) -> DataFrame:
    """Text and sentiment present, sentiment in the classes, first row per (text, sentiment)."""
    ok = raw.where(C("text").isNotNull() & C("sentiment").isNotNull()
                   & C("sentiment").isin(SENTIMENTS))
    return ok.groupBy("text", "sentiment").agg(F.min("doc_id").alias("doc_id")).select(
        "doc_id", "text", "sentiment")


def preprocess(corpus: DataFrame) -> DataFrame:
    """Cleaned text, blank-after-cleaning rows dropped, label encoded."""
    return (corpus.withColumn("cleaned_review", clean_text(C("text")))
            .where(F.length("cleaned_review") > 0)
            .withColumn("label", label_of(C("sentiment"))))


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each (text, sentiment), the least id's (a row without an id only where no copy has one).

    Rows are told apart by their place in the files. A text's 256-bit hash stands for it: groups
    of copies come from one aggregate over hashes, the rows that go are looked up in these groups alone, and the texts meet only the
    places of the rows that go. No text is an aggregate's value or is sorted; copies are few beside the
    corpus, so that join is a broadcast up to the planner's limit and shuffles beyond it.
    """
    raw = table(spark, sf_dir, "documents")
    placed = raw.select("doc_id", "text", _sentiment().alias("sentiment"), F.xxhash64("_metadata.file_path").alias("__file"),
                        C("_metadata.row_index").alias("__row")).where(
        C("text").isNotNull() & C("sentiment").isNotNull() & C("sentiment").isin(SENTIMENTS))
    slim = placed.select("sentiment", F.unhex(F.sha2("text", 256)).alias("__key"),
                         F.struct(C("doc_id").isNull().alias("none"), "doc_id", "__file", "__row").alias("__at"))
    copies = slim.groupBy("__key", "sentiment").agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__n")).where("__n > 1")
    go = slim.join(copies.drop("__n"), ["__key", "sentiment"]).where(C("__at") != C("__first")).select("__at.__file", "__at.__row")
    kept = spread(placed).join(go, ["__file", "__row"], "left_anti").withColumn("cleaned_review", clean_text(C("text")))
    return (kept.where(F.length("cleaned_review") > 0)
            .select("doc_id", "text", "sentiment", "cleaned_review", label_of(C("sentiment")).alias("label")))


# ----------------------------------------------------------------------------- P5-P7
def stratified_split(df: DataFrame, key: str = "doc_id", label: str = "label", seed: int = 42,
                     test_pct: int = 15, val_pct: int = 15, bucket_hex_digits: int = 4,
                     n_folds: int = 5) -> DataFrame:
    """P5: exact, reproducible, order-independent stratified train/val/test split.

    Within each class rows are ordered by ``md5(key || ':' || seed)``; the first
    ``ceil(n * test_pct / 100)`` are test, the next ``ceil(rest * val_pct / (100 -
    test_pct))`` are val, the remainder train (integer arithmetic, no float cut).
    """
    h = F.md5(F.concat(C(key).cast("string"), F.lit(":"), F.lit(str(seed))))
    d = (df.withColumn("__h", h)
         .withColumn("__b", F.conv(F.substring("__h", 1, bucket_hex_digits), 16, 10).cast("int")))
    sizes = d.groupBy(label, "__b").agg(F.count(F.lit(1)).alias("__nb"))
    before = Window.partitionBy(label).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(label, "__b",
                           F.coalesce(F.sum("__nb").over(before), F.lit(0)).alias("__off"),
                           F.sum("__nb").over(Window.partitionBy(label)).alias("__n"))
    # bound: (#classes) x 16^digits rows, fixed by construction
    in_bucket = Window.partitionBy(label, "__b").orderBy("__h", key)
    r = (d.join(F.broadcast(offsets), [label, "__b"])
         .withColumn("__pos", C("__off") + F.row_number().over(in_bucket)))
    n_test = F.floor((C("__n") * test_pct + 99) / 100)
    rest = C("__n") - n_test
    n_val = F.floor((rest * val_pct + (100 - test_pct) - 1) / (100 - test_pct))
    split = (F.when(C("__pos") <= n_test, F.lit("test"))
             .when(C("__pos") <= n_test + n_val, F.lit("val")).otherwise(F.lit("train")))
    # fold id for stratified k-fold cross-validation on the train rows
    fold = ((C("__pos") - 1) % n_folds).cast("int")
    return (r.withColumn("split", split).withColumn("fold", fold)
            .drop("__h", "__b", "__off", "__n", "__pos"))


def written_split(df: DataFrame, *columns: str) -> DataFrame:
    """P5 with ``columns``, as a table. The corpus is written first: the split reads its rows twice (sizes and places), which would
    read, dedupe and clean the texts twice."""
    return spread(cut_lineage(stratified_split(cut_lineage(df.select("doc_id", "label", "cleaned_review"), "corpus")).select(*columns), "split"))


def split_counts(split: DataFrame) -> DataFrame:
    return split.groupBy("split", "label").agg(F.count(F.lit(1)).cast("bigint").alias("n"))


def class_weights(split: DataFrame) -> DataFrame:
    """Balanced weights n / (k * n_c) on the train split."""
    per = (split.where(C("split") == "train").groupBy("label")
           .agg(F.count(F.lit(1)).cast("bigint").alias("n_train")))
    # n and k come from a window over the per-class rows (one row per class)
    every = Window.partitionBy()
    n, k = F.sum("n_train").over(every), F.count(F.lit(1)).over(every)
    return per.withColumn("weight", rnd(n.cast("double") / (k * C("n_train")), 6))


# ----------------------------------------------------------------------------- P9 TF-IDF
def tfidf_long(split: DataFrame, vocab_size: int = 20000, ngram_max: int = 2,
               stop_words=ENGLISH_STOP_WORDS) -> DataFrame:
    """TF-IDF weights as long rows (doc_id, term, weight), fit on the train split.

    Stop words go first; uni+bi-grams of >= 2-character tokens; vocabulary = top ``vocab_size``
    terms by train count (ties by term); tf = 1 + ln(count); idf = ln((1 + n) / (1 + df)) + 1; rows
    are L2-normalised over the vocabulary terms of the document. Terms outside the vocabulary
    are dropped before the per-document counts are shuffled.
    """
    tokens = split.select("doc_id", "split", content_terms(C("cleaned_review"), stop_words).alias("__t"))
    grams = F.concat(*[ngrams(C("__t"), n) for n in range(1, ngram_max + 1)]).alias("__g")
    seen = tokens.where(C("split") == "train").select(grams)
    counted = seen.select(F.explode("__g").alias("term"), F.lit(1).alias("c"), F.lit(0).alias("d")).union(
        seen.select(F.explode(F.array_distinct("__g")), F.lit(0), F.lit(1)))
    vocab = top_k(counted.groupBy("term").agg(F.sum("c").alias("__cnt"), F.sum("d").alias("__df")),
                  [C("__cnt").desc(), C("term")], vocab_size)
    n_train = split.where(C("split") == "train").agg(F.count(F.lit(1))).scalar()
    idf = vocab.select("term", (F.log((n_train + 1) / (C("__df") + 1)) + 1).alias("__idf"))
    # the tokens are shuffled by document once: counts and norms of a document need no shuffle of its terms
    known = tokens.select("doc_id", "__t").repartition("doc_id").select("doc_id", F.explode(grams).alias("term")).join(
        F.broadcast(idf), "term")
    w = known.groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("tf"), F.first("__idf").alias("__idf")).withColumn(
        "__w", (F.log(C("tf")) + 1) * C("__idf"))
    norm = F.sqrt(F.sum(C("__w") * C("__w")).over(Window.partitionBy("doc_id")))
    return w.select("doc_id", "term", rnd(C("__w") / norm, 6).alias("weight"))


# ----------------------------------------------------------------------------- E1-E7
def sentiment_distribution(df: DataFrame) -> DataFrame:
    g = df.groupBy("sentiment").agg(F.count(F.lit(1)).cast("bigint").alias("n_reviews"))
    return share_of_total(g, "n_reviews", "pct")


def _lengths(df: DataFrame) -> DataFrame:
    return df.select("sentiment", F.length("cleaned_review").cast("bigint").alias("char_length"),
                     F.size(words(C("cleaned_review"))).cast("bigint").alias("word_length"))


def _measures(df: DataFrame) -> DataFrame:
    """``(measure, sentiment, x)``: both lengths of every text, written once (the texts are read once)."""
    return cut_lineage(_lengths(df).select("sentiment", F.inline(F.array(*[
        F.struct(F.lit(m).alias("measure"), C(f"{m}_length").alias("x")) for m in ("char", "word")]))), "lengths")


def length_stats(df: DataFrame) -> DataFrame:
    """Mean / median / p95 / max of char and word length (linear-interpolated exact quantiles)."""
    lengths = _measures(df)
    q = exact_quantiles(lengths, ["measure"], "x", [0.5, 0.95, 1], ["median", "p95", "max"])
    mean = lengths.groupBy(C("measure").alias("of")).agg(rnd(F.avg("x"), 6).alias("mean"))
    each = q.join(mean, C("measure") == C("of")).select("measure", "mean", rnd(C("median"), 6).alias("median"), rnd(C("p95"), 6).alias("p95"), "max")
    return each.agg(*[F.max(F.when(C("measure") == m, C(c))).alias(f"{m}_{c}") for m in ("char", "word") for c in ("mean", "median", "p95", "max")])


def length_histogram(df: DataFrame, bins: int = 50) -> DataFrame:
    """Shared-edge histogram per sentiment: bin = (x - min) * bins // (max - min), last bin closed.

    The texts are read once, into a table of lengths; the least and greatest length of each measure (two rows) are
    joined back to it.
    """
    lengths = _measures(df)
    ends = lengths.groupBy(C("measure").alias("of")).agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    span = C("hi") - C("lo")
    b = F.when(span == 0, F.lit(0)).otherwise(
        F.least(F.lit(bins - 1), F.floor((C("x") - C("lo")) * bins / F.nullif(span, F.lit(0)))))
    return (lengths.join(F.broadcast(ends), C("measure") == C("of"))  # two rows
            .groupBy("measure", "sentiment", b.cast("bigint").alias("bin"))
            .agg(F.count(F.lit(1)).cast("bigint").alias("n_reviews")))


def term_cloud(df: DataFrame, sentiment: str = "Positive", k: int = 150) -> DataFrame:
    """Top-k terms of one class with weight relative to the most frequent term."""
    t = (df.where(C("sentiment") == sentiment)
         .select(F.explode(terms(C("cleaned_review"))).alias("term"))
         .groupBy("term").agg(F.count(F.lit(1)).cast("bigint").alias("n")))
    top = top_k(t, [C("n").desc(), C("term")], k)
    # the most frequent term is in the top-k: a window over those k rows, no second pass
    return top.withColumn("weight", rnd(C("n") / F.max("n").over(Window.partitionBy()), 6))


def top_ngrams(df: DataFrame, sentiment: str = "Positive", n: int = 20, gram: int = 2,
               stop_words: list[str] = ENGLISH_STOP_WORDS) -> DataFrame:
    """E5: top-n n-grams of one class; stop words go before pairing (pairs span them)."""
    toks = df.where(C("sentiment") == sentiment).select(content_terms(C("cleaned_review"), stop_words).alias("__t"))
    g = (toks.select(F.explode(ngrams(C("__t"), gram)).alias("ngram"))
         .groupBy("ngram").agg(F.count(F.lit(1)).cast("bigint").alias("count")))
    return top_k(g, [C("count").desc(), C("ngram")], n)


def token_length_profile(df: DataFrame, coverage_of: tuple[int, ...] = (64, 128, 256)) -> DataFrame:
    """Token-count profile; max length = first of 64/128/256 covering p95; coverage %."""
    lengths = cut_lineage(df.select(F.size(words(C("cleaned_review"))).alias("n_tokens")), "tokens")
    q = exact_quantiles(lengths, [], "n_tokens", [0.5, 0.95, 1], ["median_tokens", "p95_tokens", "max_tokens"])
    means = lengths.agg(F.count(F.lit(1)).alias("all"), rnd(F.avg("n_tokens"), 6).alias("mean_tokens"),
                        *[rnd(F.avg((C("n_tokens") <= v).cast("int")) * 100, 4).alias(f"coverage_{v}") for v in coverage_of])
    s = q.join(means, C("n") == C("all"), "right").select(  # one row each
        "mean_tokens", rnd(C("median_tokens"), 6).alias("median_tokens"), rnd(C("p95_tokens"), 6).alias("p95_tokens"),
        C("max_tokens").cast("bigint").alias("max_tokens"), *[f"coverage_{v}" for v in coverage_of])
    a, b, c = coverage_of
    rec = (F.when(C("p95_tokens") <= a, F.lit(a)).when(C("p95_tokens") <= b, F.lit(b))
           .otherwise(F.lit(c)))
    return s.withColumn("recommended_max_length", rec.cast("bigint"))


def truncate_tokens(df: DataFrame, max_length: int = 64) -> DataFrame:
    """The first ``max_length`` tokens of each cleaned review (model input window)."""
    kept = F.slice(words(C("cleaned_review")), 1, max_length)
    return df.select("doc_id", F.array_join(kept, " ").alias("truncated_review"),
                     F.size(kept).cast("bigint").alias("n_tokens_kept"))


# ----------------------------------------------------------------------------- keyed jobs
def _split(spark, sf):
    return stratified_split(corpus(spark, sf))


QUERIES = {
    "p_load_corpus": lambda spark, sf: load_corpus(reviews_from_documents(spark, sf)),
    "p_clean_text": lambda spark, sf: spread(table(spark, sf, "documents")).select(
        "doc_id", clean_text(C("text")).alias("cleaned_review")),
    "p_nonblank": lambda spark, sf: corpus(spark, sf).select("doc_id", "sentiment", "cleaned_review"),
    "p_label_encode": lambda spark, sf: corpus(spark, sf).select(
        "doc_id", "sentiment", "label", name_of(C("label")).alias("label_name")),
    "p_stratified_split": lambda spark, sf: _split(spark, sf).select("doc_id", "label", "split"),
    "p_split_counts": lambda spark, sf: split_counts(_split(spark, sf)),
    "p_class_weights": lambda spark, sf: class_weights(_split(spark, sf)),
    "p_tfidf_sql": lambda spark, sf: tfidf_long(written_split(corpus(spark, sf), "doc_id", "split", "cleaned_review")),
    "e_sentiment_distribution": lambda spark, sf: sentiment_distribution(corpus(spark, sf)),
    "e_length_stats": lambda spark, sf: length_stats(corpus(spark, sf)),
    "e_length_histogram": lambda spark, sf: length_histogram(corpus(spark, sf)),
    "e_term_cloud": lambda spark, sf: term_cloud(corpus(spark, sf)),
    "e_top_ngrams": lambda spark, sf: top_ngrams(corpus(spark, sf)),
    "e_token_length_profile": lambda spark, sf: token_length_profile(corpus(spark, sf)),
    "e_truncate": lambda spark, sf: truncate_tokens(corpus(spark, sf)),
}
