"""Text expressions: cleaning, tokenising, n-grams and label maps (all JVM-side).

Java regex needs two flags to behave like the Python patterns of the source:
``(?U)`` so ``\\s`` / ``\\S`` are Unicode-aware, and ``(?d)`` so ``.`` stops only at
``\\n`` (Python's ``.``) instead of at every Unicode line terminator.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Sentiment label encoding and its inverse.
LABEL2ID = {"Negative": 0, "Neutral": 1, "Positive": 2}
ID2LABEL = {v: k for k, v in LABEL2ID.items()}

# Cleaning patterns (applied in this order after lower-casing).
URL_PATTERN = r"(?U)https?://\S+|www\.\S+"
TAG_PATTERN = r"(?d)<.*?>"
# "non [a-z0-9 whitespace] -> blank" followed by "whitespace runs -> one blank" is the same
# as "runs of anything outside [a-z0-9] -> one blank": one pass instead of two, and no
# dependence on the engine's notion of whitespace.
NON_ALNUM_RUN_PATTERN = r"[^a-z0-9]+"

# Spark ML's default English stop-word list
# (StopWordsRemover.loadDefaultStopWords("english"); a test asserts they are equal).
ENGLISH_STOP_WORDS = [
    "i", "me", "my", "myself", "we", "our", "ours", "ourselves", "you", "your", "yours",
    "yourself", "yourselves", "he", "him", "his", "himself", "she", "her", "hers", "herself",
    "it", "its", "itself", "they", "them", "their", "theirs", "themselves", "what", "which",
    "who", "whom", "this", "that", "these", "those", "am", "is", "are", "was", "were", "be",
    "been", "being", "have", "has", "had", "having", "do", "does", "did", "doing", "a", "an",
    "the", "and", "but", "if", "or", "because", "as", "until", "while", "of", "at", "by", "for",
    "with", "about", "against", "between", "into", "through", "during", "before", "after",
    "above", "below", "to", "from", "up", "down", "in", "out", "on", "off", "over", "under",
    "again", "further", "then", "once", "here", "there", "when", "where", "why", "how", "all",
    "any", "both", "each", "few", "more", "most", "other", "some", "such", "no", "nor", "not",
    "only", "own", "same", "so", "than", "too", "very", "s", "t", "can", "will", "just", "don",
    "should", "now", "i'll", "you'll", "he'll", "she'll", "we'll", "they'll", "i'd", "you'd",
    "he'd", "she'd", "we'd", "they'd", "i'm", "you're", "he's", "she's", "it's", "we're",
    "they're", "i've", "we've", "you've", "they've", "isn't", "aren't", "wasn't", "weren't",
    "haven't", "hasn't", "hadn't", "don't", "doesn't", "didn't", "won't", "wouldn't", "shan't",
    "shouldn't", "mustn't", "can't", "couldn't", "cannot", "could", "here's", "how's", "let's",
    "ought", "that's", "there's", "what's", "when's", "where's", "who's", "why's", "would",
]


def clean_text(c: Column) -> Column:
    """lower -> drop URLs -> drop tags -> non [a-z0-9 whitespace] to blank -> collapse -> strip.

    NULL gives ''. Every step is a built-in string function (whole-stage codegen).
    """
    t = F.lower(F.coalesce(c, F.lit("")))
    t = F.regexp_replace(t, URL_PATTERN, "")
    t = F.regexp_replace(t, TAG_PATTERN, "")
    t = F.regexp_replace(t, NON_ALNUM_RUN_PATTERN, " ")
    return F.trim(t)


def words(cleaned: Column) -> Column:
    """Whitespace tokens of cleaned text ('' -> empty array)."""
    return F.when(F.length(cleaned) == 0, F.array().cast("array<string>")).otherwise(
        F.split(cleaned, " "))


def terms(cleaned: Column) -> Column:
    """Vectoriser tokens: words of at least two characters (runs of blanks give empty
    strings, which the length filter drops)."""
    return F.filter(words(cleaned), lambda w: F.length(w) >= 2)


def strip_stop_words(cleaned: Column, stop_words: list[str] = ENGLISH_STOP_WORDS) -> Column:
    """Remove whole stop words from *cleaned* text (only [a-z0-9 ] left) in one compiled
    regex pass; ``terms(strip_stop_words(x))`` equals ``drop_stop_words(terms(x))``.

    A per-token ``array_contains`` against the list runs interpreted inside a lambda and
    costs |tokens| x |list| comparisons; the regex is compiled once and stays JVM-native.
    """
    words_ = sorted({w for w in stop_words if w.isalnum()}, key=lambda w: (-len(w), w))
    pattern = "(?<![a-z0-9])(?:" + "|".join(words_) + ")(?![a-z0-9])"
    return F.regexp_replace(cleaned, pattern, " ")


def content_terms(cleaned: Column, stop_words: list[str] = ENGLISH_STOP_WORDS) -> Column:
    """``terms(strip_stop_words(x))`` by one look-up in a hash set for each token (``isin`` of many literals).

    Where the tokens are used more than once, select them as a column first: array functions are not compiled, so
    an expression that names them several times cuts the text several times.
    """
    stops = sorted({w for w in stop_words if w.isalnum()})
    return F.filter(F.split(cleaned, " "), lambda w: (F.length(w) >= 2) & ~w.isin(stops))


def drop_stop_words(tokens: Column, stop_words: list[str] = ENGLISH_STOP_WORDS) -> Column:
    stops = F.array(*[F.lit(s) for s in stop_words])
    return F.filter(tokens, lambda w: ~F.array_contains(stops, w))


def ngrams(tokens: Column, n: int) -> Column:
    """Adjacent n-grams joined by a blank; arrays shorter than n give no n-gram.

    Built from n shifted slices zipped together, so each input array is evaluated a
    constant number of times (an index loop with ``element_at`` inside a lambda would
    re-evaluate the token expression per position: quadratic on long texts).
    """
    if n == 1:
        return tokens
    m = F.size(tokens) - n + 1
    shifted = [F.slice(tokens, j + 1, F.greatest(m, F.lit(1))) for j in range(n)]
    if n == 2:
        grams = F.zip_with(shifted[0], shifted[1], lambda a, b: F.concat(a, F.lit(" "), b))
    else:
        zipped = F.arrays_zip(*[s.alias(f"g{j}") for j, s in enumerate(shifted)])
        grams = F.transform(zipped, lambda z: F.concat_ws(" ", *[z[f"g{j}"] for j in range(n)]))
    return F.when(F.size(tokens) >= n, grams).otherwise(F.array().cast("array<string>"))


def label_of(sentiment: Column) -> Column:
    expr = None
    for name, i in LABEL2ID.items():
        expr = F.when(sentiment == name, F.lit(i)) if expr is None else expr.when(sentiment == name, F.lit(i))
    return expr.cast("int")


def name_of(label: Column) -> Column:
    expr = None
    for i, name in ID2LABEL.items():
        expr = F.when(label == i, F.lit(name)) if expr is None else expr.when(label == i, F.lit(name))
    return expr.otherwise(F.lit("Unknown"))
