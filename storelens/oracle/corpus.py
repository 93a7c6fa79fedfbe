"""DuckDB oracles for the corpus / text-profiling keys.

DuckDB's RE2 patterns need no flags here: on the given corpus they agree with the flagged
Java patterns of ``storelens.functions.text``.
"""

from __future__ import annotations

from ..functions.text import ENGLISH_STOP_WORDS
from .star import PCT, R

CLEAN = ("trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(coalesce({x}, '')), "
         "'https?://\\S+|www\\.\\S+', '', 'g'), '<.*?>', '', 'g'), '[^a-z0-9\\s]', ' ', 'g'), "
         "'\\s+', ' ', 'g'))")


def clean(x: str) -> str:
    return CLEAN.format(x=x)


def words(x: str) -> str:
    return f"(CASE WHEN length({x}) = 0 THEN []::VARCHAR[] ELSE string_split({x}, ' ') END)"


def terms(x: str) -> str:
    return f"list_filter({words(x)}, lambda w: length(w) >= 2)"


def bigrams(t: str) -> str:
    return f"list_transform(range(1, len({t})), lambda i: {t}[i] || ' ' || {t}[i + 1])"


_STOPS = "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in ENGLISH_STOP_WORDS) + "]"

BASE = f"""
WITH raw AS (
  SELECT doc_id, text,
    CASE WHEN lang = 'en' THEN 'Positive' WHEN lang = 'fr' THEN 'Neutral'
         WHEN lang IS NOT NULL THEN 'Negative' END AS sentiment
  FROM documents),
corpus0 AS (
  SELECT MIN(doc_id) AS doc_id, text, sentiment FROM raw
  WHERE text IS NOT NULL AND sentiment IS NOT NULL AND sentiment IN ('Positive', 'Neutral', 'Negative')
  GROUP BY text, sentiment),
corpus AS (
  SELECT doc_id, text, sentiment, cleaned_review,
    CAST(CASE sentiment WHEN 'Negative' THEN 0 WHEN 'Neutral' THEN 1 WHEN 'Positive' THEN 2 END AS INTEGER) AS label
  FROM (SELECT *, {clean('text')} AS cleaned_review FROM corpus0) c
  WHERE length(cleaned_review) > 0),
split_rows AS (
  SELECT *, CASE WHEN pos <= n_test THEN 'test' WHEN pos <= n_test + n_val THEN 'val' ELSE 'train' END AS split
  FROM (SELECT *, (n * 15 + 99) // 100 AS n_test, ((n - (n * 15 + 99) // 100) * 15 + 84) // 85 AS n_val
        FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY label
                          ORDER BY md5(concat(CAST(doc_id AS VARCHAR), ':42')), doc_id) AS pos,
                     COUNT(*) OVER (PARTITION BY label) AS n
              FROM corpus) a) b),
lengths AS (
  SELECT sentiment, CAST(length(cleaned_review) AS BIGINT) AS char_length,
    CAST(len({words('cleaned_review')}) AS BIGINT) AS word_length
  FROM corpus)
"""


def q(body: str) -> str:
    return BASE + body.strip()


def _hist(m: str) -> str:
    return f"""
SELECT '{m}' AS measure, sentiment,
  CAST(CASE WHEN mx = mn THEN 0 ELSE least(49, ({m}_length - mn) * 50 // (mx - mn)) END AS BIGINT) AS bin,
  CAST(COUNT(*) AS BIGINT) AS n_reviews
FROM lengths, (SELECT MIN({m}_length) AS mn, MAX({m}_length) AS mx FROM lengths) r
GROUP BY ALL"""


VOCABULARY = f"""
, toks AS (SELECT doc_id, split, list_filter({terms('cleaned_review')}, lambda w: NOT list_contains({_STOPS}, w)) AS t FROM split_rows),
grams AS (SELECT doc_id, split, unnest(list_concat(t, {bigrams('t')})) AS term FROM toks),
tf AS (SELECT doc_id, split, term, COUNT(*) AS tf FROM grams GROUP BY doc_id, split, term),
vocab AS (SELECT term, SUM(tf) AS cnt, COUNT(*) AS df FROM tf WHERE split = 'train'
          GROUP BY term ORDER BY cnt DESC, term LIMIT 20000)"""
TFIDF = VOCABULARY + f""",
ntrain AS (SELECT COUNT(*) AS n FROM split_rows WHERE split = 'train'),
w AS (SELECT tf.doc_id, tf.term,
        (ln(tf.tf) + 1) * (ln((ntrain.n + 1.0) / (vocab.df + 1)) + 1) AS w
      FROM tf JOIN vocab ON tf.term = vocab.term CROSS JOIN ntrain)
SELECT doc_id, term, {R('w / sqrt(SUM(w * w) OVER (PARTITION BY doc_id))', 6)} AS weight FROM w"""

ORACLE: dict[str, str] = {
    "p_load_corpus": q("SELECT doc_id, text, sentiment FROM corpus0"),
    "p_clean_text": f"SELECT doc_id, {clean('text')} AS cleaned_review FROM documents",
    "p_nonblank": q("SELECT doc_id, sentiment, cleaned_review FROM corpus"),
    "p_label_encode": q("""
SELECT doc_id, sentiment, label,
  CASE label WHEN 0 THEN 'Negative' WHEN 1 THEN 'Neutral' WHEN 2 THEN 'Positive' ELSE 'Unknown' END AS label_name
FROM corpus"""),
    "p_stratified_split": q("SELECT doc_id, label, split FROM split_rows"),
    "p_split_counts": q("SELECT split, label, CAST(COUNT(*) AS BIGINT) AS n FROM split_rows GROUP BY split, label"),
    "p_class_weights": q(f"""
SELECT label, n_train, {R('n * 1.0 / (k * n_train)', 6)} AS weight
FROM (SELECT label, CAST(COUNT(*) AS BIGINT) AS n_train FROM split_rows WHERE split = 'train' GROUP BY label) p,
     (SELECT COUNT(*) AS n, COUNT(DISTINCT label) AS k FROM split_rows WHERE split = 'train') t"""),
    "p_tfidf_sql": BASE.rstrip() + TFIDF,
    "p_tfidf": BASE.rstrip() + TFIDF,
    "e_sentiment_distribution": q(f"""
SELECT sentiment, CAST(COUNT(*) AS BIGINT) AS n_reviews, {PCT('COUNT(*)', 'SUM(COUNT(*)) OVER ()')} AS pct
FROM corpus GROUP BY sentiment"""),
    "e_length_stats": q(f"""
SELECT {R('AVG(char_length)', 6)} AS char_mean, {R('quantile_cont(char_length, 0.5)', 6)} AS char_median,
  {R('quantile_cont(char_length, 0.95)', 6)} AS char_p95, CAST(MAX(char_length) AS DOUBLE) AS char_max,
  {R('AVG(word_length)', 6)} AS word_mean, {R('quantile_cont(word_length, 0.5)', 6)} AS word_median,
  {R('quantile_cont(word_length, 0.95)', 6)} AS word_p95, CAST(MAX(word_length) AS DOUBLE) AS word_max
FROM lengths"""),
    "e_length_histogram": q(_hist("char") + "\nUNION ALL\n" + _hist("word")),
    "e_term_cloud": q(f"""
SELECT term, n, {R('n * 1.0 / MAX(n) OVER ()', 6)} AS weight
FROM (SELECT term, CAST(COUNT(*) AS BIGINT) AS n
      FROM (SELECT unnest({terms('cleaned_review')}) AS term FROM corpus WHERE sentiment = 'Positive') x
      GROUP BY term ORDER BY n DESC, term LIMIT 150) t"""),
    "e_top_ngrams": q(f"""
SELECT ngram, CAST(COUNT(*) AS BIGINT) AS count
FROM (SELECT unnest({bigrams('t')}) AS ngram
      FROM (SELECT list_filter({terms('cleaned_review')}, lambda w: NOT list_contains({_STOPS}, w)) AS t
            FROM corpus WHERE sentiment = 'Positive') s) g
GROUP BY ngram ORDER BY count DESC, ngram LIMIT 20"""),
    "e_token_length_profile": q(f"""
SELECT mean_tokens, median_tokens, p95_tokens, max_tokens, coverage_64, coverage_128, coverage_256,
  CAST(CASE WHEN p95_tokens <= 64 THEN 64 WHEN p95_tokens <= 128 THEN 128 ELSE 256 END AS BIGINT)
    AS recommended_max_length
FROM (SELECT {R('AVG(word_length)', 6)} AS mean_tokens, {R('quantile_cont(word_length, 0.5)', 6)} AS median_tokens,
        {R('quantile_cont(word_length, 0.95)', 6)} AS p95_tokens, CAST(MAX(word_length) AS BIGINT) AS max_tokens,
        {R('AVG(CASE WHEN word_length <= 64 THEN 1 ELSE 0 END) * 100', 4)} AS coverage_64,
        {R('AVG(CASE WHEN word_length <= 128 THEN 1 ELSE 0 END) * 100', 4)} AS coverage_128,
        {R('AVG(CASE WHEN word_length <= 256 THEN 1 ELSE 0 END) * 100', 4)} AS coverage_256
      FROM lengths) s"""),
    "e_truncate": q(f"""
SELECT doc_id, array_to_string({words('cleaned_review')}[1:64], ' ') AS truncated_review,
  CAST(len({words('cleaned_review')}[1:64]) AS BIGINT) AS n_tokens_kept
FROM corpus"""),
}

ORACLE["p_tfidf_vectors"] = BASE.rstrip() + VOCABULARY + f""",
ntrain AS (SELECT COUNT(*) AS n FROM split_rows WHERE split = 'train'),
placed AS (SELECT term, df, ROW_NUMBER() OVER (ORDER BY term) - 1 AS i FROM vocab),
w AS (SELECT tf.doc_id, placed.i, (1 + ln(tf.tf)) * (1 + ln((1.0 + ntrain.n) / (1 + placed.df))) AS w FROM tf JOIN placed USING (term) CROSS JOIN ntrain)
SELECT doc_id, COUNT(*) AS n_terms, string_agg(CAST(i AS VARCHAR), ',' ORDER BY i) AS indices, {R('SUM(w) / sqrt(SUM(w * w))', 4)} AS weight_sum
FROM w GROUP BY doc_id"""
