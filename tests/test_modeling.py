"""Spark ML path on the smallest corpus: features, one fit, scoring, metrics, save/load."""

import pytest
from pyspark.sql import functions as F

from storelens.plans import modeling as M
from storelens.plans.evaluation import summary_metrics
from tests.conftest import SF_SMALL


@pytest.fixture(scope="module")
def fitted(spark):
    split, vocab, train, test = M.training_frames(spark, SF_SMALL)
    return split, vocab, train, test, M.fit_logistic_regression(train)


def test_train_score_and_persist(fitted, tmp_path):
    split, vocab, train, test, model = fitted
    assert train.count() > 0 and test.count() > 0
    assert vocab.count() <= M.MAX_FEATURES
    scored = M.score(model, test)
    row = scored.select((F.col("p0") + F.col("p1") + F.col("p2")).alias("s")).first()
    assert abs(row.s - 1.0) < 1e-9
    metrics = summary_metrics(scored, "lr").first()
    assert 0.0 <= metrics.accuracy <= 1.0
    M.save_model(model, str(tmp_path / "lr"))
    from pyspark.ml.classification import LogisticRegressionModel
    again = M.load_model(str(tmp_path / "lr"), LogisticRegressionModel)
    assert again.numClasses == model.numClasses


def test_batch_score_columns(spark, fitted):
    _, vocab, _, _, model = fitted
    docs = spark.createDataFrame([(1, "The cat and the dog."), (2, None)], "doc_id long, User_Review string")
    out = M.batch_score(model, vocab, docs).collect()
    assert len(out) == 2
    assert {r.predicted_sentiment for r in out} <= {"Negative", "Neutral", "Positive"}
    assert all(0 <= r.confidence_score <= 100 for r in out)


def test_batch_score_keeps_equal_ids_apart_and_input_columns(spark, fitted):
    split, vocab, _, _, model = fitted
    texts = [r.cleaned_review for r in split.orderBy("doc_id").limit(2).collect()]
    docs = spark.createDataFrame([(1, texts[0], "x"), (1, texts[1], "y"), (1, texts[1], "y")], "doc_id long, text string, note string")
    out = M.batch_score(model, vocab, docs)
    assert out.columns[:3] == ["doc_id", "text", "note"]
    alone = docs.withColumn("doc_id", F.monotonically_increasing_id()).dropDuplicates(["text"])
    each = {r.text: r.confidence_score for r in M.batch_score(model, vocab, alone).collect()}
    assert sorted((r.text, r.confidence_score) for r in out.collect()) == sorted([*each.items(), (texts[1], each[texts[1]])])


def test_weights_have_length_one(fitted):
    split, vocab, _, _, _ = fitted
    w = M.tfidf_entries(split, vocab).groupBy("doc_id").agg(F.sum(F.col("w") * F.col("w")).alias("n")).collect()
    assert w and all(abs(r.n - 1) < 1e-9 for r in w)


def test_content_terms_are_the_terms_without_stop_words(spark):
    from storelens.functions.text import content_terms, strip_stop_words, terms
    rows = [("the cat and a dog then the end",), ("",), (None,), ("x the  y zz",), ("theory ofthe and1 the",), ("the",)]
    df = spark.createDataFrame(rows, "c string")
    for stops in (M.ENGLISH_STOP_WORDS, ["cat"], []):
        got = df.select(content_terms(F.col("c"), stops).alias("a"), (terms(strip_stop_words(F.col("c"), stops)) if stops else terms(F.col("c"))).alias("b"))
        assert all(r.a == r.b for r in got.collect())


def test_terms_are_cut_once_and_not_shuffled(spark, fitted):
    """Of a text its tokens are shuffled once, by document; its terms stay in the task (they were shuffled twice, and every
    use of the tokens cut the text again)."""
    split, vocab, _, _, _ = fitted
    docs = split.select("doc_id", "cleaned_review")
    plan = M.tfidf_entries(docs, vocab)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("split(cleaned_review") == 1 and "regexp" not in plan


def test_split_reads_the_corpus_once(spark):
    from storelens.plans.corpus import written_split
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def cleaned(i):
        seen.add(1)
        return f"text {i}"
    df = spark.range(300).select(F.col("id").alias("doc_id"), (F.col("id") % 3).cast("int").alias("label"), cleaned("id").alias("cleaned_review"))
    split = written_split(df, "doc_id", "cleaned_review", "split")
    assert split.count() == 300 and seen.value == 300
    assert {r.split: r["count"] for r in split.groupBy("split").count().collect()} == {"test": 45, "val": 45, "train": 210}
