"""Golden metrics from published confusion matrices, history helpers, text helpers."""

import json

import pytest
from pyspark.sql import functions as F

from storelens.functions.text import ENGLISH_STOP_WORDS, ngrams
from storelens.plans import evaluation as EV
from storelens.plans.modeling import default_text_column

# Published confusion matrices (rows = truth Negative/Neutral/Positive).
MATRICES = {
    "logistic_regression": [[772, 49, 115], [40, 518, 66], [178, 144, 2317]],
    "linear_svm": [[746, 44, 146], [44, 505, 75], [144, 131, 2364]],
    "transformer": [[855, 13, 68], [34, 557, 33], [152, 31, 2456]],
}
# Published accuracy / macro F1 / weighted F1 of the same runs.
PUBLISHED = {
    "logistic_regression": (0.8590140509645153, 0.8265914549614489, 0.860965630679814),
    "linear_svm": (0.8609192664920219, 0.8258181462, 0.861764037),
    "transformer": (0.9211717075494166, 0.9065590718, 0.9220784217),
}


def _expanded(spark, m):
    rows = [(t, p, n) for t in range(3) for p in range(3) for n in [m[t][p]]]
    df = spark.createDataFrame(rows, "label int, prediction int, n int")
    return df.select("label", "prediction", F.explode(F.array_repeat(F.lit(1), F.col("n"))).alias("_"))


@pytest.mark.parametrize("model", sorted(MATRICES))
def test_report_matches_published(spark, model):
    rep = {r["row_name"]: r for r in EV.classification_report(_expanded(spark, MATRICES[model]), 12).collect()}
    acc, macro_f1, weighted_f1 = PUBLISHED[model]
    assert rep["accuracy"]["f1_score"] == pytest.approx(acc, abs=1e-9)
    assert rep["macro avg"]["f1_score"] == pytest.approx(macro_f1, abs=1e-9)
    assert rep["weighted avg"]["f1_score"] == pytest.approx(weighted_f1, abs=1e-9)
    assert rep["Positive"]["support"] == sum(MATRICES[model][2])


def test_confusion_roundtrip(spark):
    cm = EV.confusion_matrix(_expanded(spark, MATRICES["linear_svm"])).orderBy("label").collect()
    assert [[r.pred_0, r.pred_1, r.pred_2] for r in cm] == MATRICES["linear_svm"]


def test_auc_matches_rank_sum(spark):
    import random
    rnd = random.Random(7)
    rows = []
    for i in range(300):
        lab = rnd.randrange(3)
        raw = [round(rnd.random(), 2) for _ in range(3)]
        raw[lab] += 0.3
        s = sum(raw)
        rows.append((i, lab, *[x / s for x in raw]))
    df = spark.createDataFrame(rows, "doc_id long, label int, p0 double, p1 double, p2 double")
    got = {r.row_name: r.roc_auc for r in EV.auc_ovr(df, buckets=16).collect()}

    def brute(c):
        pos = [r[2 + c] for r in rows if r[1] == c]
        neg = [r[2 + c] for r in rows if r[1] != c]
        u = sum(1.0 if p > n else 0.5 if p == n else 0.0 for p in pos for n in neg)
        return u / (len(pos) * len(neg))
    for c, name in enumerate(["Negative", "Neutral", "Positive"]):
        assert got[name] == pytest.approx(brute(c), abs=1e-8)


def test_health_status(spark):
    df = spark.createDataFrame([(60.0, 10.0), (59.9, 30.0), (50.0, 20.0)], "positive_pct double, negative_pct double")
    assert [r.health_status for r in EV.health_status(df).collect()] == [
        EV.HEALTH_POSITIVE, EV.HEALTH_NEGATIVE, EV.HEALTH_BALANCED]


def test_history_helpers(spark, tmp_path):
    hist = [{"epoch": 1, "val_macro_f1": 0.86, "epoch_time_seconds": 104.43},
            {"epoch": 2, "val_macro_f1": 0.895, "epoch_time_seconds": 105.98},
            {"epoch": 3, "val_macro_f1": 0.895, "epoch_time_seconds": 108.49}]
    p = tmp_path / "history.json"
    p.write_text(json.dumps(hist))
    h = EV.read_history(spark, str(p))
    assert EV.training_time(h).first()[0] == pytest.approx(318.90)
    assert EV.best_epoch(h).first()["epoch"] == 2


def test_default_text_column():
    assert default_text_column(["id", "User_Review", "text"]) == "User_Review"
    assert default_text_column(["a", "b"]) == "a"


def test_stop_words_equal_spark_default(spark):
    from pyspark.ml.feature import StopWordsRemover
    assert ENGLISH_STOP_WORDS == StopWordsRemover.loadDefaultStopWords("english")


def test_ngrams_short_arrays(spark):
    df = spark.createDataFrame([("a b c",), ("a",), ("",)], "x string")
    got = df.select(ngrams(F.split("x", " "), 2).alias("g")).collect()
    assert [r.g for r in got] == [["a b", "b c"], [], []]
