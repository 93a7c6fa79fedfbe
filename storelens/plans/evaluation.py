"""Classifier evaluation (M7-M10, M12-M15, M17, M18, S9) as aggregate jobs.

Every metric is computed from aggregates, never from collected rows:
* confusion matrix / report: the (label, prediction) pairs collapse to at most k^2 counts
  in one partial aggregation; precision, recall, F1 and averages are arithmetic on those;
* one-vs-rest ROC-AUC: the Mann-Whitney statistic with tie-averaged ranks, computed from
  per-distinct-score counts and running sums over ranges of scores (``operators.ordered``) -
  exact for any range of scores, with no global sort into one task.

The ``m_*`` keys here evaluate a transparent lexicon scorer that is expressible in SQL (so the
metrics get a DuckDB oracle); the same operators evaluate the trained models' predictions in
``storelens.plans.classifier``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import ID2LABEL, LABEL2ID, name_of
from ..operators.ordered import running_sums
from ..operators.shares import pct, rnd
from ..session import cut_lineage
from .corpus import corpus, stratified_split

C = F.col
CLASSES = sorted(ID2LABEL)

# Marker words of the lexicon scorer, per class id
# (0 = Negative <- German/Spanish, 1 = Neutral <- French, 2 = Positive <- English).
LEXICON = {
    0: ["der", "die", "das", "und", "ist", "ein", "el", "los", "las", "y", "que", "del", "con", "por"],
    1: ["le", "la", "les", "et", "des", "du", "un", "une", "est", "sur", "au", "aux", "dans"],
    2: ["the", "and", "of", "to", "is", "it", "that", "was", "this", "with", "for", "on", "an"],
}

# Product action per predicted label.
ACTIONS = {"Positive": "prompt_in_app_rating", "Neutral": "route_to_feedback_backlog",
           "Negative": "route_to_qa_support"}

# Batch health verdicts and their thresholds (percent).
HEALTH_POSITIVE = "Predominantly Positive Feedback"
HEALTH_NEGATIVE = "Higher Concentration of Negative Feedback"
HEALTH_BALANCED = "Balanced Sentiment Distribution"
POSITIVE_SHARE_MIN = 60.0
NEGATIVE_SHARE_MIN = 30.0


# ----------------------------------------------------------------------------- scorer
def lexicon_scores(df: DataFrame) -> DataFrame:
    """p_c = (hits_c + 1) / (hits + K); prediction = argmax (ties to the higher class)."""
    # hits_c = number of >= 2-character tokens that are markers of class c, counted with one
    # compiled whole-word regex per class (no per-token interpreted lambda)
    def hits_of(words_):
        alts = "|".join(sorted((w for w in words_ if len(w) >= 2), key=lambda w: (-len(w), w)))
        return F.regexp_count(C("cleaned_review"), F.lit(f"(?<![a-z0-9])(?:{alts})(?![a-z0-9])"))

    hits = {c: hits_of(ws) for c, ws in LEXICON.items()}
    total = sum(hits.values())
    k = len(LEXICON)
    probs = {c: ((h + 1).cast("double") / (total + k)) for c, h in hits.items()}
    out = df.select("doc_id", "label", "split", *[probs[c].alias(f"p{c}") for c in CLASSES])
    pred = (F.when((C("p2") >= C("p1")) & (C("p2") >= C("p0")), F.lit(2))
            .when(C("p1") >= C("p0"), F.lit(1)).otherwise(F.lit(0)))
    return out.withColumn("prediction", pred)


def prior_scores(df: DataFrame) -> DataFrame:
    """Baseline: always the train split's class distribution (majority prediction)."""
    train = df.where(C("split") == "train")
    n = train.agg(F.count(F.lit(1))).scalar()
    shares = {c: train.agg(F.count_if(C("label") == c)).scalar() / n for c in CLASSES}
    out = df.select("doc_id", "label", "split", *[shares[c].cast("double").alias(f"p{c}") for c in CLASSES])
    pred = (F.when((C("p2") >= C("p1")) & (C("p2") >= C("p0")), F.lit(2))
            .when(C("p1") >= C("p0"), F.lit(1)).otherwise(F.lit(0)))
    return out.withColumn("prediction", pred)


# ----------------------------------------------------------------------------- metrics
def pair_counts(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    return pred.groupBy(C(label).alias("label"), C(prediction).cast("int").alias("prediction")).agg(
        F.count(F.lit(1)).cast("bigint").alias("n"))


def confusion_matrix(pred: DataFrame) -> DataFrame:
    """M7: rows = truth, one column per predicted class."""
    return (pair_counts(pred).groupBy("label").pivot("prediction", CLASSES).sum("n")
            .na.fill(0).select("label", *[C(str(c)).cast("bigint").alias(f"pred_{c}") for c in CLASSES]))


def per_class(pred: DataFrame) -> DataFrame:
    """tp, support, predicted per class from ONE aggregation pass (3 counts per class),
    stacked to one row per class; classes absent from both truth and prediction are
    dropped (they do not enter the averages)."""
    lab, prd = C("label"), C("prediction")
    aggs = []
    for c in CLASSES:
        aggs += [F.count_if((lab == c) & (prd == c)).alias(f"tp{c}"),
                 F.count_if(lab == c).alias(f"sup{c}"), F.count_if(prd == c).alias(f"pr{c}")]
    row = pred.agg(*aggs)
    j = row.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("cls"), C(f"tp{c}").alias("tp"), C(f"sup{c}").alias("support"),
                 C(f"pr{c}").alias("predicted")) for c in CLASSES])))
    j = j.where((C("support") + C("predicted")) > 0)
    prec = F.coalesce(C("tp") / F.nullif(C("predicted"), F.lit(0)), F.lit(0.0))
    rec = F.coalesce(C("tp") / F.nullif(C("support"), F.lit(0)), F.lit(0.0))
    f1 = F.coalesce(2 * prec * rec / F.nullif(prec + rec, F.lit(0.0)), F.lit(0.0))
    return j.select("cls", "tp", "support", "predicted", prec.alias("precision"),
                    rec.alias("recall"), f1.alias("f1_score"))


def classification_report(pred: DataFrame, digits: int = 8) -> DataFrame:
    """M8: per-class P/R/F1/support, accuracy, macro and weighted averages (0/0 -> 0)."""
    pc = per_class(pred)
    rows = pc.select(name_of(C("cls")).alias("row_name"), rnd(C("precision"), digits).alias("precision"),
                     rnd(C("recall"), digits).alias("recall"), rnd(C("f1_score"), digits).alias("f1_score"),
                     C("support").cast("bigint").alias("support"))
    total = pc.agg(F.sum("support")).scalar()
    acc = pc.agg(F.sum("tp") / F.sum("support")).scalar()
    macro = pc.agg(F.lit("macro avg").alias("row_name"),
                   rnd(F.avg("precision"), digits).alias("precision"),
                   rnd(F.avg("recall"), digits).alias("recall"),
                   rnd(F.avg("f1_score"), digits).alias("f1_score"),
                   F.sum("support").cast("bigint").alias("support"))
    w = C("support") / total
    weighted = pc.agg(F.lit("weighted avg").alias("row_name"),
                      rnd(F.sum(C("precision") * w), digits).alias("precision"),
                      rnd(F.sum(C("recall") * w), digits).alias("recall"),
                      rnd(F.sum(C("f1_score") * w), digits).alias("f1_score"),
                      F.sum("support").cast("bigint").alias("support"))
    accuracy = pc.agg(F.lit("accuracy").alias("row_name"), F.lit(None).cast("double").alias("precision"),
                      F.lit(None).cast("double").alias("recall"), rnd(acc, digits).alias("f1_score"),
                      F.sum("support").cast("bigint").alias("support"))
    return rows.unionByName(accuracy).unionByName(macro).unionByName(weighted)


def auc_ovr(pred: DataFrame, buckets: int | None = None, digits: int = 8) -> DataFrame:
    """M9: one-vs-rest ROC-AUC per class, plus macro and prevalence-weighted averages.

    Scores may have any range (probabilities or decision values): equal scores are added up first, and what
    lies below each comes from ranges split by a sample (``buckets`` of them, left to Spark by default).
    """
    long = pred.select("label", F.inline(F.array(*[
        F.struct(F.lit(c).alias("cls"), C(f"p{c}").cast("double").alias("score")) for c in CLASSES])))
    per_value = long.groupBy("cls", "score").agg(
        F.count_if(C("label") == C("cls")).alias("n_pos"),
        F.count_if(C("label") != C("cls")).alias("n_neg"))
    ranked = running_sums(per_value, ["cls"], [C("score")], {"neg_below": "n_neg"}, name="auc", parts=buckets)
    per_cls = ranked.groupBy("cls").agg(
        F.sum(C("n_pos") * (C("neg_below") + C("n_neg") * 0.5)).alias("u"),
        F.sum("n_pos").alias("P"), F.sum("n_neg").alias("N"))
    auc = C("u") / F.nullif(C("P") * C("N"), F.lit(0))
    # one row per class: the prevalence denominator is a window over those rows
    per_cls = per_cls.select("cls", auc.alias("auc"), "P")
    total = F.sum("P").over(Window.partitionBy())
    rows = per_cls.select(name_of(C("cls")).alias("row_name"), rnd(C("auc"), digits).alias("roc_auc"))
    macro = per_cls.agg(F.lit("macro").alias("row_name"),
                        rnd(F.when(F.count_if(C("auc").isNull()) == 0, F.avg("auc")), digits).alias("roc_auc"))
    weighted = per_cls.withColumn("__w", C("P") / total).agg(
        F.lit("weighted").alias("row_name"),
        rnd(F.when(F.count_if(C("auc").isNull()) == 0, F.sum(C("auc") * C("__w"))), digits).alias("roc_auc"))
    return rows.unionByName(macro).unionByName(weighted)


def log_loss(pred: DataFrame, digits: int = 8) -> DataFrame:
    """Unweighted mean cross-entropy of the true class probability."""
    p_true = F.coalesce(*[F.when(C("label") == c, C(f"p{c}")) for c in CLASSES])
    return pred.agg(rnd(F.avg(-F.log(p_true)), digits).alias("log_loss"),
                    F.count(F.lit(1)).cast("bigint").alias("n"))


def summary_metrics(pred: DataFrame, model: str, digits: int = 8) -> DataFrame:
    pc = per_class(pred)
    return pc.agg(F.lit(model).alias("model"),
                  rnd(F.sum("tp") / F.sum("support"), digits).alias("accuracy"),
                  rnd(F.avg("precision"), digits).alias("macro_precision"),
                  rnd(F.avg("recall"), digits).alias("macro_recall"),
                  rnd(F.avg("f1_score"), digits).alias("macro_f1"),
                  rnd(F.sum(C("f1_score") * C("support")) / F.sum("support"), digits).alias("weighted_f1"))


def model_metrics(pred: DataFrame, model: str, digits: int = 8) -> DataFrame:
    """A model's row of the comparison: the summary metrics and the macro one-vs-rest ROC-AUC."""
    auc = auc_ovr(pred, digits=digits).where(C("row_name") == "macro").select(F.lit(model).alias("model"), "roc_auc")
    return summary_metrics(pred, model, digits).join(auc, "model")  # one row each


def compare_models(metrics: DataFrame) -> DataFrame:
    """Model table with the winner (max macro F1; ties to the model name) flagged."""
    best = metrics.orderBy(C("macro_f1").desc(), C("model")).limit(1).select(
        C("model").alias("__best"))
    return metrics.join(F.broadcast(best), C("model") == C("__best"), "left").select(
        *metrics.columns, C("__best").isNotNull().alias("is_best"))


def batch_summary(pred: DataFrame) -> DataFrame:
    """Total and class shares (percent) of a scored batch."""
    p = C("prediction")
    n = F.count(F.lit(1))
    return pred.agg(n.cast("bigint").alias("total_reviews"),
                    pct(F.count_if(p == LABEL2ID["Positive"]), n, 4).alias("positive_pct"),
                    pct(F.count_if(p == LABEL2ID["Neutral"]), n, 4).alias("neutral_pct"),
                    pct(F.count_if(p == LABEL2ID["Negative"]), n, 4).alias("negative_pct"))


def health_status(summary: DataFrame) -> DataFrame:
    """Positive >= 60 % -> positive; else negative >= 30 % -> negative; else balanced."""
    s = (F.when(C("positive_pct") >= POSITIVE_SHARE_MIN, F.lit(HEALTH_POSITIVE))
         .when(C("negative_pct") >= NEGATIVE_SHARE_MIN, F.lit(HEALTH_NEGATIVE))
         .otherwise(F.lit(HEALTH_BALANCED)))
    return summary.withColumn("health_status", s)


def action_columns(prefix: str = "") -> dict[str, Column]:
    """M11/M14 columns: predicted sentiment, confidence % (2 dp) and product action, from ``prefix`` p0, p1, p2 and prediction."""
    name = name_of(C(f"{prefix}prediction"))
    conf = F.greatest(*[C(f"{prefix}p{c}") for c in CLASSES]) * 100
    act = F.when(name == "Positive", F.lit(ACTIONS["Positive"])).when(
        name == "Neutral", F.lit(ACTIONS["Neutral"])).otherwise(F.lit(ACTIONS["Negative"]))
    return {"predicted_sentiment": name, "confidence_score": rnd(conf, 2), "action": act}


def action_route(pred: DataFrame) -> DataFrame:
    """The columns of :func:`action_columns` for each document."""
    return pred.select("doc_id", *[x.alias(c) for c, x in action_columns().items()])


def class_probabilities(pred: DataFrame) -> DataFrame:
    """One row per (document, class) with the probability in percent."""
    return pred.select("doc_id", F.inline(F.array(*[
        F.struct(F.lit(ID2LABEL[c]).alias("sentiment"), rnd(C(f"p{c}") * 100, 6).alias("probability_pct"))
        for c in CLASSES])))


# ----------------------------------------------------------------------------- history
def training_time(history: DataFrame) -> DataFrame:
    """Total training seconds = sum of epoch_time_seconds (0 when absent)."""
    col = "epoch_time_seconds"
    if col not in history.columns:
        return history.agg(F.lit(0.0).alias("training_seconds"))
    return history.agg(F.coalesce(F.sum(col), F.lit(0.0)).cast("double").alias("training_seconds"))


def best_epoch(history: DataFrame, metric: str = "val_macro_f1") -> DataFrame:
    """Epoch with the highest validation metric; the first epoch wins ties."""
    return history.orderBy(C(metric).desc(), C("epoch").asc()).limit(1)


def read_history(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).json(path)


# ----------------------------------------------------------------------------- keyed jobs
def _scored(spark: SparkSession, sf: str) -> DataFrame:
    """The scoring job writes its predictions once (the source also saves predictions before
    evaluating them); every metric job then reads that small table instead of replaying
    text cleaning for each aggregate."""
    return cut_lineage(lexicon_scores(stratified_split(corpus(spark, sf))))


def _test(spark, sf):
    return _scored(spark, sf).where(C("split") == "test")


def m_compare(spark: SparkSession, sf: str) -> DataFrame:
    scored = _scored(spark, sf)
    test = lambda d: d.where(C("split") == "test")
    prior = prior_scores(scored.select("doc_id", "label", "split"))
    return compare_models(model_metrics(test(scored), "lexicon").unionByName(model_metrics(test(prior), "prior")))


QUERIES = {
    "m_confusion": lambda spark, sf: confusion_matrix(_test(spark, sf)),
    "m_report": lambda spark, sf: classification_report(_test(spark, sf)),
    "m_auc_ovr": lambda spark, sf: auc_ovr(_test(spark, sf)),
    "m_logloss": lambda spark, sf: log_loss(_test(spark, sf)),
    "m_compare": m_compare,
    "m_batch_summary": lambda spark, sf: batch_summary(_scored(spark, sf)),
    "m_health_status": lambda spark, sf: health_status(batch_summary(_scored(spark, sf))),
    "m_action_route": lambda spark, sf: action_route(_scored(spark, sf)),
    "m_class_probabilities": lambda spark, sf: class_probabilities(_scored(spark, sf)),
}
