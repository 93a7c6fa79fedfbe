"""Plan-shape checks and properties."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from storelens.plans import analytics as A
from storelens.plans.corpus import corpus, stratified_split
from storelens.sources.testdata import star
from tests.conftest import SF_SMALL


def plan(df) -> str:
    return df._jdf.queryExecution().sparkPlan().toString()


@pytest.fixture(scope="module")
def dim_fact(spark):
    return star(spark, SF_SMALL)


def test_top3_per_category_uses_window_group_limit(dim_fact):
    assert "WindowGroupLimit" in plan(A.q03_category_top3(*dim_fact))


def test_unreviewed_apps_is_left_anti(dim_fact):
    assert "LeftAnti" in plan(A.q24_reviewed_vs_not(*dim_fact))


def test_global_rank_never_single_partition_over_table(dim_fact):
    p = plan(A.q01_top_installs(*dim_fact))
    assert "TakeOrderedAndProject" in p
    # the only single-partition window is over the k selected rows
    assert p.count("Window [") <= 1


def test_no_python_udf_in_analytics(spark):
    for key in [k for k in E.queries() if k[0] in "qvcd"]:
        p = plan(E.queries()[key](spark, SF_SMALL))
        assert "BatchEvalPython" not in p and "ArrowEvalPython" not in p, key


def test_fact_is_preaggregated_before_join(dim_fact):
    p = plan(A.q37_category_matrix(*dim_fact))
    # the per-app HashAggregate sits below the join
    join_at = p.find("Join")
    assert "HashAggregate" in p[join_at:]


def test_category_matrix_preagg_equals_raw_join(spark, dim_fact):
    dim, fact = dim_fact
    raw = (dim.join(fact, "app_id", "left").groupBy(dim.category)
           .agg(F.sum(dim.installs_count).alias("ti"), F.count(fact.review_id).alias("tr")))
    got = {r.category: (r.total_installs, r.total_reviews) for r in A.q37_category_matrix(dim, fact).collect()}
    want = {r.category: (r.ti, r.tr) for r in raw.collect()}
    assert got == want


def test_shares_sum_to_100(dim_fact):
    rows = A.q05_rating_tiers(*dim_fact).collect()
    assert abs(sum(r.pct_of_total for r in rows) - 100) < 0.1


def test_topk_is_prefix_of_full_sort(dim_fact):
    dim, fact = dim_fact
    got = [r.app_name for r in A.q19_popular_low_rated(dim, fact).collect()]
    full = (dim.where((F.col("installs_count") >= 10000000) & F.col("rating").isNotNull())
            .orderBy(F.col("rating").asc(), F.col("installs_count").desc(), "app_name").collect())
    assert got == [r.app_name for r in full[:15]]


def test_rank_at_most_keeps_all_ties(spark):
    from storelens.operators.topk import rank_at_most
    df = spark.createDataFrame([(i, v) for i, v in enumerate([9, 9, 9, 8, 7, 7, 1])], "id int, v int")
    got = sorted((r.id, r.r) for r in rank_at_most(df, "v", 4, "r").collect())
    assert got == [(0, 1), (1, 1), (2, 1), (3, 4), (4, 5), (5, 5)][:4]


def test_corpus_keeps_one_row_of_repeated_and_null_ids(spark, tmp_path):
    rows = [(1, "a repeated text", "en"), (1, "a repeated text", "en"), (2, "a repeated text", "en"), (None, "no id at all", "fr"), (None, "no id at all", "fr"),
            (None, "one id here", "en"), (3, "one id here", "en"), (4, "one id here", "fr"), (5, None, "en")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(((r.doc_id, r.text) for r in corpus(spark, str(tmp_path)).collect()), key=repr)
    assert got == sorted([(1, "a repeated text"), (None, "no id at all"), (3, "one id here"), (4, "one id here")], key=repr)


def test_split_partitions_corpus_and_is_stratified(spark):
    c = corpus(spark, SF_SMALL)
    s = stratified_split(c)
    assert s.count() == c.count()
    assert s.select("doc_id").distinct().count() == c.count()
    per = {(r.label, r.split): r["count"] for r in s.groupBy("label", "split").count().collect()}
    for lab in {k[0] for k in per}:
        n = sum(v for (l2, _), v in per.items() if l2 == lab)
        assert per.get((lab, "test"), 0) == -(-n * 15 // 100)


def test_result_independent_of_partition_count(spark):
    key = "q21_most_reviewed"
    before = sorted(E.queries()[key](spark, SF_SMALL).collect())
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        after = sorted(E.queries()[key](spark, SF_SMALL).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert before == after


def test_dedupe_and_top_n_plan_window_group_limit(spark):
    for key in ("c_build_dim", "c_dashboard_apps", "q33_composite_leaders"):
        assert "WindowGroupLimit" in plan(E.queries()[key](spark, SF_SMALL)), key


def test_rank_with_ties_has_no_window_over_the_table(dim_fact):
    p = plan(A.q14_most_expensive(*dim_fact))
    # ranks come from the <= k per-value rows, joined back by broadcast
    assert "BroadcastHashJoin" in p or "BroadcastExchange" in p or "broadcast" in p.lower()


def test_spread_only_when_under_parallel(spark):
    from storelens.operators.parallelism import spread
    wide = spark.range(0, 1000, numPartitions=16)
    assert spread(wide, 8).rdd.getNumPartitions() == 16  # enough partitions: untouched
    narrow = spark.range(0, 1000, numPartitions=1)
    assert spread(narrow, 8).rdd.getNumPartitions() == 8


def test_corpus_moves_no_text_through_aggregates(spark):
    plan = corpus(spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    moving = [line for line in plan.splitlines() if "Aggregate" in line or "Sort " in line]
    assert moving and not any("text#" in line for line in moving)


def test_exact_quantiles_equal_percentile_on_ties_and_distinct_doubles(spark):
    import random

    from pyspark.sql import functions as F

    from storelens.operators.quantiles import exact_quantiles
    rng = random.Random(4)
    rows = [(rng.choice([None, "a", "b", "hot", "hot", "hot"]), rng.choice([None, 1.0, 1.0, 2.5, rng.gauss(0, 1), rng.uniform(-1e9, 1e9), -1.7e308, 1.7e308]))
            for _ in range(4000)] + [("one", 5.0), ("none", None), ("same", 2.0), ("same", 2.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    probs = [0, 0.25, 0.5, 0.95, 1]
    for by, few in ((["g"], 1 << 16), (["g"], 700), ([], 1500)):  # few: finished at once, or after rounds of bins
        got = {tuple(r[:len(by)]): tuple(r[len(by):]) for r in exact_quantiles(df, by, "v", probs, list("abcde"), bins=64, few=few).collect()}
        want = df.where("v is not null").groupBy(*by).agg(F.percentile("v", probs).alias("q"), F.count("v").alias("n")).collect()
        assert {tuple(r[b] for b in by) for r in want} == set(got)
        for r in want:
            n, *q = got[tuple(r[b] for b in by)]
            assert n == r.n and q == pytest.approx(r.q, rel=1e-12)


def test_running_sums_equal_windows_for_hot_and_null_groups(spark):
    import random

    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from storelens.operators.ordered import running_sums
    rng = random.Random(5)
    rows = [(i, rng.choice([None, "a"] + ["hot"] * 6), rng.choice([None, rng.randrange(50)]), rng.choice([None, 1, 2, 3])) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, g string, x int, v int")
    order = [F.col("x"), F.col("id")]
    got = running_sums(df, ["g"], order, {"before": F.col("v").cast("bigint")}, {"before": "total"}, parts=13)
    w = Window.partitionBy("g").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    want = df.select("*", F.coalesce(F.sum("v").over(w), F.lit(0)).alias("before"), F.sum("v").over(Window.partitionBy("g")).alias("total"))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)


def test_hot_join_spreads_hot_keys_and_equals_a_plain_join(spark):
    import random

    from pyspark.sql import functions as F

    from storelens.operators.hot_join import hot_join, hot_keys
    rng = random.Random(6)
    left = spark.createDataFrame([(i, rng.choice(["hot"] * 5 + ["warm"] * 2 + [None] + [f"k{j}" for j in range(8)])) for i in range(4000)], "id long, k string")
    right = spark.createDataFrame([("hot", 1), ("hot", 2), ("warm", 3), (None, 4), ("k1", 5), ("k1", 5), ("unused", 6)], "k string, v int")
    got = hot_join(left, right, "k", ["id"], parts=8)
    assert got.columns == ["k", "id", "v"]
    want = left.join(right, "k")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select("k", "id", "v").collect()))
    hot = {r["__hot"]: r["__salts"] for r in hot_keys(left, "k", 8).collect()}
    shares = {r.k: r.n for r in left.where("k is not null").groupBy("k").agg(F.count("*").alias("n")).collect()}
    total = sum(shares.values())
    assert hot == {k: -(-n * 8 // total) for k, n in shares.items() if n * 8 > total} and len(hot) < 8
    dealt = left.where("k = 'hot'").groupBy(F.pmod(F.xxhash64("id"), F.lit(hot["hot"]))).count().collect()
    assert len(dealt) == hot["hot"] and max(r["count"] for r in dealt) < 1.3 * total / 8
    assert hot_join(left.limit(0), right, "k", ["id"]).count() == 0


def test_filter_cube_answers_every_choice_of_filters(spark):
    from storelens.plans import dashboard as D
    from storelens.plans.star import dashboard_apps, dashboard_reviews
    from storelens.sources.testdata import staging_apps, staging_reviews

    apps, reviews = dashboard_apps(staging_apps(spark, SF_SMALL)).cache(), dashboard_reviews(staging_reviews(spark, SF_SMALL)).cache()
    cube = D.filter_cube(apps, reviews).cache()
    for category in (None, "2-HIGH", "1-URGENT", "no such"):
        for app_type in (None, "Free", "Paid"):
            f = D.Filters(category, app_type, None if app_type is None else "Positive")
            assert D.kpis_of(cube, f).first() == D.kpis(*D.apply_filters(apps, reviews, f)).first()
    for frame in (apps, reviews, cube):
        frame.unpersist()
