"""CSV ingest semantics (S1) and the incremental staging stream."""

from storelens.sources.raw import APPS_COLUMNS, REVIEWS_COLUMNS, read_raw
from storelens.streaming.ingest import stream_staging

CSV = (
    "App,Translated_Review,Sentiment,Sentiment_Polarity,Sentiment_Subjectivity\n"
    '"A, app","He said ""great""\nreally, it works",Positive,0.5,0.6\n'
    "B,nan,NaN,nan,\n"
)


def test_read_raw_quotes_newlines_and_na(spark, tmp_path):
    p = tmp_path / "reviews.csv"
    p.write_text(CSV)
    rows = read_raw(spark, str(p), REVIEWS_COLUMNS).orderBy("app").collect()
    assert len(rows) == 2
    assert rows[0].app == "A, app"
    assert rows[0].translated_review == 'He said "great"\nreally, it works'
    assert rows[1].translated_review is None and rows[1].sentiment is None
    assert rows[1].sentiment_subjectivity is None


def test_stream_staging_appends_once(spark, tmp_path):
    import uuid
    name = f"t_{uuid.uuid4().hex}"  # stream checkpoints live in the shared checkpoint dir
    landing, staging = tmp_path / "landing", tmp_path / "staging"
    landing.mkdir()
    header = ",".join(f'"{c}"' for c in APPS_COLUMNS)
    (landing / "a.csv").write_text(header + "\n" + ",".join(["x"] * 13) + "\n")
    q = stream_staging(spark, str(landing), str(staging), APPS_COLUMNS, name=name)
    q.awaitTermination(120)
    (landing / "b.csv").write_text(header + "\n" + ",".join(["y"] * 13) + "\n")
    q = stream_staging(spark, str(landing), str(staging), APPS_COLUMNS, name=name)
    q.awaitTermination(120)
    got = spark.read.parquet(str(staging))
    assert sorted(r.app for r in got.collect()) == ["x", "y"]
    assert "content_rating" in got.columns and "raw_app_id" in got.columns


def test_split_and_prediction_writers(spark, tmp_path):
    from pyspark.sql import functions as F

    from storelens.plans.corpus import corpus, stratified_split
    from storelens.plans.evaluation import lexicon_scores
    from storelens.sources.raw import save_predictions, write_splits
    from tests.conftest import SF_SMALL

    split = stratified_split(corpus(spark, SF_SMALL))
    write_splits(split.select("doc_id", "label", "split"), str(tmp_path / "splits"))
    back = spark.read.parquet(str(tmp_path / "splits"))
    assert back.count() == split.count()
    assert {r.split for r in back.select("split").distinct().collect()} == {"train", "val", "test"}
    pred = save_predictions(lexicon_scores(split), str(tmp_path / "pred"))
    row = pred.where(F.col("prediction") == F.col("label")).first()
    assert row.correct is True and row.predicted_sentiment in ("Negative", "Neutral", "Positive")


def test_staging_truncates_or_appends(spark, tmp_path):
    from storelens.sources.raw import with_load_id, write_staging

    path = str(tmp_path / "staging")
    write_staging(with_load_id(spark.range(10).repartition(3).toDF("app")), path)
    write_staging(with_load_id(spark.range(4).toDF("app")), path, truncate=False)
    assert spark.read.parquet(path).count() == 14
    write_staging(with_load_id(spark.range(5).repartition(3).toDF("app")), path)
    back = spark.read.parquet(path)
    assert back.count() == 5 and back.select("raw_app_id").distinct().count() == 5


def _random_csv(seed: int, rows: int, returns: bool = True) -> tuple[str, list[list[str]]]:
    """A CSV text with quoted line breaks, doubled quotes and stray quotes inside fields, and its records."""
    import random

    rng = random.Random(seed)
    out, records = [], []
    for i in range(rows):
        fields = []
        for _ in range(4):
            kind = rng.randrange(6)
            if kind == 0:
                fields.append((f"v{rng.randrange(99)}", None))
            elif kind == 1:
                fields.append(("a 5 inch", None))
            else:
                value = "".join(rng.choice(["x", "y,", '"', "\n", "\r\n" if returns else "z", '","', '"\n"', " ", "é", "\n\n"]) for _ in range(rng.randrange(1, 9)))
                fields.append((value, True))
        records.append([str(i)] + [v for v, _ in fields])
        out.append(",".join([str(i)] + [('"' + v.replace('"', '""') + '"') if q else v for v, q in fields]))
    end = rng.choice(["\n", "\r\n"]) if returns else "\n"
    return end.join(["id,a,b,c,d", *out]) + rng.choice(["", end]), records


def test_records_of_tiny_splits_equal_the_file(spark, tmp_path):
    from storelens.sources.records import read_records

    columns = ["id", "a", "b", "c", "d"]
    want = []
    for k in range(3):
        text, records = _random_csv(k, 60)
        (tmp_path / f"part-{k}.csv").write_bytes(text.encode())
        want += records
    old = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    for size in ("37b", "200b", "128m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        try:
            df = read_records(spark, str(tmp_path), columns, "n")
            got = sorted(map(tuple, df.collect()))
            if size == "37b":
                assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 100
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", old[0])
            spark.conf.set("spark.sql.files.openCostInBytes", old[1])
        assert [list(r[1:]) for r in got] == want  # in the files' order
        assert len({r[0] for r in got}) == len(want)


def test_records_agree_with_a_read_in_one_task(spark, tmp_path):
    from storelens.sources.records import read_records

    columns = ["id", "a", "b", "c", "d"]
    for k in range(4):
        path = tmp_path / f"{k}.csv"
        # without carriage returns: the one-task reader turns those inside quotes into line feeds, ours keeps them
        path.write_bytes(_random_csv(100 + k, 80, returns=False)[0].encode() + b'\n\n77,it"s,,"",last\n78,short\n')
        one = spark.read.schema(", ".join(f"{c} string" for c in columns)).option("header", True).option("multiLine", True).option(
            "escape", '"').csv(str(path))
        assert sorted(map(repr, read_records(spark, str(path), columns).drop("number").collect())) == sorted(map(repr, one.collect()))


def test_load_ids_follow_the_files(spark, tmp_path):
    header = ",".join(f'"{c}"' for c in APPS_COLUMNS) + "\n"
    for k, name in enumerate(["b", "a", "c"]):
        (tmp_path / f"{name}.csv").write_text(header + "".join(",".join([f"{name}{i:03d}"] + ["x" * (1000 if k == 0 else 1)] * 12) + "\n" for i in range(40)))
    rows = read_raw(spark, str(tmp_path), APPS_COLUMNS, load_id="raw_app_id").orderBy("raw_app_id").collect()
    assert [r.app for r in rows] == [f"{n}{i:03d}" for n in "abc" for i in range(40)]


def test_empty_files_have_no_records(spark, tmp_path):
    (tmp_path / "a.csv").write_text("")
    (tmp_path / "b.csv").write_text("App\n")
    assert read_raw(spark, str(tmp_path), ["App"]).count() == 0


def test_a_write_that_fails_keeps_the_old_table(spark, tmp_path):
    import os

    import pytest
    from pyspark.errors import PySparkException
    from pyspark.sql import functions as F

    from storelens.sources.raw import write_staging
    from storelens.sources.tables import written

    path = str(tmp_path / "staging")
    write_staging(spark.range(100).toDF("app"), path)
    assert written(spark, path)["rows"] == 100
    breaks = spark.range(0, 1000, numPartitions=4).toDF("app").withColumn(
        "app", F.when(F.col("app") == 900, F.raise_error(F.lit("broken")).cast("long")).otherwise(F.col("app")))
    for truncate in (True, False):
        with pytest.raises(PySparkException):
            write_staging(breaks, path, truncate=truncate)
        assert spark.read.parquet(path).count() == 100 and written(spark, path)["rows"] == 100
        assert os.listdir(tmp_path) == ["staging"]  # nothing is left beside it
    write_staging(spark.read.parquet(path).where("app < 40"), path)  # a table may be written from itself
    write_staging(spark.range(7).toDF("app"), path, truncate=False)
    about = written(spark, path)
    assert spark.read.parquet(path).count() == about["rows"] == 47
    assert about["files"] == len([f for f in os.listdir(path) if f.startswith("part-")])


def test_rows_that_cannot_be_read_back_are_an_error(spark, tmp_path, monkeypatch):
    import pytest

    from storelens.sources import tables

    path = str(tmp_path / "t")
    tables.replace_table(spark.range(5), path)

    class Short:
        get = {"n": 6}  # as if six rows had been written

    monkeypatch.setattr(tables, "Observation", Short)
    monkeypatch.setattr(type(spark.range(1)), "observe", lambda self, *a: self)
    with pytest.raises(tables.WriteError):
        tables.replace_table(spark.range(5), path)
    monkeypatch.undo()
    assert spark.read.parquet(path).count() == 5


def test_a_swap_that_fails_is_undone(spark, tmp_path, monkeypatch):
    import pytest

    from storelens.sources import tables

    path = str(tmp_path / "t")
    tables.replace_table(spark.range(5), path)
    rename = tables._Files.rename
    monkeypatch.setattr(tables._Files, "rename", lambda self, a, b: (_ for _ in ()).throw(tables.WriteError(a)) if ".new-" in a else rename(self, a, b))
    with pytest.raises(tables.WriteError):
        tables.replace_table(spark.range(9), path)
    assert spark.read.parquet(path).count() == 5


def test_refresh_of_the_star_is_bucketed_and_keeps_the_old_table_on_failure(spark):
    import uuid

    import pytest
    from pyspark.errors import PySparkException
    from pyspark.sql import functions as F

    from storelens.sources.raw import refresh_star

    d, f = f"dim_{uuid.uuid4().hex[:8]}", f"fact_{uuid.uuid4().hex[:8]}"
    dim = spark.range(50).toDF("app_id").withColumn("app_name", F.concat(F.lit("app_"), "app_id"))
    fact = spark.range(200).select((F.col("id") % 50).alias("app_id"), F.col("id").alias("review_id"))
    try:
        refresh_star(dim, fact, d, f, buckets=4)
        refresh_star(dim.where("app_id < 40"), fact, d, f, buckets=4)
        assert spark.table(d).count() == 40 and spark.table(f).count() == 200
        old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        try:
            joined = spark.table(f).join(spark.table(d), "app_id")
            assert "Exchange hashpartitioning" not in joined._jdf.queryExecution().executedPlan().toString() and joined.count() == 160
        finally:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        with pytest.raises(PySparkException):
            refresh_star(dim.withColumn("app_name", F.raise_error(F.lit("broken"))), fact, d, f, buckets=4)
        assert spark.table(d).count() == 40 and not [t for t in spark.catalog.listTables() if t.name.startswith(f"{d}__new")]
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {d}")
        spark.sql(f"DROP TABLE IF EXISTS {f}")


def test_scratch_tables_are_in_the_applications_folder(spark):
    from storelens.session import cut_lineage, scratch_root

    assert scratch_root(spark) in cut_lineage(spark.range(3), "probe").inputFiles()[0]
