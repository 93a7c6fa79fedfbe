"""SparkSession construction and lineage-cutting helpers."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_session(master: str | None = None, app_name: str = "storelens",
                shuffle_partitions: int | None = None) -> SparkSession:
    """Return the active session, or build a local one tuned for tests / bench.

    On a cluster the session already exists (spark-submit); we only add the
    settings that are missing. AQE stays on so shuffle partition counts and
    join strategies are re-planned from runtime statistics.
    """
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = (
        SparkSession.builder.master(master or f"local[{cpus}]")
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or int(cpus)))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "4g"))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``. Where it is unset, a scratch folder in local mode (tests), an error on a
    cluster: a folder on each machine's own disk would lose what other machines read."""
    current = spark.conf.get("spark.checkpoint.dir", None)
    if current:
        spark.sparkContext.setCheckpointDir(current)
        return current
    if not re.match(r"local(\[.*\])?$", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir is not set: name a folder that all executors share")
    local = tempfile.mkdtemp(prefix="storelens-ckpt-")
    spark.conf.set("spark.checkpoint.dir", local)
    spark.sparkContext.setCheckpointDir(local)
    return local


def scratch_root(spark: SparkSession) -> str:
    """This application's folder under the checkpoint folder; everything that ``cut_lineage`` writes is in it."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/storelens-{spark.sparkContext.applicationId}"


def clean_up(spark: SparkSession) -> None:
    """Delete this application's scratch tables. Frames that read them can't be used any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(scratch_root(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cut_lineage(df: DataFrame, name: str = "table") -> DataFrame:
    """Materialise ``df`` once as a parquet table in the shared checkpoint folder and read it back.

    Survives executor loss (the files live in the cluster's shared ``spark.checkpoint.dir``),
    computes the plan exactly once (an un-persisted ``Dataset.checkpoint`` runs it twice: one
    job to count, one to write) and stores columnar data instead of serialised rows. Each
    call writes a fresh folder.
    """
    path = f"{scratch_root(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)
