"""Session settings shared by jobs, tests and the bench."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def build_session(app: str = "boutline", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with AQE, UTC and Arrow. On a cluster, master and sizes come
    from spark-submit; the arguments are for local runs."""
    b = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        b = b.master(master).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g")
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return b.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in spark.checkpoint.dir. A folder of
    our own is set only where that is unset and the master is local (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    path = tempfile.mkdtemp(prefix="boutline-checkpoint-")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def cut_lineage(df):
    """Write ``df`` as a parquet table in the shared folder and read it back.

    Later steps read what they need of it (columns, filters), its size is known to
    the planner, and a lost executor repeats file reads only. The folder belongs to
    the job: its owner removes it when the job is over.
    """
    spark = df.sparkSession
    path = os.path.join(checkpoint_dir(spark), "tables", uuid.uuid4().hex)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
