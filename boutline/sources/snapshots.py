"""Partitioned sinks, dataset metadata and versioned snapshots."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from boutline.roles import MATCH, Roles


def metadata(df: DataFrame, roles: Roles = MATCH) -> DataFrame:
    """One row: rows, games, date range, rows per league and year, columns.

    The rows are reduced to (league, year) first; the maps hold one entry per
    league and per year.
    """
    base = df.agg(
        F.count("*").alias("rows"), F.countDistinct(roles.game).alias("games"), F.min(roles.time).alias("first_date"), F.max(roles.time).alias("last_date")
    )

    def counts(c):
        g = df.groupBy(c).agg(F.count("*").alias("n"))
        return g.agg(F.map_from_entries(F.collect_list(F.struct(c, "n")))).scalar()

    return base.select("*", counts(roles.league).alias("leagues"), counts(roles.year).alias("years"), F.array(*[F.lit(c) for c in df.columns]).alias("columns"))


def save_dataset(df: DataFrame, path: str, roles: Roles = MATCH) -> None:
    """Parquet by year; metadata beside it. The rebalance hint brings a year's rows
    together but splits a large year into tasks (and files) of the advisory size."""
    df.hint("rebalance", F.col(roles.year)).write.mode("overwrite").partitionBy(roles.year).parquet(f"{path}/data")
    metadata(df.sparkSession.read.parquet(f"{path}/data"), roles).select(F.to_json(F.struct("*")).alias("value")).coalesce(1).write.mode("overwrite").text(f"{path}/metadata")


def load_dataset(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/data")


def version_tag(df: DataFrame, when: Column, roles: Roles = MATCH) -> DataFrame:
    """'v<yyyy.mm.dd>_' and eight digits of md5(rows_games_lastdate), as one row."""
    last = F.date_format(F.max(roles.time), "yyyy-MM-dd")
    text = F.concat_ws("_", F.count("*").cast("string"), F.countDistinct(roles.game).cast("string"), last)
    return df.agg(F.concat(F.lit("v"), F.date_format(when, "yyyy.MM.dd"), F.lit("_"), F.substring(F.md5(text), 1, 8)).alias("tag"))


HISTORY_SCHEMA = "tag string, created timestamp, rows long, games long, note string"


def create_version(df: DataFrame, root: str, note: str = "", when: Column | None = None, roles: Roles = MATCH) -> str:
    """Write a tagged copy and append it to the history table; returns the tag."""
    when = F.current_date() if when is None else when
    tag = version_tag(df, F.first(when), roles).first()["tag"]
    df.write.mode("overwrite").parquet(f"{root}/versions/tag={tag}")
    row = df.agg(
        F.lit(tag).alias("tag"), F.current_timestamp().alias("created"), F.count("*").alias("rows"), F.countDistinct(roles.game).alias("games"), F.lit(note).alias("note")
    )
    row.write.mode("append").parquet(f"{root}/history")
    return tag


def list_versions(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(HISTORY_SCHEMA).parquet(f"{root}/history").orderBy("created")


def restore_version(spark: SparkSession, root: str, tag: str, target: str) -> DataFrame:
    """Copy a version over the target; the old target is kept as target_backup.
    Both are whole writes, so a lost executor only repeats tasks."""
    known = list_versions(spark, root).filter(F.col("tag") == tag).limit(1).count()
    if not known:
        raise ValueError(f"no version {tag}")
    try:
        current = spark.read.parquet(target)
    except AnalysisException:  # nothing to keep yet
        current = None
    if current is not None:
        current.write.mode("overwrite").parquet(f"{target}_backup")
    spark.read.parquet(f"{root}/versions/tag={tag}").write.mode("overwrite").parquet(target)
    return spark.read.parquet(target)
