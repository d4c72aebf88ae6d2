"""Yearly match files: scan, overview and ingest."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boutline.operators import filters, schema, setops
from boutline.roles import MATCH, Roles
from boutline.sources.snapshots import create_version, save_dataset

# Types of the known raw columns; all others are text.
RAW_TYPES = {
    "date": "timestamp", "playoffs": "int", "year": "int", "game": "int", "result": "int", "gamelength": "double",
}


def list_files(spark: SparkSession, pattern: str) -> DataFrame:
    """(path, bytes, year) of the files of a glob; contents are not read."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(pattern).select("path", F.col("length").alias("bytes"))
    year = F.coalesce(F.regexp_extract("path", r"[/=](\d{4})_[^/]*(?:/[^/]*)?$", 1).try_cast("int"), F.lit(0))
    return f.withColumn("year", year)


def read_file(spark: SparkSession, path: str, year: int | None = None) -> DataFrame:
    """One file (or folder of equal files): known columns by name, typed; values
    that do not parse become null. The year comes from the name only if absent.
    Columns are matched by header, never by position, and nothing is inferred."""
    raw = spark.read.option("header", True).csv(path)
    d = filters.project_known(raw, filters.RAW_COLUMNS)
    d = d.select(*[(F.try_to_timestamp(c) if t == "timestamp" else F.col(c).try_cast(t)).alias(c) if t else F.col(c) for c, t in ((c, RAW_TYPES.get(c)) for c in d.columns)])
    if "year" not in d.columns:
        d = d.withColumn("year", F.lit(year) if year else F.year("date"))
    return d


def scan(spark: SparkSession, pattern: str) -> DataFrame:
    """All files of the glob, aligned by name. Headers differ between years, so each
    year is read with its own header; the union is one plan."""
    files = list_files(spark, pattern)
    by_year = files.withColumn("folder", F.regexp_replace("path", r"/part-[^/]*$", "")).select("year", "folder").distinct().orderBy("year", "folder")
    parts = [read_file(spark, r["folder"], r["year"] or None) for r in by_year.collect()]  # file names only
    return setops.union_years(parts)


def overview(spark: SparkSession, pattern: str) -> DataFrame:
    """Files, bytes and rows per year."""
    files = list_files(spark, pattern).groupBy("year").agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"))
    rows = scan(spark, pattern).groupBy("year").agg(F.count("*").alias("rows"))
    return files.join(rows, "year", "left")


def player_order(df: DataFrame) -> DataFrame:
    """Stand-in for file order where the source has none: a total order of the row's
    values, the same on every run."""
    return df.withColumn("ord", F.struct(*[F.col(c) for c in ("position", "playername", "champion") if c in df.columns]))


def to_match_rows(raw: DataFrame, leagues: list[str], min_games: int = 5, roles: Roles = MATCH) -> DataFrame:
    """Filter, pivot (before any dedupe), clean and canonicalise."""
    d = filters.in_leagues(filters.drop_leak_columns(raw), leagues, roles)
    d = player_order(d.withColumnsRenamed({"teamname": roles.entity}))
    ctx = ["league", "date", "patch", "split", "playoffs", "year", "game", "side", "result", "gamelength"]
    m = setops.team_rows_from_players(d, "ord", ctx, roles)
    m = filters.valid_rows(m, "result", "date", [roles.league, "result", roles.entity])
    m = filters.canonical_league(m, roles).withColumnsRenamed({"date": roles.time, "split": roles.split, "gamelength": roles.length})
    m = filters.fill_missing(m, roles)
    m = m.withColumns({c: F.col(c).cast("int") for c in (roles.year, roles.playoffs) if c in m.columns})
    return filters.min_games(m, min_games, roles)


def full_load(spark: SparkSession, pattern: str, target: str, leagues: list[str], required=("gameid", "league", "date", "teamname", "side", "result"), min_games: int = 5) -> str:
    """Scan -> check -> pivot -> write by year -> version. Returns the version tag."""
    raw = scan(spark, pattern)
    bad = schema.validate_schema(raw, tuple(required), ()).filter("kind = 'missing_required'")
    missing = [r["column_name"] for r in bad.collect()]  # column names only
    if missing:
        raise ValueError(f"missing columns: {missing}")
    save_dataset(to_match_rows(raw, leagues, min_games), target)
    stored = spark.read.parquet(f"{target}/data")
    return create_version(stored, target, "full load", F.current_date())


def incremental_load(spark: SparkSession, pattern: str, target: str, leagues: list[str], min_games: int = 5, roles: Roles = MATCH) -> int:
    """Append the rows that are not stored yet; returns the number of new rows.

    Entities need ``min_games`` rows among stored and new ones, so a load in parts
    over the same files ends with the table of a full load. Stored rows are not
    rewritten: only their keys are read, for the anti join and the counts. The new
    rows are written once to a staging folder and appended from there.
    """
    stored = spark.read.parquet(f"{target}/data")
    key = [roles.game, roles.side]
    fresh = to_match_rows(scan(spark, pattern), leagues, 1).join(stored.select(*key).distinct(), key, "left_anti")
    often = stored.select(roles.entity).union(fresh.select(roles.entity)).groupBy(roles.entity).count().filter(F.col("count") >= min_games).select(roles.entity)
    fresh = fresh.join(often, roles.entity, "left_semi")
    staging = f"{target}/staging"
    fresh.write.mode("overwrite").parquet(staging)
    new = spark.read.schema(fresh.schema).parquet(staging)
    n = new.count()
    if n:
        new.write.mode("append").partitionBy(MATCH.year).parquet(f"{target}/data")
    return n


def concat_sources(frames: list[DataFrame], keys: list[str], order: list[str]) -> DataFrame:
    """Several sources of the same rows: aligned by name, the first source wins."""
    tagged = [f.withColumn("__s", F.lit(i)) for i, f in enumerate(frames)]
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    return setops.keep_first(both, keys, ["__s", *order]).drop("__s")
