"""Schema inspection, validation, adaptation and comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Columns that identify the known layouts.
PICK_COLUMNS = ("pick1", "pick2", "pick3", "pick4", "pick5")
POSITION_COLUMNS = ("top", "jng", "mid", "bot", "sup")
# Required and recommended columns of a match file.
REQUIRED = (
    "gameid", "league", "date", "teamname", "side", "result", "patch", "playoffs",
    "ban1", "ban2", "ban3", "ban4", "ban5",
)
RECOMMENDED = ("year", "split", "position", "champion", "gamelength")


def layout(columns: list[str]) -> str:
    have = set(columns)
    tests = {
        "player_level": {"position", "champion"},
        "team_level_picks": set(PICK_COLUMNS),
        "team_level_positions": set(POSITION_COLUMNS),
        "team_level_basic": {"teamname", "result"},
    }
    return next((name for name, need in tests.items() if need <= have), "unknown")


def _kind(dtype: str) -> str:
    if dtype in ("tinyint", "smallint", "int", "bigint"):
        return "integer"
    if dtype in ("float", "double") or dtype.startswith("decimal"):
        return "float"
    if dtype.startswith("timestamp") or dtype == "date":
        return "datetime"
    return "boolean" if dtype == "boolean" else "string"


def detect_schema(df: DataFrame) -> DataFrame:
    """(column_name, dtype, nulls, sample, row_count, layout), one pass.

    The sample is the smallest value, so that it does not depend on partitions.
    """
    types = dict(df.dtypes)
    agg = df.agg(
        F.count("*").alias("__n"),
        *[F.count_if(F.col(c).isNull()).alias(f"n{i}") for i, c in enumerate(df.columns)],
        *[F.min(F.col(c)).cast("string").alias(f"s{i}") for i, c in enumerate(df.columns)],
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(c).alias("column_name"), F.lit(_kind(types[c])).alias("dtype"),
                F.col(f"n{i}").alias("nulls"), F.col(f"s{i}").alias("sample"),
            )
            for i, c in enumerate(df.columns)
        ]
    )
    return agg.select("__n", F.explode(rows).alias("x")).select(
        "x.*", F.col("__n").alias("row_count"), F.lit(layout(df.columns)).alias("layout")
    )


def validate_schema(
    df: DataFrame,
    required: tuple[str, ...] = REQUIRED,
    recommended: tuple[str, ...] = RECOMMENDED,
    types: dict[str, str] | None = None,
    result: str = "result",
    strict: bool = False,
) -> DataFrame:
    """Findings (level, kind, column_name, detail). Names are compared on the
    driver (metadata); the outcome domain is one aggregate."""
    spark = df.sparkSession
    have = dict(df.dtypes)
    found = [("error", "missing_required", c, "") for c in required if c not in have]
    found += [("warning", "missing_recommended", c, "") for c in recommended if c not in have]
    extra = [c for c in df.columns if c not in required and c not in recommended]
    found += [("error" if strict else "info", "extra_column", c, "") for c in extra]
    for c, want in (types or {}).items():
        if c in have and _kind(have[c]) != want:
            found.append(("error" if strict else "warning", "type_mismatch", c, f"{want} expected, {_kind(have[c])} found"))
    out = spark.createDataFrame(found, "level string, kind string, column_name string, detail string")
    if result in have:
        bad = df.agg(F.count_if(~F.coalesce(F.col(result).try_cast("double").isin(0.0, 1.0), F.lit(False))).alias("bad"))
        out = out.unionByName(
            bad.filter("bad > 0").select(
                F.lit("error").alias("level"), F.lit("result_domain").alias("kind"), F.lit(result).alias("column_name"),
                F.col("bad").cast("string").alias("detail"),
            )
        )
    return out


def adapt_schema(df: DataFrame, rename: dict[str, str], add: dict[str, object], integers: list[str], dates: list[str]) -> DataFrame:
    """Rename, add absent columns with a constant, coerce integers (0 if bad) and dates."""
    out = df.withColumnsRenamed({k: v for k, v in rename.items() if k in df.columns})
    new = {c: F.lit(v) for c, v in add.items() if c not in out.columns}
    have = dict(out.dtypes)
    new |= {c: F.coalesce(F.col(c).try_cast("double").cast("int"), F.lit(0)) for c in integers if c in have}
    new |= {c: F.try_to_timestamp(c) if have[c] == "string" else F.col(c).cast("timestamp") for c in dates if c in have}
    return out.withColumns(new)


def compare_schemas(a: DataFrame, b: DataFrame) -> DataFrame:
    """(column_name, status, dtype_a, dtype_b, nulls_a, nulls_b): only_first,
    only_second, same, type_differs. A full join of both detected schemas."""
    x = detect_schema(a).select("column_name", F.col("dtype").alias("dtype_a"), F.col("nulls").alias("nulls_a"))
    y = detect_schema(b).select("column_name", F.col("dtype").alias("dtype_b"), F.col("nulls").alias("nulls_b"))
    status = (
        F.when(F.col("dtype_b").isNull(), "only_first")
        .when(F.col("dtype_a").isNull(), "only_second")
        .when(F.col("dtype_a") == F.col("dtype_b"), "same")
        .otherwise("type_differs")
    )
    return x.join(y, "column_name", "full").select(
        "column_name", status.alias("status"), F.coalesce("dtype_a", F.lit("")).alias("dtype_a"), F.coalesce("dtype_b", F.lit("")).alias("dtype_b"),
        F.coalesce("nulls_a", F.lit(0)).alias("nulls_a"), F.coalesce("nulls_b", F.lit(0)).alias("nulls_b"),
    )
