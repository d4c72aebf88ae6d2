"""Model records, retention, promotion and the retraining job."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from boutline.evaluation import metrics as M
from boutline.ml.training import fit_logistic, predict
from boutline.operators.features import CANONICAL_48, FeatureModel
from boutline.operators.filters import rolling_window
from boutline.operators.splits import temporal_split
from boutline.roles import MATCH, Roles
from boutline.session import cut_lineage

RUN_SCHEMA = "version string, created timestamp, metric string, value double, is_production boolean"


def record_model(model, metrics: DataFrame, root: str, version: str) -> None:
    """Save a fitted pipeline and append its (metric, value) rows to the run table."""
    model.write().overwrite().save(f"{root}/models/{version}")
    metrics.select(
        F.lit(version).alias("version"), F.current_timestamp().alias("created"), "metric", F.col("value").cast("double").alias("value"), F.lit(False).alias("is_production")
    ).write.mode("append").parquet(f"{root}/runs")


def run_history(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(RUN_SCHEMA).parquet(f"{root}/runs")


def versions(history: DataFrame) -> DataFrame:
    return history.groupBy("version").agg(F.max("created").alias("created"), F.bool_or("is_production").alias("is_production"))


def retention(history: DataFrame, keep: int = 10) -> DataFrame:
    """Versions older than the ``keep`` newest, production ones excepted. One row
    per version, so the window is over a short list."""
    w = Window.orderBy(F.desc("created"), F.desc("version"))
    return versions(history).withColumn("__r", F.row_number().over(w)).filter((F.col("__r") > keep) & ~F.col("is_production")).drop("__r")


def retrain(matches: DataFrame, months: int = 12, min_rows: int = 1000, roles: Roles = MATCH):
    """Rolling window -> temporal split -> features fitted on train -> logistic
    regression -> report. Returns (feature model, classifier, report)."""
    recent = rolling_window(matches, matches.agg(F.max(roles.time)).scalar(), months, roles)
    if recent.limit(min_rows).count() < min_rows:
        raise ValueError(f"fewer than {min_rows} rows in the window")
    tagged = cut_lineage(temporal_split(recent, roles=roles))
    train = tagged.filter("split = 'train'").drop("_rank", "split")
    fm = FeatureModel.fit(train)
    vec = cut_lineage(fm.vector(train, "rows", [roles.row, roles.outcome]))  # the fit reads it many times
    model = fit_logistic(vec, list(CANONICAL_48))
    held = fm.vector(tagged.filter("split <> 'train'").drop("_rank"), "snapshot", [roles.row, roles.outcome, "split"])
    scored = predict(model, vec.withColumn("split", F.lit("train")), ["split"]).unionByName(predict(model, held, ["split"]))
    return fm, model, M.report(scored, ["split"])


def promote_if_better(history: DataFrame, current: str, candidate: str) -> DataFrame:
    return M.promotion(M.compare_versions(history, current, candidate))
