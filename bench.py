"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = [
    "flagship_form_by_split", "w6_last_3_5_10", "w8_current_streak", "w12_patch_shift", "w15_temporal_split", "w17_stratified_random",
    "d1_player_to_team_pivot", "d3_meta_indicators", "d14_target_encoding", "j1_role_matchups", "j5_cooccurrence", "j8_nearest_in_time",
    "s3_upsert_keep_last", "v5_player_features", "v11_fit_transform", "v9_enhanced_features", "m10_bootstrap_interval",
    "m18_evaluation_report", "r4_feature_drift", "d20_outliers_iqr",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    from boutline.catalog import QUERIES
    from boutline.session import build_session

    spark = build_session("bench", f"local[{cpus}]", int(cpus))
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf}/orders.parquet").count()  # starts the JVM's machinery
    times = {}
    for name in sys.argv[1:] or HEADLINE:
        t = time.time()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t, 3)
    spark.stop()
    print(json.dumps({"metric": "total headline query time", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": Path(sf).name}))


if __name__ == "__main__":
    main()
