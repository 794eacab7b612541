"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line."""
from __future__ import annotations

import json
import os
import re
import time

from rillmap.catalog import QUERIES
from rillmap.session import get_session, shared_dir

HEADLINE = [
    "mutual_nearest", "nearest_within_radius", "nearest_distance_profile", "knn_group_excluded", "spatial_dedupe", "spatial_anti_join", "adaptive_tiles",
    "nearest_line", "nearest_two_distinct", "point_in_polygon", "polygon_nearest_fallback", "line_intersections", "raster_lookup", "asof_path_neighbours",
    "clean_surveys", "cleaning_report", "collapse_first_nonnull", "match_multipass", "join_verified_id", "weighted_composite", "parse_hstore", "profile_features",
    "regression_metrics", "spearman", "calibration_table", "roc_auc", "group_kfold_random", "cluster_bootstrap_ci", "split_conformal", "feature_pipeline_multi",
    "oof_predictions", "cv_protocol", "model_ladder", "leave_state_out_variants", "per_group_models", "fold_safe_neighbour_features", "distance_to_network",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_session(cpus)
    spark.sparkContext.setLogLevel("ERROR")
    shared_dir(spark)           # a temporary folder, set before anything is timed; a cluster names its own
    QUERIES["regression_metrics"](spark, folder).write.format("noop").mode("overwrite").save()     # start-up is not part of any query
    times = {}
    for key in HEADLINE:
        start = time.perf_counter()
        QUERIES[key](spark, folder).write.format("noop").mode("overwrite").save()
        times[key] = round(time.perf_counter() - start, 3)
    found = re.search(r"sf([0-9.]+)", folder)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": float(found.group(1)) if found else None}))
    spark.stop()


if __name__ == "__main__":
    main()
