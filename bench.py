"""Runs the headline queries and prints one JSON line."""

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

NAMES = ["site_weighted_auc", "match_sources", "filled_cells", "fill_table", "fill_gap_ci", "bootstrap_auc_ci", "site_weighted_auc_ci", "delong_ci", "winners_curse", "hash_split_sizes", "contamination", "duplicate_groups", "seed_sweep_lr", "knn_predict", "modal_pipeline", "calibration_intercept", "paired_auc_diff", "label_permutation", "screening_order", "survey_summary", "lr_oof_loso", "loso_vs_kfold", "filled_removed", "svm_rff", "headline_accuracy", "knn_oof_loso", "contamination_by_seed", "match_all_tolerant"]


def main() -> None:
    from pyspark.sql import SparkSession

    from attestry.plans.catalog import QUERIES

    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    conf = {"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.sql.session.timeZone": "UTC", "spark.driver.memory": "12g", "spark.ui.showConsoleProgress": "false", "spark.checkpoint.dir": tempfile.mkdtemp(prefix="bench-")}
    spark = SparkSession.builder.master(f"local[{cpus}]").config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf}/region.parquet").count()
    took = {}
    for name in NAMES:
        began = time.time()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
