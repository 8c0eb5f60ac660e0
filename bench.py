"""Times the headline queries, warm, at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import time

from pyspark.sql import SparkSession

from tessera.plans.queries import QUERIES

HEADLINE = [
    "phrase_mining_top50", "template_rate_by_role", "trigram_jaccard_doc_benchmark", "content_token_overlap", "turn_edit_ratio", "turn_diff_full_outer",
    "asof_before_after", "structural_topk", "hash_random_k", "pool_minus_cohort", "resume_anti_join", "crosstab_cube", "target_vs_achieved", "dup_keys",
    "bucket_hist", "pct_of_total", "index_medians", "rep_mean_then_median", "paired_delta_direction", "wilcoxon_signed_rank_w", "wilcoxon_holm",
    "bootstrap_tost", "holm_family", "channel_spearman", "markup_counters", "line_shape", "repetition", "dense_topk_dedup", "greedy_cohort",
]


def main() -> None:
    sf, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    conf = {"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "8g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.session.timeZone": "UTC"}
    spark = SparkSession.builder.master(f"local[{cpus}]").config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf}/lineitem.parquet").groupBy("l_returnflag").count().collect()
    took = {}
    for name in HEADLINE:
        began = time.time()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "reference workload, total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf}))


if __name__ == "__main__":
    main()
