"""Seconds of the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS], as one JSON line."""

import json
import os
import sys
import tempfile
import time

HEADLINE = (
    "q03_build_queue m13_send_volume m14_funnel m16_reply_by_score_band m18_places_rollup m22_history_page m26_entity_profile d08_cross_metro_chains d13_places_in_boxes d03_frontier_batch "
    "a12_upsert_replace a13_upsert_accumulate k01_mine_corpus k06_record_keyword_use c01_page_text c04_page_links c09_content_flags c19_guess_niche f01_hard_filter f02_rule_score f05_final_score "
    "b07_identity_keys b10_key_groups q08_apply_decisions w04_spend_batch"
).split()


def main() -> None:
    sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
    from pyspark.sql import SparkSession

    from tessera.plans import registry

    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.local.dir", tempfile.mkdtemp(prefix="spark-", dir="/tmp")).config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries, seconds = registry.queries(), {}
    for name in HEADLINE:
        best = None
        # the first run also compiles; the better of two counts
        for _ in range(2):
            began = time.time()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took = time.time() - began
            best = took if best is None else min(best, took)
        seconds[name] = round(best, 3)
    print(json.dumps({"metric": "headline queries, seconds in total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": sf_dir.rpartition("sf")[2]}))
    spark.stop()


if __name__ == "__main__":
    main()
