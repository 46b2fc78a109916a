"""Headline queries over $BENCH_SF_DIR; prints one JSON line."""

from __future__ import annotations

import json
import os
import re
import time

from pyspark.sql import SparkSession

HEADLINES = ("exact_dedup_canonical", "text_keys", "quality_flags", "pairwise_overlap", "label_conflicts", "near_dup_components", "isolation_report", "reconciliation", "entity_report", "heuristic_subtype", "group_split", "obfuscate_o1", "paired_robustness", "bootstrap_ci")


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "12g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").config("spark.sql.files.maxPartitionBytes", "4m").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    from textmill.plans import catalogue

    queries = catalogue.queries()
    queries["exact_dedup_canonical"](spark, sf).write.format("noop").mode("overwrite").save()  # starts the workers

    def timed(names, of):
        took = {}
        for name in names:
            began = time.time()
            of[name](spark, sf).write.format("noop").mode("overwrite").save()
            took[name] = round(time.time() - began, 3)
        return took

    took = timed(HEADLINES, queries)
    # the training-data operators beside them, where they are installed
    every = __import__("__spark_entry__").queries()
    operators = timed([k for k in every if re.match(r"op\d+_|pipeline$", k)], every)
    print(json.dumps({"metric": "headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "operators": operators, "sf": sf}))


if __name__ == "__main__":
    main()
