"""Headline queries timed at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Every query runs twice into the no-op sink, over whole tables; the second run,
with compiled code and started workers, counts.  Names on the command line replace the headline list; ``--explain``
also prints the plans.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINES = [
    "d1_period_kpis", "d2_daily_trend", "d3_model_usage", "d7_best_confidence_merge", "d9_row_dedup", "d10_duplicate_flag",
    "d12_grouped_totals", "d15_pivot_export", "c1_lookup_default", "c4_reference_replacement", "c6_dictionary_match",
    "c6_fuzzy_match", "c7_field_normalisation", "c9_access_check", "c12_unclaimed_words", "c13_text_gaps", "c21_latest_job_sync",
    "e2_deep_flatten", "e6_group_code_expansion", "e13_pii_masking", "e15_canonical_record", "e20_page_packing",
    "f7_occurrence_index", "h5_row_distinct", "i1_parse_number", "i8_rule_chain", "i12_entity_words", "j4_live_trend",
]


def main(argv: list[str]) -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("paperfold-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "16g"))
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from paperfold.catalog import REGISTRY, runner
    from paperfold.sources.shared import scratch

    explain = "--explain" in argv
    names = [a for a in argv if not a.startswith("--")]
    names = [n for n in REGISTRY if any(n.startswith(a) for a in names)] if names else HEADLINES
    spark.read.parquet(f"{folder}/lineitem.parquet").groupBy("l_returnflag").count().collect()  # JVM warm-up
    seconds: dict[str, float] = {}
    for name in names:
        for turn in range(2):
            start = time.time()
            with scratch(spark):
                df = runner(name)(spark, folder)
                df.write.format("noop").mode("overwrite").save()
                seconds[name] = round(time.time() - start, 3)
                if explain and turn:
                    df.explain("formatted")
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline queries, total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main(sys.argv[1:])
