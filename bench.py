"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query is built and written to the no-op sink twice; the second time counts (the first one pays for JVM warm-up and
code generation). The value is the sum over the queries.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = ["profile_columns", "profile_describe", "quality_summary", "corr_pearson", "dedup_first", "dup_rows", "dup_near", "dup_fuzzy_groups", "fill_median",
            "fill_forward", "interpolate_linear", "ts_rolling_mean", "outlier_cap", "outlier_iforest", "text_chain", "text_word_freq", "dt_parts", "ts_resample",
            "encode_label", "encode_target", "scale_standard", "scale_rank", "feat_pairwise", "group_agg", "join_conflicts", "join_range", "join_spatial", "join_fuzzy", "auto_prepare"]


def main() -> None:
    from cleanlake.queries import all_queries
    from cleanlake.session import get_spark

    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    keys = os.environ.get("BENCH_KEYS", "").split() or HEADLINE
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    spark = get_spark("bench", os.environ.get("BENCH_CPUS", "8"), os.environ.get("BENCH_MEMORY", "16g"))
    queries, out = all_queries(), {}
    for k in keys:
        for _ in range(runs):
            t = time.time()
            queries[k](spark, sf).write.format("noop").mode("overwrite").save()
            out[k] = round(time.time() - t, 3)
        print(k, out[k], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline queries, second run, total", "value": round(sum(out.values()), 3), "unit": "sec", "queries": out, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
