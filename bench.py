"""Headline timings: prints one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from histscore.operators import axis as X  # noqa: E402
from histscore.plans import bindings as B  # noqa: E402
from histscore.plans.catalog import spark_queries  # noqa: E402
from histscore.session import local_session  # noqa: E402

HEADLINE = [
    "auc_flagship",
    "history_agg",
    "h_wide",
    "h_transitions",
    "last_n",
    "sequence_pack",
    "masked_pool",
    "rank_pct",
    "auc_by_model",
    "blend_grid",
    "weights_simplex",
    "id_prior",
    "multi_scale_bins",
    "batch_plan",
    "field_mask",
]

# The reference's bin widths and bin count (full W6 shape).
FULL_WIDTHS = (64, 256, 1024, 4096, 16384)
FULL_BINS = 129


def bins_full(spark, sf_dir):
    return X.multi_scale_bins(
        B.target_sparse(spark, sf_dir), B.query_ids(spark, sf_dir), FULL_WIDTHS, FULL_BINS // 2, 5.0
    )


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session(cores=cpus, shuffle_partitions=max(cpus, 8))
    queries = spark_queries()
    # Untimed warm-up: JVM code generation, the Parquet readers and the
    # Python workers of the vectorised passes.
    run(B.history_b(spark, sf_dir).limit(10))
    run(queries["auc_flagship"](spark, sf_dir))
    timings = {}
    todo = [(name, queries[name]) for name in HEADLINE] + [("bins_full", bins_full)]
    for name, fn in todo:
        t0 = time.perf_counter()
        run(fn(spark, sf_dir))
        timings[name] = round(time.perf_counter() - t0, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "sf": float(sf) if sf.replace(".", "").isdigit() else sf,
            }
        )
    )


if __name__ == "__main__":
    main()
