"""Benchmark: run the headline queries and print one JSON line.

Environment: ``BENCH_SF_DIR`` (default /root/testdata/sf0.1), ``BENCH_CPUS``
(default 8), ``BENCH_QUERIES`` (comma list; ``all`` for every registered query).
Each query is executed completely with the ``noop`` sink (no collect to the
driver). The stages that queries share (raw, cleaned, split, scaled train) are
built first and reported as lines of their own (``stage_*``), so no query's time
depends on the order; the value reported is the sum of all lines.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from txnlens.queries import _smote_input, cleaned, raw, registry, split_stage  # noqa: E402
from txnlens.session import local_session  # noqa: E402

HEADLINE = [
    "duplicate_report",
    "describe_columns",
    "clean_transactions",
    "engineered_features",
    "stratified_split",
    "rate_by_hour",
    "rate_by_band",
    "scorecard",
    "positive_gaps",
    "gap_quantiles",
    "cumulative_arrival",
    "feature_ks",
    "density_by_label",
    "box_stats",
    "threshold_sweep",
    "top_flagged",
    "stream_hourly_rate",
    "stream_velocity",
    "smote_balanced",
]

STAGES = {"raw": raw, "cleaned": cleaned, "split": split_stage, "train_scaled": _smote_input}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    wanted = os.environ.get("BENCH_QUERIES", "")
    reg = registry()
    names = list(reg) if wanted == "all" else ([q for q in wanted.split(",") if q] or HEADLINE)
    spark = local_session(cpus, shuffle_partitions=int(cpus) * 2 if cpus.isdigit() else 16)
    # warm-up: JVM and codegen, on a scan that no query uses
    t0 = time.time()
    spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("event_type").count().write.format("noop").mode("overwrite").save()
    warmup = round(time.time() - t0, 3)
    times: dict[str, float] = {}
    for name, build in STAGES.items():
        t0 = time.time()
        build(spark, sf_dir)
        times[f"stage_{name}"] = round(time.time() - t0, 3)
    for name in names:
        t0 = time.time()
        reg[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
    sf = sf_dir.rsplit("sf", 1)[-1]
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf,
                "cpus": cpus,
                "warmup_sec": warmup,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
