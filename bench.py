"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the table folder (default /root/testdata/sf0.1), BENCH_CPUS the threads.
"""

from __future__ import annotations

import json
import os
import time

from trafficward.catalog.all import REGISTRY
from trafficward.session import build_session

HEADLINE = [
    "B05_summary",
    "C10_entropy",
    "C21_fraud_scores",
    "D01_daily_requests",
    "D07_gaps_and_velocity",
    "E01_channel_features",
    "E02_quality_metrics",
    "E12_behaviour",
    "I15_closed_form_quality",
    "K02_daily_anomalies",
    "K03_bursts",
    "K05_ip_geography",
    "K08_volume_anomalies",
    "K13_canonical_flags",
    "L01_classified_rows",
    "L08_classification_summary",
    "M08_drift",
    "N02_kpis",
    "F10_nearest_neighbours",
    "K20_isolation_forest",
    # fits, and the whole job: features, fitted scores, five families, every row classified
    "J02_kmeans",
    "K22_one_class_svm",
    "Q01_full_job",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 4))
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "8g"),
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    events = spark.read.parquet(f"{folder}/events.parquet").count()
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        # every output column is computed; the sink discards the rows
        REGISTRY[name].run(spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    total = sum(times.values())
    print(
        json.dumps(
            {
                "metric": "headline queries, total seconds",
                "value": round(total, 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
                "events": events,
                "rows_per_sec_classification": round(events / times["L01_classified_rows"], 1),
                "rows_per_sec_all_headline": round(events / total, 1),
                "rows_per_sec_full_job": round(events / times["Q01_full_job"], 1),
            }
        )
    )


if __name__ == "__main__":
    main()
