"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR names the data (default /root/testdata/sf0.1), BENCH_CPUS the
local cores. Every query writes all its rows to a sink that drops them.
"""

from __future__ import annotations

import json
import os
import time

from tallymark.catalog import QUERIES, Inputs
from tallymark.session import build_session

HEADLINE = [
    "e6_consensus",
    "e1_accuracy_by_concept",
    "e3_confusion_by_concept",
    "h2_exact_confidence",
    "l3_student_rows",
    "b1_remove_comments",
    "b17_tabular_rows",
    "b17_json_rows",
    "c4_choice_status",
    "e6_row_votes",
    "i1_statement_scan",
    "e14_object_counts",
    "f4_evidence_lists",
    "m1_label_submissions",
    "m3_evaluation",
]


def main() -> None:
    data_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.ui.enabled": "false",
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "12g",
        },
    )
    spark.sparkContext.setLogLevel("FATAL")
    inputs = Inputs(spark, data_dir)
    inputs.table("events").count()
    seconds = {}
    for name in HEADLINE:
        began = time.perf_counter()
        QUERIES[name](inputs).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - began, 3)
    print(
        json.dumps(
            {
                "metric": "headline queries, total wall time",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(data_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
