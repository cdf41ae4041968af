"""Headline queries timed on one data set; prints one JSON line.

Every query is run once to warm the JVM and then timed (median of ``BENCH_RUNS``), written to
a sink that discards rows, so that all rows and columns are computed. Shared intermediates are
dropped between runs: each timing covers the work from the given tables on.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "1"))

HEADLINE = [
    "d18_decisions", "j01_list_invoices", "j03_review_queue", "j06_stale_parses", "st1_first_events", "st2_admit_work",
    "a12_line_item_prf", "s06_upsert_latest", "a05_profile_pages", "j08_match_ap_context", "n01_normalize_invoices", "v5_blocking_failures",
    "r12_compare_fields", "w06_build_lines",
]


def main() -> None:
    from billgrid.plans import catalog
    from billgrid.session import build_session

    spark = build_session(
        "billgrid-bench", f"local[{CPUS}]",
        **{"spark.sql.shuffle.partitions": str(2 * int(CPUS)), "spark.ui.enabled": "false", "spark.driver.memory": "20g",
           "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    # the small set warms the JVM; timings come from the large one only
    small = str(Path(SF_DIR).parent / "sf0.001")
    seconds: dict[str, float] = {}
    for name in names:
        runs = []
        for sf in ([small] if Path(small).exists() else []) + [SF_DIR] * RUNS:
            catalog._KEPT.clear()
            start = time.perf_counter()
            catalog.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
            if sf == SF_DIR:
                runs.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(runs), 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": Path(SF_DIR).name.removeprefix("sf")}))


if __name__ == "__main__":
    main()
