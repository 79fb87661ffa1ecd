"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from catalog.queries import QUERIES  # noqa: E402
from scenara.session import build_session  # noqa: E402

HEADLINE = [
    "traded_total_by_scenario",
    "net_alongside_detail",
    "diff_many_scenarios",
    "production_difference",
    "co2e_by_sector",
    "net_add_ret",
    "cumulative_grouped",
    "ensemble_gas",
    "mart_s13",
    "diff_families_with_net",
]
REPEATS = 3


def run(spark, name: str, sf_dir: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus,
        spark__driver__memory="12g",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    cold = {name: run(spark, name, sf_dir) for name in HEADLINE}
    warm = {name: statistics.median(run(spark, name, sf_dir) for _ in range(REPEATS)) for name in HEADLINE}
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(warm.values()), 3),
                "unit": "sec",
                "queries": {n: round(s, 3) for n, s in warm.items()},
                "cold": {n: round(s, 3) for n, s in cold.items()},
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
