"""Times the headline queries; prints one JSON line.

Every query is run in full into a ``noop`` sink; the time is the best of
``BENCH_RUNS`` runs after one warm-up.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from colloquy.plans.catalog import QUERIES
from colloquy.session import build_session

HEADLINE = [
    "verdict", "strip_think", "boxed_last", "grade_answers", "gen_accuracy", "normalize_messages",
    "fit_token_budget_rows", "truncate_tail_rows", "message_hash_rows", "distinct_messages", "sft_append_parquet",
    "sft_new_only", "sample_random", "sample_sequential", "round_batches", "request_batches",
    "replay_pag", "replay_dagger", "sft_build_pag", "sft_funnel_rows", "transcripts", "rollout_pag",
    "dagger_round", "stream_sft_ingest",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    names = os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",")
    conf = {
        "spark.sql.shuffle.partitions": cpus,
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
    }
    spark = build_session("bench", f"local[{cpus}]", **conf)
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    seconds = {}
    for name in names:
        run(name)
        seconds[name] = round(min(run(name) for _ in range(runs)), 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
                "cpus": int(cpus),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
