"""Benchmark of the headline queries.

Runs each query on ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1) with
``local[$BENCH_CPUS]``, forcing the full result with the ``noop`` sink (every
row and column is computed, nothing is collected). One warm-up pass over all
queries, then per query one more warm-up and the median of ``$BENCH_REPEAT``
(default 3) consecutive timed runs. Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tessera.plans.registry import load_all  # noqa: E402
from tessera.session import local_session  # noqa: E402

HEADLINE = [
    "train_records",          # T5: render + code points + end-of-text + mask
    "train_batches",          # T5 + W3/W5 exact split + B1/B2 padded batches
    "exact_split",            # W3/W6 on all documents
    "batch_footprint",        # B4
    "nli_prompts_few_shot",   # W1/W2/R8 on line pairs of all documents
    "nli_accuracy",           # G1 + X2 + M1
    "vqa_perplexity",         # T5 + G3 + G2 + M2
    "chat_prompts",           # C1 whole history
    "template_by_lang",       # R3 over whole documents
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeat = int(os.environ.get("BENCH_REPEAT", "3"))
    only = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q]
    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8,
                          app="tessera-bench")
    reg = load_all()
    names = only or HEADLINE

    def once(name: str) -> float:
        t0 = time.perf_counter()
        reg[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - t0

    # warm the whole set first (JIT, Python workers, file metadata), then time
    # each query in consecutive runs (steady state, compiled code cached)
    for name in names:
        once(name)
    times = {}
    for name in names:
        once(name)
        times[name] = round(statistics.median(once(name) for _ in range(repeat)), 3)
    for name in names:
        print(f"{name}: {times[name]}s", file=sys.stderr)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
