"""Benchmark the library queries.

Runs each query at ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1) on
``local[$BENCH_CPUS]``, executing the full plan into Spark's ``noop`` sink
(no collect): one warm-up pass over all queries, then the median of
``$BENCH_REPS`` runs per query; prints ONE JSON line.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    reps = int(os.environ.get("BENCH_REPS", "3"))

    from ranqa.plans import all_queries
    from ranqa.session import get_session

    spark = get_session(master=f"local[{cpus}]", shuffle_partitions=int(cpus))
    reg = all_queries()
    names = sys.argv[1:] or list(reg)

    def run(name: str) -> float:
        t0 = time.perf_counter()
        reg[name].build(spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - t0

    # one warm-up pass over every query first (JIT, Python workers, file
    # listing), so the first query measured does not carry the JVM warm-up
    for name in names:
        run(name)
    times: dict[str, float] = {}
    for name in names:
        times[name] = round(statistics.median(run(name) for _ in range(reps)), 3)
        print(f"{name}: {times[name]}s", file=sys.stderr, flush=True)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "sum_median_query_seconds", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": sf, "cpus": int(cpus),
                      "spark": spark.version}))


if __name__ == "__main__":
    main()
