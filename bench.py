"""Benchmark: every registered query at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query is built and executed in full through the ``noop`` sink (nothing is collected to the
driver); the time covers plan building too, since some operators run a small preparatory job
(class counts, the range-sliced table of exact percentiles). One warm-up run, then the median
of $BENCH_RUNS timed runs. Prints one JSON line on stdout.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    only = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q]

    from keelson.plans.catalog import queries
    from keelson.session import local_session

    spark = local_session(cpus, partitions=max(2, cpus), app="keelson-bench")
    qs = queries()
    names = only or sorted(qs)
    times: dict[str, float] = {}
    failed: dict[str, str] = {}
    for name in names:
        fn = qs[name]

        def once() -> float:
            t0 = time.perf_counter()
            fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
            return time.perf_counter() - t0

        try:
            once()
            times[name] = round(statistics.median(once() for _ in range(runs)), 4)
        except Exception as e:  # noqa: BLE001
            failed[name] = f"{type(e).__name__}: {str(e)[:200]}"
        print(f"{name}: {times.get(name, 'FAILED')}", file=sys.stderr)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    out = {
        "metric": "sum_of_median_query_seconds",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(m.group(1)) if m else sf_dir,
        "cpus": cpus,
        "runs": runs,
        "spark": spark.version,
    }
    if failed:
        out["failed"] = failed
    print(json.dumps(out))
    from keelson.session import clear_scratch

    clear_scratch(spark)  # the intermediate tables this run wrote
    spark.stop()


if __name__ == "__main__":
    main()
