"""Write PLANS.md: per registered query, the shape of its executed plan.

For each query: Spark jobs run (building and executing it once; with AQE every query stage is a
job of its own), and in the final adaptive plan the parquet scans, shuffle exchanges (reused
ones counted apart), broadcasts, window operators, sorts and Python evaluation nodes.

Usage: python tools/plan_report.py [--sf-dir DIR] [--out PLANS.md]
"""

from __future__ import annotations

import argparse
import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

PYTHON_NODES = ("BatchEvalPython", "ArrowEvalPython", "MapInPandas", "FlatMapGroupsInPandas", "PythonRDD")


def _seq(x) -> list:
    return [x.apply(i) for i in range(x.size())]


def shape(spark, df) -> dict:
    """Walk the final physical plan (children, query stages, subqueries), visiting each node
    object once, and count operators by kind."""
    jvm = spark.sparkContext._jvm
    seen: set[int] = set()
    names: list[str] = []

    def walk(p) -> None:
        ident = jvm.System.identityHashCode(p)
        if ident in seen:
            return
        seen.add(ident)
        name = p.nodeName()
        names.append(name)
        if name == "AdaptiveSparkPlan":
            walk(p.executedPlan())
            return
        if name.endswith("QueryStage"):
            walk(p.plan())
        if name in ("ReusedExchange", "ReusedSubquery"):
            return
        for c in _seq(p.children()):
            walk(c)
        for sq in _seq(p.subqueries()):
            walk(sq)

    walk(df._jdf.queryExecution().executedPlan())

    def n(pred) -> int:
        return sum(1 for x in names if pred(x))

    return {
        "scans": n(lambda x: x.startswith("Scan") or x.startswith("FileScan")),
        "shuffles": n(lambda x: x == "Exchange"),
        "reused": n(lambda x: x in ("ReusedExchange", "ReusedSubquery")),
        "broadcasts": n(lambda x: x == "BroadcastExchange"),
        "windows": n(lambda x: x in ("Window", "WindowGroupLimit")),
        "sorts": n(lambda x: x == "Sort"),
        "python": n(lambda x: any(x.startswith(p) for p in PYTHON_NODES)),
    }


def main() -> None:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf-dir", default="/root/testdata/sf0.01")
    ap.add_argument("--out", default=os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "PLANS.md"))
    args = ap.parse_args()

    from keelson.plans.catalog import oracle_sql, queries
    from keelson.session import local_session

    spark = local_session(8, 8, app="keelson-plans")
    sc = spark.sparkContext
    tracker = sc.statusTracker()
    qs, sqls = queries(), oracle_sql()
    rows = []
    for name in sorted(qs):
        sc.setJobGroup(name, name)
        df = qs[name](spark, args.sf_dir)
        df.collect()  # executes this DataFrame's own plan, so its final adaptive plan is read below
        jobs = len(tracker.getJobIdsForGroup(name))
        s = shape(spark, df)
        rows.append((name, jobs, s, name in sqls))
        print(name, jobs, s, file=sys.stderr)
    sc.setJobGroup("", "")
    with open(args.out, "w") as f:
        f.write("# PLANS — executed plan shape per registered query\n\n")
        f.write(
            f"Generated by `tools/plan_report.py` at `{args.sf_dir}` on local[8] (Spark {spark.version}, AQE on).\n"
            "`jobs` counts Spark jobs for building the query and collecting its result once; with AQE each query stage runs as\n"
            "its own job, and preparatory steps (a range-sliced table written once, a class-count collect) add\n"
            "theirs. Plan columns describe the final adaptive plan of the returned DataFrame: parquet scans,\n"
            "shuffles (not counting reused ones), reused exchanges or subqueries, broadcasts, windows, sorts, and\n"
            "Python evaluation nodes (none anywhere).\n\n"
        )
        f.write("| query | oracle | jobs | scans | shuffles | reused | broadcasts | windows | sorts | python |\n")
        f.write("| --- | --- | --- | --- | --- | --- | --- | --- | --- | --- |\n")
        for name, jobs, s, has in rows:
            f.write(
                f"| `{name}` | {'SQL' if has else 'rows'} | {jobs} | {s['scans']} | {s['shuffles']} | {s['reused']} | "
                f"{s['broadcasts']} | {s['windows']} | {s['sorts']} | {s['python']} |\n"
            )
    from keelson.session import clear_scratch

    clear_scratch(spark)
    spark.stop()


if __name__ == "__main__":
    main()
