"""Time the headline queries: one JSON line on standard output.

``BENCH_SF_DIR`` (default /root/testdata/sf0.1) and ``BENCH_CPUS`` (default 8) choose data and cores.
"""

from __future__ import annotations

import json
import os
import sys
import time

HEADLINE = [
    "mt1", "ag2", "ag3", "mt5", "mt8", "ag14", "jn4", "jn6", "jn7", "gr1", "sp2", "vw7", "ag18", "dq2", "src1", "st6",
]


def main() -> None:
    from boxloom import plans
    from boxloom.session import local_session

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "boxloom-bench")
    queries = plans.queries()
    spark.read.parquet(f"{folder}/lineitem.parquet").groupBy("l_returnflag").count().collect()  # start the JVM pools
    times = {}
    for key in HEADLINE:
        start = time.time()
        # every column of every row is computed; nothing reaches the driver
        queries[key](spark, folder).write.format("noop").mode("overwrite").save()
        times[key] = round(time.time() - start, 3)
        print(f"{key} {times[key]}", file=sys.stderr, flush=True)
    spark.stop()
    sf = os.path.basename(folder.rstrip("/")).replace("sf", "")
    line = {"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": float(sf)}
    print(json.dumps(line))


if __name__ == "__main__":
    main()
