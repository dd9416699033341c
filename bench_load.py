"""Time a load of order lines as versioned elements, one view over them, and several views in one pass.

Reads ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1) and prints one JSON line.
"""

from __future__ import annotations

import json
import os
import time

from tallygrid.operators.elements import deduplicated
from tallygrid.operators.store import latest
from tallygrid.plans.spec import ViewSpec
from tallygrid.plans.view import all_views, view_cells
from tallygrid.session import local_session, new_work_dir
from workload.inputs import LINES, MONEY, lines

VIEWS = (
    ViewSpec("flags by status", rows=("l_returnflag",), cols=("l_linestatus",), totals=("l_returnflag",)),
    ViewSpec("bands", rows=("BAND",), cols=("METRIC",), totals=("BAND",)),
    ViewSpec("returned", rows=("BAND",), filters={"l_returnflag": ("R",)}),
    ViewSpec("open quantities", rows=("l_returnflag",), filters={"METRIC": ("QTY",), "l_linestatus": ("O",)}),
    ViewSpec("renamed", rows=("l_returnflag",), renames={"l_returnflag": {"A": "KEPT", "N": "KEPT"}}),
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "load")
    spark.sparkContext.setLogLevel("ERROR")
    loaded = new_work_dir(spark, "loaded")
    times: dict[str, float] = {}

    def timed(name: str, action) -> None:
        started = time.perf_counter()
        action()
        times[name] = round(time.perf_counter() - started, 3)

    def discard(df) -> None:
        df.write.format("noop").mode("overwrite").save()

    timed("load", lambda: latest(deduplicated(lines(spark, sf_dir), LINES), LINES).write.parquet(loaded))
    newest = spark.read.parquet(loaded)
    timed("one view", lambda: discard(view_cells(newest, LINES, VIEWS[0], MONEY)))
    timed("all views", lambda: discard(all_views(newest, LINES, VIEWS, MONEY)))
    print(json.dumps({
        "metric": "load of order lines and views over them", "value": round(sum(times.values()), 3), "unit": "sec",
        "steps": times, "elements": newest.count(), "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
