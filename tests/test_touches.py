import json

import pandas as pd

from conftest import tuples
from tallygrid.plans.spec import ViewSpec
from tallygrid.streaming import upsert
from test_live import Run

VIEW = ViewSpec("cells", rows=("METRIC",), cols=("CCY",), totals=("METRIC",))


def test_superseded_versions_travel_once_per_labels():
    labels = ["USD", "CAD"]
    rows = [("0:=hot", 0, i, json.dumps({"CCY": labels[i % 2], "value": i}), json.dumps({"CCY": labels[i % 2], "value": 0}), 3) for i in range(1000)]
    given = pd.DataFrame(rows, columns=["key", "epoch", "q0", "body", "touch", "bucket"])
    packs = pd.concat(upsert._newest_per_batch(["epoch", "q0"], False, ("0:",))(iter([given])))
    versions = [(b < 0, v) for b, held in zip(packs["bucket"], packs["versions"]) for v in upsert.pickle.loads(held)]
    assert sorted(v[-1] for spread, v in versions if spread) == sorted(json.dumps({"CCY": c, "value": 0}) for c in labels)
    assert [v[2] for spread, v in versions if not spread] == [999]


def test_versions_that_come_and_go_touch_their_cells(spark):
    run = Run(spark, (VIEW,))
    infinite = float("inf")
    run.give([("k", 1, "USD", 0, None, [("m", infinite)]), ("k", 2, "CAD", 0, None, [("n", None)]), ("k", 3, "EUR", 0, None, [("m", 4.0), ("m", 0.5)])])
    shown = [("cells", ["EUR"], ["Total"], True, 4.5), ("cells", ["EUR"], ["m"], False, 4.5), ("cells", ["USD"], ["m"], False, 0.0)]
    names = "view", "col_keys", "row_keys", "is_total", "value"
    assert tuples(run.feed.attach()[0].select(*names).filter("NOT is_total OR value <> 0")) == sorted(shown, key=str)
    run.give([("k", 4, "USD", 0, None, [("m", infinite)]), ("k", 5, "EUR", 0, None, [("m", 1.0)])])
    told = tuples(run.feed.records(0).filter("NOT is_total"), "col_keys", "row_keys", "value")
    assert told == [(["EUR"], ["m"], 1.0), (["USD"], ["m"], 0.0)]
