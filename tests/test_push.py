from pyspark.sql import functions as F

from conftest import tuples
from tallygrid.session import new_work_dir, ship
from tallygrid.sources.push import Producer, pushed

SCHEMA = "invariant_key string, seq long, CCY string, points array<struct<METRIC: string, value: double>>"


def follow(spark, folder, work):
    query = pushed(ship(spark), folder, SCHEMA, segmentsPerPartition=2).writeStream.format("parquet").option("checkpointLocation", f"{work}/checkpoint")
    query = query.trigger(availableNow=True).start(f"{work}/rows")
    query.awaitTermination()
    return spark.read.schema(SCHEMA).parquet(f"{work}/rows")


def test_a_restart_loses_and_repeats_nothing(spark):
    work = new_work_dir(spark, "push")
    folder = f"{work}/spool"
    one = Producer(folder, SCHEMA, stamp="seq")
    assert one.push([{"invariant_key": "a", "CCY": "USD", "points": [{"METRIC": "m", "value": 1.0}]}]) == 0
    for i in range(5):
        one.push([{"invariant_key": f"b{i}", "CCY": None, "points": []}])
    found = follow(spark, folder, work)
    assert found.count() == 6
    other = Producer(folder, SCHEMA, lane="task-7")
    other.push([{"invariant_key": "c", "seq": 5, "CCY": "CAD", "points": None}])
    one.push([])
    one.push([{"invariant_key": "a", "CCY": "USD", "points": []}, {"invariant_key": "a", "CCY": "CAD", "points": []}])
    follow(spark, folder, work)
    found = follow(spark, folder, work)
    assert sorted(r.invariant_key for r in found.collect()) == ["a", "a", "a", "b0", "b1", "b2", "b3", "b4", "c"]
    assert found.filter("invariant_key = 'a'").orderBy(F.desc("seq")).first().CCY == "CAD"
    again = Producer(folder, SCHEMA, lane="task-7", first=0)
    again.push([{"invariant_key": "c", "seq": 5, "CCY": "CAD", "points": None}])
    assert follow(spark, folder, work).count() == 9
    assert tuples(found.filter("invariant_key = 'c'"), "seq", "CCY") == [(5, "CAD")]


def test_an_unfinished_segment_is_not_seen(spark):
    work = new_work_dir(spark, "push")
    producer = Producer(f"{work}/spool", SCHEMA, lane="l")
    producer.push([{"invariant_key": "a", "seq": 1, "CCY": "USD", "points": []}])
    with open(f"{work}/spool/l/.half", "wb") as out:
        out.write(b"half a segment")
    producer.push([{"invariant_key": "b", "seq": 1, "CCY": "USD", "points": []}])
    assert follow(spark, f"{work}/spool", work).count() == 2
