from types import SimpleNamespace

from tallygrid.streaming import upsert


def test_workers_get_packs_in_small_batches(spark):
    """Packs are rows of several KB, so a limit of rows alone bounds nothing; the session's own setting stays."""
    started = []

    class Writer:
        def start(self, path):
            started.append(int(spark.conf.get(upsert.BATCH_BYTES).removesuffix("b")))

        def __getattr__(self, name):
            return lambda *args, **options: self

    before = spark.conf.get(upsert.BATCH_BYTES, None)
    upsert.run_changelog(SimpleNamespace(sparkSession=spark, writeStream=Writer()), "log", "checkpoint")
    assert started == [4 << 20] and spark.conf.get(upsert.BATCH_BYTES, None) == before
