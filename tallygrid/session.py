"""Session helpers: a tuned session for local runs, and the shared work folder."""

from __future__ import annotations

import atexit
import os
import shutil
import sys
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_SETTING = "spark.checkpoint.dir"
#: What a Python worker gets at a time, in bytes.
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"

SESSION_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.aggregatePushdown": "true",
    # Skips noting the Python line of every column expression, which costs several calls each.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def local_session(cpus: int | str = "*", app: str = "tallygrid", **extra: str) -> SparkSession:
    """A session for tests and benchmarks on one machine.

    On a cluster, create the session the usual way; nothing in the library depends on this function.
    """
    shuffle = str(os.cpu_count() or 8) if cpus == "*" else str(cpus)
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", shuffle)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
    )
    builder = builder.config("spark.ui.showConsoleProgress", "false")
    for name, setting in {**SESSION_DEFAULTS, **extra}.items():
        builder = builder.config(name, setting)
    return builder.getOrCreate()


@contextmanager
def configured(spark: SparkSession, wanted: dict[str, str]) -> Iterator[None]:
    """Settings for the queries that start meanwhile; the session keeps its own."""
    before = {name: spark.conf.get(name, None) for name in wanted}
    for name, setting in wanted.items():
        spark.conf.set(name, setting)
    try:
        yield
    finally:
        for name, setting in before.items():
            if setting is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, setting)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, named by ``spark.checkpoint.dir``.

    A temporary folder, removed when Python ends, stands in only when the setting is absent *and* all tasks run in the
    driver's own process. On a cluster, also one of several processes on one machine, the setting is required, because a
    machine-local folder is invisible to others.
    """
    configured = spark.conf.get(CHECKPOINT_SETTING, None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    if context.master != "local" and not context.master.startswith("local["):
        raise RuntimeError(f"set {CHECKPOINT_SETTING} to a folder shared by all executors")
    fallback = getattr(context, "_tallygrid_dir", None)
    if fallback is None:
        fallback = tempfile.mkdtemp(prefix="tallygrid-")
        atexit.register(shutil.rmtree, fallback, ignore_errors=True)
        context._tallygrid_dir = fallback
    return fallback


def new_work_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh path under :func:`shared_dir`; every caller gets one of its own."""
    return f"{shared_dir(spark)}/{purpose}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame, eager: bool = True) -> DataFrame:
    """Cut the lineage of ``df`` with a reliable checkpoint that survives the loss of executors."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(f"{shared_dir(spark)}/checkpoints")
    return df.checkpoint(eager=eager)


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the Python workers, once per Spark context, so that their functions can import it."""
    context = spark.sparkContext
    if getattr(context, "_tallygrid_shipped", None) is None:
        root = os.path.dirname(os.path.abspath(__file__))
        folder = tempfile.mkdtemp(prefix="tallygrid-ship-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        archive = os.path.join(folder, "tallygrid_package.zip")
        with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
            for place, _, names in os.walk(root):
                for name in sorted(n for n in names if n.endswith(".py")):
                    path = os.path.join(place, name)
                    out.write(path, os.path.relpath(path, os.path.dirname(root)))
        context.addPyFile(archive)
        context._tallygrid_shipped = archive
    return spark


def by_value(module: str) -> None:
    """Have the functions and classes of a module travel whole.

    Spark plans stateful operators and Python sources of streams in processes that do not get the files sent by :func:`ship`.
    """
    cloudpickle.register_pickle_by_value(sys.modules[module])
