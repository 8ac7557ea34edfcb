"""Spark session and shared-storage helpers.

Everything that must survive an executor loss (persisted indexes, lineage
cuts) goes under the cluster's shared checkpoint folder, read from the
session's ``spark.checkpoint.dir``. A private folder is created only when the
setting is absent (local tests).
"""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def get_spark(master: str | None = None, app: str = "rankspark",
              shuffle_partitions: int | None = None) -> SparkSession:
    """Session for the retrieval workload (AQE on, skew join on).

    Master, partition number and memory stay those of the cluster's own
    settings unless the caller names them.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    if memory := os.environ.get("RANKSPARK_DRIVER_MEMORY"):
        builder = builder.config("spark.driver.memory", memory)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the session.

    Only a local master may go without the setting (tests): then a private
    folder is made. On a cluster that would be a folder per machine, so it raises.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="rankspark-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path under the shared checkpoint folder."""
    base = checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}-{uuid.uuid4().hex[:12]}"


@contextmanager
def shuffles_dropped(spark: SparkSession):
    """Within it, a write's shuffle files go as soon as it is done, not when the driver's garbage is collected."""
    before = spark.conf.get(_CLEANUP, None)
    try:
        spark.conf.set(_CLEANUP, "true")
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared checkpoint folder and read back: computed once, cuts the lineage, survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Most bytes of rows that go to a Python worker at once (a longer row goes alone).
BATCH_BYTES = 8 << 20
_BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


_shipped: set[str] = set()


def prepare(spark: SparkSession) -> None:
    """Before Python runs on the executors: small batches, and this package sent along.

    The batch bound holds what a task keeps for Python, in the JVM and in the
    worker; a smaller setting of the session stays. The package goes out once
    per application, as executors need not have it (nor the driver's path).
    """
    now = spark.conf.get(_BATCH_CONF).rstrip("bB")
    if not now.isdigit() or not 0 < int(now) <= BATCH_BYTES:
        spark.conf.set(_BATCH_CONF, str(BATCH_BYTES))
    sc, home = spark.sparkContext, Path(__file__).resolve().parent
    if sc.applicationId not in _shipped and home.is_dir():
        target = Path(tempfile.mkdtemp(prefix="rankspark-")) / f"{home.name}.zip"
        with zipfile.ZipFile(target, "w") as z:
            for f in sorted(home.rglob("*.py")):
                z.write(f, f.relative_to(home.parent))
        sc.addPyFile(str(target))
        _shipped.add(sc.applicationId)


def map_arrow(df: DataFrame, run, schema) -> DataFrame:
    """``mapInArrow`` in small batches."""
    prepare(df.sparkSession)
    return df.mapInArrow(run, schema)
