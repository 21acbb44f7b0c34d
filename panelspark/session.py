"""Session helpers: configuration for local runs and reliable checkpoints."""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(app: str = "panelspark", cores: str | int = "*", shuffle: int = 8) -> SparkSession:
    """A local session for tests and the bench; on a cluster the session comes from the job."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("PANELSPARK_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the cluster names in ``spark.checkpoint.dir``.

    Only a local session without one gets a scratch folder; a cluster job without a shared folder is
    refused, because a machine-local checkpoint is lost with its executor.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
    elif sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="panelspark-ckpt-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the checkpoint folder and cut its lineage.

    Used where a plan reads the same rows several times and joins them back on computed doubles: a
    recomputed sum may differ in its last bit, a checkpointed one cannot.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def materialize_columns(df: DataFrame) -> DataFrame:
    """The same as Parquet, which takes less disk and gives a reader only the columns it needs.

    Files are read in another order than they were written, so this is for steps that don't number rows with equal keys. Columns of a type
    that Parquet lacks take a checkpoint.
    """
    spark = df.sparkSession
    path = scratch_dir(spark, "rows")
    if "void" in df.schema.simpleString() or not df.columns:
        return materialize(df)
    with _shuffles_end_with_the_write(spark):
        df.write.parquet(path, compression="zstd")
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def _shuffles_end_with_the_write(spark: SparkSession):
    """What is shuffled for a stored table isn't read again, so Spark removes it after the write and not whenever the driver collects its garbage."""
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder beside the checkpoints: shared on a cluster, scratch space in a local session."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
