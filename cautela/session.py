"""Session helpers: sensible defaults, never overriding what a cluster has set."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession


def local_session(app: str = "cautela", cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and the local bench; clusters bring their own."""
    builder = (
        SparkSession.builder.appName(app)
        .master(f"local[{cores}]")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("CAUTELA_DRIVER_MEMORY", "12g"))
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config(
            "spark.sql.streaming.stateStore.providerClass",
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        )
    )
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder the cluster names in spark.checkpoint.dir.

    Where none is set, a local session gets a scratch folder that goes with the process. Elsewhere that would be a folder
    other machines cannot see, so it is an error.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    existing = spark.sparkContext.getCheckpointDir()
    if existing:
        return existing
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise RuntimeError("Set spark.checkpoint.dir to a folder that all machines of the cluster share.")
    scratch = tempfile.mkdtemp(prefix="cautela-checkpoint-")
    atexit.register(shutil.rmtree, scratch, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(scratch)
    return scratch


def handed_over(df):
    """The rows as a table in the shared folder: computed once, where a checkpoint computes them twice."""
    path = f"{checkpoint_root(df.sparkSession).rstrip('/')}/cautela-table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut_lineage(df):
    """Reliable checkpoint in the shared folder: survives the loss of any executor."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(checkpoint_root(spark))
    return df.checkpoint(eager=True)
