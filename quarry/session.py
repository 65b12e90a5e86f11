"""SparkSession construction and shared-storage settings."""

from __future__ import annotations

import gc
import os

from pyspark.sql import SparkSession

# Settings every job relies on: UTC for timestamp arithmetic, AQE for runtime
# re-planning (partition coalescing, skew-join splitting, broadcast conversion
# from measured sizes).
_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    # Checkpointed frontiers and materialised aggregates are removed from the
    # checkpoint folder once nothing references them.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "quarry") -> SparkSession:
    """Return the active session, or build one for local use.

    On a cluster the submitter already owns the session and its settings; we
    only fill in what is unset so that cluster-provided values win.
    """
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for k, v in _CONF.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    builder = builder.config("spark.driver.memory", os.environ.get("QUARRY_DRIVER_MEM", "16g"))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    A cluster names a shared, fault-tolerant folder there; we never invent a
    machine-local one on a cluster. Only a local-mode session (tests, bench)
    with the setting unset gets a scratch folder under /tmp.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if d:
        spark.sparkContext.setCheckpointDir(d)
        return d
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    import tempfile
    d = tempfile.mkdtemp(prefix="quarry-ckpt-", dir="/tmp")
    spark.conf.set("spark.checkpoint.dir", d)
    spark.sparkContext.setCheckpointDir(d)
    return d


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the checkpoint folder for written intermediate tables."""
    import uuid
    base = checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}-{uuid.uuid4().hex[:12]}"


def materialise(df):
    """Checkpoint ``df`` into the shared checkpoint folder (reliable, not
    local): consumers that read it several times scan the written rows once
    each instead of recomputing its plan, and the lineage is cut."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Lets the shuffle files and checkpoints of frames that nothing holds any more go from disk: Spark
    removes them once the driver has collected its garbage, which a large heap puts off. Python drops its
    hold about a second late, so this is called some jobs after the frame was last used."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a folder of ``scratch_dir`` that is not read any more."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
