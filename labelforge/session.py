"""Session set-up and shared storage locations.

Work files (round trips, written tables that cut lineage, stream checkpoints) go
under the shared folder the cluster names in ``spark.checkpoint.dir``. A folder
of our own is picked only for a local master, where driver and executors are
one process; a cluster session without the setting is an error.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings every job relies on: adaptive execution (runtime re-plan, skew-join
# splitting, partition coalescing) and a fixed session time zone so timestamps
# compare equal with the SQL oracle.
SESSION_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Python gets batches of bounded bytes, whatever the length of the texts
    "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20),
    # the driver keeps the text of the plans that have run; tables inside expressions make it long
    "spark.sql.maxPlanStringLength": "20000",
}


def build_session(master: str = "local[*]", shuffle_partitions: int = 8,
                  app_name: str = "labelforge", **extra: str) -> SparkSession:
    builder = SparkSession.builder.master(master).appName(app_name)
    conf = dict(SESSION_DEFAULTS)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf["spark.ui.enabled"] = "false"
    # checkpoints cut lineage for row positions; drop their files once the
    # checkpointed data is no longer referenced
    conf["spark.cleaner.referenceTracking.cleanCheckpoints"] = "true"
    conf.update(extra)
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    shared_dir(spark)
    return spark


def apply_defaults(spark: SparkSession) -> None:
    """Session-level settings that may be changed at run time."""
    for k, v in SESSION_DEFAULTS.items():
        try:
            spark.conf.set(k, v)
        except Exception:  # some settings are static on a running session
            pass


class SharedFolderError(RuntimeError):
    """The session names no folder that driver and executors share."""


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Unset: a fresh temporary folder
    for a local master, an error for a cluster or a remote session."""
    missing = SharedFolderError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    try:
        sc = spark.sparkContext
    except Exception:  # a remote (Connect) session: the server owns the folder
        configured = spark.conf.get("spark.checkpoint.dir", None)
        if not configured:
            raise missing from None
        return configured.rstrip("/")
    current = sc.getCheckpointDir()
    if current:
        return current.rstrip("/")
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise missing
        configured = tempfile.mkdtemp(prefix="labelforge-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir().rstrip("/")


def command_session(app_name: str, work_dir: str | None = None) -> SparkSession:
    """The session of a command line. The shared folder is ``work_dir``, else
    the session's ``spark.checkpoint.dir``; a cluster without either is an
    error before any work is done."""
    spark = SparkSession.builder.appName(app_name).getOrCreate()
    apply_defaults(spark)
    if work_dir:
        spark.sparkContext.setCheckpointDir(work_dir)
    shared_dir(spark)
    return spark


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path for a written table under the shared folder."""
    return f"{shared_dir(spark)}/labelforge-work/{name}-{uuid.uuid4().hex[:12]}"
