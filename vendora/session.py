"""SparkSession helpers.

The cluster names its shared lineage-cut folder in ``spark.checkpoint.dir``; we
only read it. A private folder is created only when the setting is absent,
which happens in local tests.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.ui.enabled": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Target ~256 MB per task: AQE coalesces small shuffle partitions up to
    # this size and splits skewed join partitions down to it; file scans split
    # at the same size. Set spark.sql.shuffle.partitions to about
    # (largest shuffle in bytes / 256 MB) on a cluster and let AQE coalesce.
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256m",
    "spark.sql.files.maxPartitionBytes": "256m",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Plans are built from many small Column expressions; recording a Python
    # call site for each costs several JVM round trips per function call.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def get_session(master: str | None = None, app: str = "vendora",
                shuffle_partitions: int | None = None,
                extra: dict[str, str] | None = None) -> SparkSession:
    """Create (or reuse) a session with the settings the reports assume.

    ``shuffle_partitions`` should follow the data: about one partition per
    128-256 MB of shuffled bytes at cluster scale, about the core count locally.
    AQE coalesces small partitions at runtime either way.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for lineage cuts and materialised tables.

    Read from the session (``spark.checkpoint.dir`` or the context's
    checkpoint dir). Only a local master may do without: it gets a fresh folder
    of its own. On a cluster a missing setting is an error, as executors cannot
    see a folder of the driver's machine.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
        return sc.getCheckpointDir() or conf_dir
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="vendora-ckpt-")
    sc.setCheckpointDir(own)
    return sc.getCheckpointDir() or own


def shared_path(spark: SparkSession, *parts: str) -> str:
    """A path inside the shared checkpoint folder."""
    base = checkpoint_dir(spark)
    return os.path.join(base, *parts) if not base.startswith("file:") else \
        base.rstrip("/") + "/" + "/".join(parts)
