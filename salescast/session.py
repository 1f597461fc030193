"""SparkSession construction and the shared checkpoint location.

On a cluster the session is created by the platform; ``build_session`` is
only used by tests, ``bench.py`` and local runs.  Everything the library
needs at runtime comes from the session it is handed.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings the operators are designed around.  AQE re-plans joins at runtime
# (broadcast only when the measured side is small, sort-merge otherwise),
# coalesces tiny shuffle partitions and splits skewed join partitions.
SCALE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.localShuffleReader.enabled": "true",
    # A side is broadcast only when its measured size is below this bound;
    # anything larger falls back to a shuffled sort-merge join.
    "spark.sql.autoBroadcastJoinThreshold": str(16 * 1024 * 1024),
    "spark.sql.adaptive.autoBroadcastJoinThreshold": str(16 * 1024 * 1024),
    # Shuffle partitions are sized at runtime: AQE coalesces small ones
    # towards the advisory size and splits skewed ones; scans split files at
    # maxPartitionBytes.  `spark.sql.shuffle.partitions` is only the upper
    # bound to start from (set per cluster size).
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(128 * 1024 * 1024),
    "spark.sql.files.maxPartitionBytes": str(128 * 1024 * 1024),
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def build_session(master: str | None = None, app: str = "salescast",
                  shuffle_partitions: int | None = None,
                  extra: dict | None = None) -> SparkSession:
    """Local/test session with the settings above."""
    master = master or os.environ.get("SALESCAST_MASTER", "local[8]")
    b = SparkSession.builder.master(master).appName(app)
    conf = dict(SCALE_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions or 8)
    conf.setdefault("spark.driver.memory", os.environ.get("SALESCAST_DRIVER_MEM", "8g"))
    if extra:
        conf.update(extra)
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints, stream state and written tables.

    Read from the session (``spark.checkpoint.dir`` or the context's
    checkpoint dir).  Only when neither is set -- local runs and tests -- a
    private scratch folder is created and registered.
    """
    sc = spark.sparkContext
    d = sc.getCheckpointDir()
    if d:
        return d.rstrip("/")
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        d = sc.getConf().get("spark.checkpoint.dir", None)
    if not d:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        d = tempfile.mkdtemp(prefix="salescast-ckpt-")
    sc.setCheckpointDir(d)
    # setCheckpointDir may add a per-application sub folder.
    return (sc.getCheckpointDir() or d).rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub folder of the shared checkpoint location."""
    import uuid
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
