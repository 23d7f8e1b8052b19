"""Session settings the audits rely on, and the shared folder for stage tables."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

# Runtime SQL settings. Joins carry no broadcast hints except for literal
# dictionaries, so the broadcast decision is always made by size: from scan
# statistics at planning time, from measured shuffle sizes under AQE.
# Tables keyed by (entity, bin) hold few rows per entity, so a partitioning by entity
# alone is even and may serve their joins.
# ``forceOptimizeSkewedJoin`` lets AQE split a hot entity even when the
# aggregate above the join then needs one more exchange.
# The advisory size is that of compressed shuffle files. After an exchange by entity a chain of
# aggregates follows in one task: 45 MB of files took 2.2 GB of a task's memory, 3 MB took 1.2 GB, most
# of which is the first page of each aggregate. At the default of 64 MB a task grows with the input.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4m",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
}


_LOCAL_DIRS: dict[str, str] = {}


def configure(spark: SparkSession) -> SparkSession:
    """Set the runtime settings above for the whole session, for good. That includes
    ``requireAllClusterKeysForCoPartition``, a guard against skewed joins that the caller's other
    queries lose too: give the library a session of its own (``spark.newSession()``) if they need it.
    """
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local-mode session may fall back to a temporary folder; on a cluster a
    machine-local path would vanish with the machine, so a missing setting fails.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    sc = spark.sparkContext
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    if sc.applicationId not in _LOCAL_DIRS:
        _LOCAL_DIRS[sc.applicationId] = tempfile.mkdtemp(prefix="spark-")
    return _LOCAL_DIRS[sc.applicationId]
