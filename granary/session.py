"""Session defaults and the shared working folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Partitioned writes keep up to this many files open per task and need no sort;
    # beyond it Spark falls back to sorting by the partition columns.
    "spark.sql.maxConcurrentOutputFileWriters": "64",
}


# A shuffle task's share before compression; well within an executor core's memory.
SHUFFLE_TASK_BYTES = 256 * 1024**2


def shuffle_partitions(data_bytes: int) -> int:
    """Shuffle width for an input size. Adaptive execution merges partitions that turn out
    small but cannot split below this number, so it has to fit the largest shuffle."""
    return max(200, -(-data_bytes // SHUFFLE_TASK_BYTES))


def get_session(
    app: str = "granary", master: str | None = None, data_bytes: int | None = None, **conf: str
) -> SparkSession:
    """Session with the defaults above; keyword names use ``__`` for dots.

    ``data_bytes``, the size of the largest input, sets the shuffle width.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    if data_bytes is not None:
        builder = builder.config("spark.sql.shuffle.partitions", shuffle_partitions(data_bytes))
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession, label: str) -> str:
    """A new folder under the cluster's shared ``spark.checkpoint.dir``.

    A machine-local folder is used only where the setting is absent and the
    session itself is local.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
        base = tempfile.mkdtemp(prefix="granary-")
    return f"{base.rstrip('/')}/granary-{label}-{uuid.uuid4().hex}"
