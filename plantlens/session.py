"""Session helpers: a tuned local session for tests/bench, and the shared folder.

On a cluster the session is given; nothing here overrides its settings.
Scratch data (streaming checkpoints, materialised tables) always goes under
the folder the cluster names in ``spark.checkpoint.dir``.  Only when that is
unset (local tests) do we create one.  Scratch tables are removed when they
are replaced (``drop_scratch``), on ``release``, and when the driver ends.
"""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def get_spark(master: str | None = None, shuffle_partitions: int = 8,
              app: str = "plantlens") -> SparkSession:
    master = master or os.environ.get("PLANTLENS_MASTER", "local[8]")
    spark = (
        SparkSession.builder.master(master).appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("PLANTLENS_DRIVER_MEM", "16g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The cluster-shared folder for checkpoints and written tables."""
    sc = spark.sparkContext
    d = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not d:
        master = sc.master or ""
        if not master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        d = tempfile.mkdtemp(prefix="plantlens-ckpt-")
        sc.setCheckpointDir(d)
    return d.rstrip("/")


_SCRATCH: list[tuple[SparkSession, str]] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, uniquely named location under the shared folder, removed at the end."""
    path = f"{shared_dir(spark)}/plantlens/{name}-{uuid.uuid4().hex[:12]}"
    _SCRATCH.append((spark, path))
    return path


def drop_scratch(spark: SparkSession, path: str) -> None:
    """Remove a scratch location; what still reads it must be consumed before."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    _SCRATCH[:] = [x for x in _SCRATCH if x[1] != path]


@atexit.register
def release() -> None:
    """Remove every scratch location of this process."""
    for spark, path in list(_SCRATCH):
        if spark.sparkContext._jsc is None:  # the session has ended
            continue
        try:
            drop_scratch(spark, path)
        except Exception:  # the gateway goes down with the driver
            return
