"""Session helpers.

The library never creates a session behind the caller's back; ``get_spark``
is for scripts and tests. ``checkpoint_dir`` reads ``spark.checkpoint.dir``
from the session (the shared folder a cluster names) and only sets a scratch
folder when none is configured, which is the local/test case.
"""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def get_spark(master: str | None = None, partitions: int | None = None,
              app: str = "tidewise") -> SparkSession:
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    master = master or f"local[{cpus}]"
    builder = (
        SparkSession.builder.master(master).appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(partitions or cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("TIDEWISE_DRIVER_MEMORY", "16g"))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder; set a scratch one only when unset."""
    sc = spark.sparkContext
    path = sc.getCheckpointDir()
    if path:
        return path
    conf = spark.conf.get("spark.checkpoint.dir", None)
    if not conf:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
        conf = tempfile.mkdtemp(prefix="tidewise-ckpt-", dir="/tmp")  # local mode / tests only
    sc.setCheckpointDir(conf)
    return sc.getCheckpointDir() or conf


def _file_system(spark: SparkSession, path: str):
    """Hadoop's file system of ``path`` and the path as its object."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()), found


def materialize(df, name: str = "table"):
    """Write ``df`` once as Parquet under the shared checkpoint folder and
    return a DataFrame reading it back. Used where several passes (fit
    aggregates, then the transform) would otherwise recompute an expensive
    lineage (a window shuffle); it also cuts the lineage, so a lost
    executor costs a re-read, not a recomputation. The table is removed by
    ``discard``, at the latest when the driver ends."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/tables/{name}-{uuid.uuid4().hex}"
    fs, at = _file_system(spark, path)
    fs.deleteOnExit(at)
    df.write.mode("error").parquet(path)
    out = spark.read.parquet(path)
    out.stored_at = path
    return out


def discard(df) -> None:
    """Remove the table that ``materialize`` returned; nothing may read it
    afterwards. Any other DataFrame is left alone."""
    path = getattr(df, "stored_at", None)
    if path:
        fs, at = _file_system(df.sparkSession, path)
        fs.delete(at, True)


_shared: dict[tuple, str] = {}
_sharing = threading.RLock()  # a table may be built from another


def shared(spark: SparkSession, name: str, source: str, build: Callable[[], DataFrame]) -> DataFrame:
    """``build()``, written by the first call and read by the later ones of an
    application, as long as ``source`` (a file or folder) keeps its length,
    number of files and time of change. The table of an older state of
    ``source`` stays until the driver ends, as plans may still read it."""
    fs, at = _file_system(spark, source)
    held = fs.getContentSummary(at)
    key = (spark.sparkContext.applicationId, name, source, held.getLength(), held.getFileCount(),
           fs.getFileStatus(at).getModificationTime())
    with _sharing:
        path = _shared.get(key)
        if path:
            fs, at = _file_system(spark, f"{path}/_SUCCESS")
            if fs.exists(at):
                return spark.read.parquet(path)
        df = materialize(build(), name)
        _shared[key] = df.stored_at
        return spark.read.parquet(df.stored_at)
