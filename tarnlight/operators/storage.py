"""Tables in the folder that a cluster shares (spark.checkpoint.dir), which cut lineage and outlive executors, and broadcasts."""

from __future__ import annotations

import atexit
import pickle
import tempfile
import uuid
from collections.abc import Callable

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

_folders: dict[str, str] = {}


def _delete(spark: SparkSession, path: str) -> None:
    jsc = spark.sparkContext._jsc
    if jsc is not None:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(jsc.hadoopConfiguration()).delete(p, True)


def folder(spark: SparkSession) -> str:
    """This application's own folder under ``spark.checkpoint.dir``; removed when the driver exits.

    Only a local session without that setting gets a temporary folder; elsewhere executors wouldn't share it, so that is an error.
    """
    sc = spark.sparkContext
    if sc.applicationId not in _folders:
        root = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
        if not root:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            root = "file://" + tempfile.mkdtemp(prefix="tarnlight-")
            sc.setCheckpointDir(root)
        _folders[sc.applicationId] = f"{root.rstrip('/')}/tarnlight-{sc.applicationId}"
        atexit.register(_delete, spark, _folders[sc.applicationId])
    return _folders[sc.applicationId]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"


FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str, path: str | None = None, free: bool = False) -> DataFrame:
    """``df`` written once as Parquet and read back.  ``free``: what it shuffled is deleted at once."""
    path = path or new_path(df.sparkSession, name)
    conf = df.sparkSession.conf
    before = conf.get(FREE, "false")
    if free:
        conf.set(FREE, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if free:
            conf.set(FREE, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(spark: SparkSession, path: str) -> None:
    """Delete a table that ``stored`` wrote, once nothing reads it any more."""
    _delete(spark, path)


def sent(spark: SparkSession, value) -> Callable[[], object]:
    """Broadcast ``value``, of bounded size, with the classes of this package in it; tasks call the result once to get it."""
    held = spark.sparkContext.broadcast(cloudpickle.dumps(value))
    return lambda: pickle.loads(held.value)
