"""Intermediate tables in the shared checkpoint folder."""

from __future__ import annotations

import atexit
import uuid

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

#: Used only where the session names no folder and runs in one process, as in tests.
LOCAL_CHECKPOINTS = "/tmp/checkpoints"

_OWN: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """This process's own folder below ``spark.checkpoint.dir`` (or ``setCheckpointDir``), which a
    cluster must name. Tables that a query has written stay as long as its result may be read,
    and go with the folder when the driver ends; what a lost driver leaves is told by its name."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        set_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        named = set_dir.get() if set_dir.isDefined() else None
    if not named and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("a cluster needs a shared folder in spark.checkpoint.dir: executors and the driver share no local one")
    base = (named or LOCAL_CHECKPOINTS).rstrip("/")
    if base not in _OWN:
        if not _OWN:
            atexit.register(released)
        _OWN[base] = f"{base}/lattica-run-{uuid.uuid4().hex}"
    return _OWN[base]


def released() -> None:
    """Deletes what this process has written to shared folders; nothing of it may be read after."""
    jvm = SparkContext._jvm
    while _OWN and jvm is not None:
        _, folder = _OWN.popitem()
        try:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(jvm.org.apache.hadoop.conf.Configuration()).delete(path, True)
        except Exception:  # noqa: BLE001  (the process ends; a store that is gone keeps the folder)
            continue


def written(df: DataFrame) -> DataFrame:
    """``df``, written as Parquet and read again: evaluated once, and safe if executors are lost."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/lattica-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
