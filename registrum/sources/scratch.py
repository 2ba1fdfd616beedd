"""A shared folder for tables that a run writes and reads again."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path under spark.checkpoint.dir; only a local session without that setting gets a folder of its own."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if not getattr(scratch_path, "own", None):
            scratch_path.own = tempfile.mkdtemp(prefix="registrum-")
            atexit.register(shutil.rmtree, scratch_path.own, ignore_errors=True)
        named = f"file://{scratch_path.own}"
    return f"{named.rstrip('/')}/registrum-{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """Writes df once to a path of its own and reads it back: later plans begin there. clear() deletes it."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    _kept.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_kept: list[str] = []


def clear(spark: SparkSession) -> None:
    """Deletes what kept() has written, once nothing reads it any more."""
    while _kept:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_kept.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
