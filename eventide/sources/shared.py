"""The folder that driver and executors share, and in it one of each session, which goes with it."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset and all runs on one machine, a temporary folder."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir has to name a folder that all machines share")
        path = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


_SESSIONS: dict[tuple[str, str], str] = {}


def session_dir(spark: SparkSession) -> str:
    """The folder for what this session writes; it is deleted when the driver ends."""
    key = (spark.sparkContext.applicationId, shared_dir(spark))
    if key not in _SESSIONS:
        path = f"{key[1]}/session-{uuid.uuid4().hex}"
        place = make_folder(spark, path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
        _SESSIONS[key] = path
    return _SESSIONS[key]


def fresh_path(spark: SparkSession, tag: str) -> str:
    return f"{session_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def release(spark: SparkSession) -> None:
    """Delete all tables that this session has written; results that still read them can't be used any more."""
    remove(spark, session_dir(spark))
    make_folder(spark, session_dir(spark))


def remove(spark: SparkSession, path: str) -> None:
    """Delete a file or folder of the shared folder."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def make_folder(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(place)
    return place
