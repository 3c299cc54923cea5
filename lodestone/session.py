"""Session construction and the one place that decides where lineage is cut."""

from __future__ import annotations

import atexit
import contextlib
import os
import re
import tempfile
import uuid
import weakref

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

#: Folders to remove at exit, and where materialized frames are.
_folders: set[str] = set()
_written: dict[int, str] = {}

#: Settings every session needs for results to be reproducible, whatever the cluster.
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str | None = None, **conf: object) -> SparkSession:
    """A session with BASE_CONF, then ``conf`` (dots written as given in a dict)."""
    builder = SparkSession.builder.config(map={**BASE_CONF, **{k: str(v) for k, v in conf.items()}})
    return (builder.master(master) if master else builder).getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.  Unset, it is a local one of our own in local mode, and an error on a cluster."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current is None:
        if not re.match(r"local(\[.*\])?$", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(os.path.join(tempfile.gettempdir(), "lodestone-checkpoints"))
        current = spark.sparkContext.getCheckpointDir()
    return current


def scratch(spark: SparkSession, what: str) -> str:
    """A path of its own in this application's part of the shared folder; all of it goes when the process ends."""
    folder = f"{shared_dir(spark)}/lodestone-{spark.sparkContext.applicationId}"
    if folder not in _folders:
        _folders.add(folder)
        atexit.register(_remove_quietly, spark, folder)
    return f"{folder}/{what}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path of any file system that Spark reads."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def _remove_quietly(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # at exit the session may be gone
        remove(spark, path)


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it from there: lineage is cut, a lost executor loses nothing, and
    later plans know the size and read the columns they need."""
    path = scratch(df.sparkSession, "table")
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _written[id(out)] = path
    weakref.finalize(out, _written.pop, id(out), None)
    return out


def release(df: DataFrame) -> None:
    """Delete the files of a frame that materialize() returned; nothing that is still to be computed may read it."""
    if path := _written.pop(id(df), None):
        remove(df.sparkSession, path)


def claim(spark: SparkSession, path: str) -> bool:
    """Create an empty file, unless there is one: of several writers only one gets True."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(hadoop.getParent())
    try:
        files.create(hadoop, False).close()
    except Py4JJavaError as e:
        if "FileAlreadyExists" in str(e.java_exception) or "already exists" in str(e.java_exception):
            return False
        raise
    return True


def names_in(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder of any file system that Spark reads; none if there is no such folder."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    files = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [f.getPath().getName() for f in files.listStatus(hadoop)] if files.exists(hadoop) else []
