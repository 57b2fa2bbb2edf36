"""The folder that all executors share, for lineage cuts and written results."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from py4j.java_gateway import JavaObject
from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

#: Folders with intermediate results of this application, and the configuration of their file system.
_intermediate: list[tuple[str, JavaObject]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``.

    Where the setting is missing on a single machine (master ``local``, as in tests), a temporary folder is made and set;
    on a cluster that is an error, as executors don't share such a folder.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="tickforge-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def write_shared(df: DataFrame, name: str, lasting: bool = False) -> str:
    """Write ``df`` as Parquet below the shared folder and return the new path.

    The path is unique to the call, so a repeated run never reads a former run's files; readers survive
    the loss of any executor because nothing but the shared folder holds the data. Folders that aren't ``lasting`` are
    deleted when the application ends, as the DataFrames that read them live no longer.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if not lasting:
        will_vanish(spark, path)
    df.write.parquet(path)
    return path


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder, if it exists."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def will_vanish(spark: SparkSession, path: str) -> None:
    """Note a folder to be deleted when the application ends."""
    _intermediate.append((path, spark.sparkContext._jsc.hadoopConfiguration()))


@atexit.register
def delete_intermediate() -> None:
    """Delete all intermediate folders written so far; DataFrames that read them can't be used any more."""
    jvm = SparkContext._jvm
    while _intermediate and jvm is not None:
        path, conf = _intermediate.pop()
        try:
            folder = jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(conf).delete(folder, True)
        except Exception:  # the JVM may be gone already
            return
