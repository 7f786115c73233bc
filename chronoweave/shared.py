"""The folder that driver and executors share, and tables written there."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``.

    A local folder stands in only where it is unset and driver and executors are one
    process, as in tests; a cluster without the setting is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return "file:///tmp/checkpoints/chronoweave"


def located(spark: SparkSession, path: str):
    """The path and its file system."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def new_folder(spark: SparkSession) -> str:
    """A path of its own under the shared folder, deleted when the driver ends."""
    path = f"{shared_dir(spark)}/cw-{uuid.uuid4().hex}"
    at, files = located(spark, path)
    files.mkdirs(at)
    files.deleteOnExit(at)
    return path


#: By path, the session and a weak reference to what reads the table, of each that is not deleted.
_SAVED: dict[str, tuple] = {}


def save(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    The written table cuts the lineage, so that losing an executor later costs a reread
    and not a recomputation, and several readers share one computation.  It is deleted by
    :func:`free` or :func:`sweep`, or else when the driver ends.
    """
    spark = df.sparkSession
    path = new_folder(spark)
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cw_path = path
    plan = out._jdf.queryExecution().analyzed()
    if plan.getClass().getSimpleName() == "LogicalRelation":  # each reading has a format object of its own, which its plans and also their RDDs hold
        _SAVED[path] = spark, spark._jvm.java.lang.ref.WeakReference(plan.relation().fileFormat())
    return out


def free(*tables: DataFrame) -> None:
    """Delete tables written by :func:`save`."""
    for df in tables:
        at, files = located(df.sparkSession, df._cw_path)
        files.delete(at, True)
        _SAVED.pop(df._cw_path, None)


def sweep(spark: SparkSession) -> None:
    """Delete the tables of :func:`save` in this application that no DataFrame, RDD or iterator can read any more.

    Python's garbage and the JVM's are collected first, which also lets Spark delete shuffle files.
    What Python lets go here is known to the JVM a second later, so to the next call.
    """
    gc.collect()
    spark._jvm.System.gc()
    for path, (owner, index) in list(_SAVED.items()):
        if owner.sparkContext is not spark.sparkContext:  # of a driver that has ended
            del _SAVED[path]
        elif index.refersTo(None):
            at, files = located(spark, path)
            files.delete(at, True)
            del _SAVED[path]
