"""Tables that a job writes for its own later steps, in the folder that the cluster shares."""

from __future__ import annotations

import uuid
from threading import get_ident

from pyspark.sql import DataFrame, SparkSession

#: By application, its own folder where none is set; the tables that are there, in the order of writing: path, application and thread.
_folders: dict[str, str] = {}
_written: dict[str, tuple[str, int]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where it is unset, as in tests, a session with a local master gets a folder of its own; on a cluster
    that is an error. (The setting itself can't be changed in a running session.)"""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local[") and context.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if context.applicationId not in _folders:
        import tempfile

        _folders[context.applicationId] = f"file://{tempfile.mkdtemp(prefix='citelake-')}"
    return _folders[context.applicationId]


def new_path(spark: SparkSession) -> str:
    """A new path in the shared folder, which clean_up() deletes."""
    path = f"{shared_dir(spark)}/citelake-{uuid.uuid4().hex}"
    _written[path] = spark.sparkContext.applicationId, get_ident()
    return path


def durable(df: DataFrame) -> DataFrame:
    """Write `df` as Parquet into the shared folder and read it back: lineage is cut and lost executors cost nothing."""
    spark = df.sparkSession
    path = new_path(spark)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._citelake_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    own = spark._jvm.org.apache.hadoop.fs.Path(path)
    own.getFileSystem(spark._jsc.hadoopConfiguration()).delete(own, True)
    _written.pop(path, None)


def forget(df: DataFrame, *more: DataFrame, shuffles: bool = False) -> None:
    """Delete tables made by durable() that nothing reads any more. `shuffles`: let Spark's cleaner drop the shuffle files of plans that are done,
    too, which it else does at its own interval; for use after large shuffles."""
    spark = df.sparkSession
    for table in (df, *more):
        _delete(spark, table._citelake_path)
    if shuffles:
        spark._jvm.System.gc()


def written(spark: SparkSession) -> list[str]:
    """The paths of the tables that durable() has made in this application and thread and that are there still."""
    return [path for path, by in _written.items() if by == (spark.sparkContext.applicationId, get_ident())]


def clean_up(spark: SparkSession, keep: list[str] = ()) -> None:
    """Delete all those tables but the ones in `keep`. Results that read them must have been used by then."""
    for path in written(spark):
        if path not in keep:
            _delete(spark, path)
