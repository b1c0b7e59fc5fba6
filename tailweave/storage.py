"""Tables stored between the steps of iterative plans."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_folder: list[str] = []
_written: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it; a temporary one on one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own_folder:
        made = tempfile.TemporaryDirectory(prefix="tailweave-")
        atexit.register(made.cleanup)
        _own_folder.append("file://" + made.name)
    return _own_folder[0]


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df once and read it back: lineage ends there, and lost executors cost nothing."""
    path = f"{shared_folder(df.sparkSession)}/tailweave/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def remove(spark: SparkSession, name: str) -> None:
    """Delete a file or folder of any file system that Spark knows."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def move(spark: SparkSession, name: str, to: str) -> None:
    """Rename a folder; one that has the new name is replaced.  Nothing happens if it is not there."""
    source, target = (spark.sparkContext._jvm.org.apache.hadoop.fs.Path(x) for x in (name, to))
    files = source.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if files.exists(source):
        files.delete(target, True)
        files.mkdirs(target.getParent())
        if not files.rename(source, target):
            raise OSError(f"{name} can't be renamed to {to}")


def discard(df: DataFrame | None) -> None:
    """Delete what ``stored`` wrote for df, once no plan reads it any more: the rounds of a loop leave only their last table."""
    path = getattr(df, "stored_at", None)
    if path in _written:
        _written.remove(path)
        remove(df.sparkSession, path)


def clear_stored(spark: SparkSession) -> None:
    """Delete all that this process has stored, once its results are written and no DataFrame needs it any more."""
    while _written:
        remove(spark, _written.pop())
