"""Scratch tables in the folder that driver and executors share. They end lineage, survive lost executors, and go with the driver."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession

_RUN = uuid.uuid4().hex
_TOPS: set[str] = set()
#: Of each thread the folders it made, so that threads clear none of each other's.
_LOCAL = threading.local()


def _made() -> list[str]:
    if not hasattr(_LOCAL, "made"):
        _LOCAL.made = []
    return _LOCAL.made


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. A local one is made only where there is one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = f"file://{tempfile.mkdtemp(prefix='mrflow-')}"
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def file_system(spark: SparkSession, path: str):
    """(Hadoop's file system of a path, the path)."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = file_system(spark, path)
    return fs.exists(p)


def delete(spark: SparkSession, path: str) -> bool:
    fs, p = file_system(spark, path)
    return fs.delete(p, True)


def folder(spark: SparkSession, name: str) -> str:
    """A path for a new folder of this driver's run; nothing is there yet."""
    top = f"{shared_dir(spark)}/mrflow-{_RUN}"
    if not _TOPS:
        atexit.register(_clear_at_exit, spark)
    _TOPS.add(top)
    _made().append(f"{top}/{name}-{uuid.uuid4().hex}")
    return _made()[-1]


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table of the run and read it back."""
    spark = df.sparkSession
    path = folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def mark() -> int:
    return len(_made())


def clear(spark: SparkSession, since: int = 0, but: int = 0) -> None:
    """Delete the folders that this thread made after a mark, but for the last ``but``. What was read from them can't be read again."""
    made = _made()
    for path in made[since : len(made) - but]:
        delete(spark, path)
    del made[since : len(made) - but]


def _clear_at_exit(spark: SparkSession) -> None:
    with contextlib.suppress(Exception):  # the session may have ended before
        for top in _TOPS:
            delete(spark, top)
