"""Tables that a job keeps for itself in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    Only where it is unset and all tasks run in this process' JVM a local one is made; a cluster without it is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tidemark-{uuid.uuid4().hex}/{name}"


_SCRATCH = threading.local()


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that are staged inside are removed at its end, but those staged with ``keep``, which belong to what is around it.

    Only for work that is done by its end: nothing that is read later may be left to a table of its own.
    """
    scopes = _SCRATCH.__dict__.setdefault("scopes", [])
    scopes.append([])
    try:
        yield
    finally:
        for path in scopes.pop():
            fs, make = file_system(spark, path)
            fs.delete(make(path).getParent(), True)


def staged(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage (a lost executor costs a re-read, not a re-run) and gives the optimizer file
    statistics, so that it can choose a broadcast by measured size.
    """
    spark, path = df.sparkSession, fresh_path(df.sparkSession, name)
    scopes = _SCRATCH.__dict__.get("scopes", [])[: -1 if keep else None]
    if scopes:
        scopes[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def file_system(spark: SparkSession, path: str):
    """Hadoop's file system of a path and a maker of its paths."""
    make = spark._jvm.org.apache.hadoop.fs.Path
    return make(path).getFileSystem(spark._jsc.hadoopConfiguration()), make


def exists(spark: SparkSession, path: str) -> bool:
    fs, make = file_system(spark, path)
    return fs.exists(make(path))


def file_marks(spark: SparkSession, path: str) -> tuple:
    """Name, length and time of each file of a table, those in its folders too: other marks, other contents."""
    fs, make = file_system(spark, path)
    found, marks = fs.listFiles(make(path), True), []
    while found.hasNext():
        f = found.next()
        marks.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return tuple(sorted(marks))
