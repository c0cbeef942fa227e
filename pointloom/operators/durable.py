"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

#: Tables written by this process and not deleted yet: application and path, for each open scope (the first one lasts).
_written: list[list[tuple[str, str]]] = [[]]


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share, taken from ``spark.checkpoint.dir``.

    Only a session within one machine may leave it unset (tests, local runs): a temporary folder is made and recorded
    in the session. Elsewhere that is an error, for executors would not see the folder.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.conf.get("spark.master", "")
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="pointloom-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is written there goes with the scope that it was asked for in, or at ``release``."""
    path = f"{shared_dir(spark)}/pointloom/{name}-{uuid.uuid4().hex}"
    _written[-1].append((spark.sparkContext.applicationId, path))
    return path


def delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    with contextlib.suppress(Exception):  # what can't be deleted now only takes space
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here and lost executors cost no recomputation.

    The files stay until ``discard`` of the result, the end of the scope they were written in, or ``release``.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``materialise`` that nothing will read any more: all that was made of them is itself written."""
    for table in tables:
        path = table.written_to
        for scope in _written:
            scope[:] = [x for x in scope if x[1] != path]
        delete(table.sparkSession, path)


def release(spark: SparkSession) -> None:
    """Delete all tables that this session's application wrote and still has; DataFrames over them can't be read afterwards."""
    app = spark.sparkContext.applicationId
    for scope in _written:
        for owner, path in scope:
            if owner == app:
                delete(spark, path)
        scope.clear()


@contextlib.contextmanager
def temporary_tables(spark: SparkSession) -> Iterator[None]:
    """A scope at whose end the tables written within are deleted. Results have to be written or collected before."""
    _written.append([])
    try:
        yield
    finally:
        app = spark.sparkContext.applicationId
        for owner, path in _written.pop():
            if owner == app:
                delete(spark, path)
