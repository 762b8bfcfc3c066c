"""Written tables between the steps of a job, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, suppress
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: Paths stashed in the innermost scope; each thread has its own, so jobs side by side keep their tables apart.
_scope: ContextVar[list[str] | None] = ContextVar("scratch_scope", default=None)


def scratch_root(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Where it is unset, a temporary folder is taken once per application if the master is local (tests); on a cluster
    executors would not see it, so that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    context = spark.sparkContext
    held = context._jsc.sc().getCheckpointDir()
    if not held.isDefined():
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spanlight-"))
    return context._jsc.sc().getCheckpointDir().get()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in this application's folder, which goes when Python ends."""
    context = spark.sparkContext
    folder = f"{scratch_root(spark).rstrip('/')}/spanlight/{context.applicationId}"
    if getattr(context, "_spanlight_scratch", None) != folder:
        context._spanlight_scratch = folder
        atexit.register(_drop_quietly, spark, folder)
    path = f"{folder}/{name}-{uuid.uuid4().hex}"
    if (held := _scope.get()) is not None:
        held.append(path)
    return path


def stash(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it again.

    Cuts the lineage, and what was written survives the loss of any executor.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def _drop_quietly(spark: SparkSession, path: str) -> None:
    with suppress(Exception):  # the session may be gone by then
        drop(spark, path)


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Drops what is stashed inside at the end; results that are still needed must be written elsewhere by then."""
    held: list[str] = []
    outer = _scope.set(held)
    try:
        yield
    finally:
        _scope.reset(outer)
        for path in held:
            drop(spark, path)
