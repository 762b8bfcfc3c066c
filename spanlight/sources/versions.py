"""Tables as folders of versions: a change writes a new one, and readers take the newest that is complete."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spanlight.operators.upsert import insert_once


def _listed(spark: SparkSession, path: str) -> list[int]:
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return []
    versions = [s.getPath() for s in fs.listStatus(folder) if s.getPath().getName().startswith("v=")]
    return sorted(int(p.getName()[2:]) for p in versions if fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def read_latest(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The newest complete version; empty if there is none."""
    versions = _listed(spark, path)
    return spark.read.schema(schema).parquet(f"{path}/v={versions[-1]}") if versions else spark.createDataFrame([], schema)


class VersionConflictError(RuntimeError):
    """Another writer has taken the next version."""


def write_next(df: DataFrame, path: str, partition_by: tuple[str, ...] = (), base: int | None = None) -> int:
    """Write the version after ``base`` (the newest that is complete, unless it is given); returns its number.

    A version is taken by creating its claim, which only one writer can do: the second gets ``VersionConflictError`` and nothing is
    written over. Pass the version that was read as ``base``, so that a change made meanwhile is not lost. The version counts
    once its files are committed; a write that fails gives its claim back, so it is never read and can be tried again. What
    a writer that died left behind is taken away with ``abandon``.
    """
    spark = df.sparkSession
    if base is None:
        base = (_listed(spark, path) or [0])[-1]
    version = base + 1
    fs, at = _file_system(spark, path)
    fs.mkdirs(at(path))
    if base not in (0, *_listed(spark, path)):
        raise VersionConflictError(f"version {base} is not there")
    try:
        taken = not fs.createNewFile(at(f"{path}/_claim-{version}"))
    except Exception as error:  # some file systems raise where others say no
        raise VersionConflictError(f"version {version} is taken") from error
    if taken:
        raise VersionConflictError(f"version {version} is taken")
    try:
        df.write.mode("overwrite").partitionBy(*partition_by).parquet(f"{path}/v={version}")
    except BaseException:
        abandon(spark, path, version)
        raise
    return version


def abandon(spark: SparkSession, path: str, version: int) -> None:
    """Take away a version that was claimed and not completed."""
    if version in _listed(spark, path):
        raise VersionConflictError(f"version {version} is complete")
    fs, at = _file_system(spark, path)
    fs.delete(at(f"{path}/v={version}"), True)
    fs.delete(at(f"{path}/_claim-{version}"), False)


def _file_system(spark: SparkSession, path: str) -> tuple:
    new = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return new(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), new


def insert_rows_once(rows: DataFrame, path: str, keys: list[str]) -> int:
    """The next version: the newest one and ``rows``, whose keys must be new (``DuplicateKeyError`` otherwise, and no version)."""
    spark = rows.sparkSession
    base = (_listed(spark, path) or [0])[-1]
    old = spark.read.schema(rows.schema).parquet(f"{path}/v={base}") if base else rows.limit(0)
    return write_next(insert_once(old, rows, keys), path, base=base)


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def export_json(df: DataFrame, path: str) -> None:
    """JSON lines, ISO dates, text as it is. Nulls are written too."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)
