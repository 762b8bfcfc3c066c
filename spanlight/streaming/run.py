"""Run a stream over files to its end and read what it wrote."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlight.scratch import scratch_path


STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def drain(spark: SparkSession, folder: str, name: str, build: Callable[[DataFrame], DataFrame], ts: str | None = None) -> DataFrame:
    """Read all files of a table as a stream, write the result as parquet, wait, and return it as a table.

    With ``ts``, two closing triggers follow: a row far behind the last time (null elsewhere) moves the watermark past all
    rows, so that nothing is held back. What such a row itself begins stays open and is not written.
    """
    table = spark.read.parquet(f"{folder}/{name}.parquet")
    stream = spark.readStream.schema(table.schema).option("pathGlobFilter", "*.parquet").parquet(_stream_path(spark, folder, name))
    if ts:
        closing = scratch_path(spark, f"{name}-closing")
        spark.createDataFrame([], table.schema).write.parquet(closing)
        stream = stream.unionByName(spark.readStream.schema(table.schema).parquet(closing))
    made = build(stream)
    out = scratch_path(spark, name)

    def run() -> None:
        query = made.writeStream.format("parquet").option("checkpointLocation", f"{out}-state").outputMode("append").trigger(availableNow=True).start(out)
        query.awaitTermination()

    before = spark.conf.get(STORE)
    spark.conf.set(STORE, ROCKS)  # a query keeps the store that it began with
    try:
        run()
        for _ in range(2 if ts else 0):  # once more for timers that were set while the first was handled
            last = table.agg((F.max(ts) + F.expr("INTERVAL 3650 DAYS")).alias(ts)).where(F.col(ts).isNotNull())
            last.select(*[F.col(f.name) if f.name == ts else F.lit(None).cast(f.dataType).alias(f.name) for f in table.schema]).write.mode("append").parquet(closing)
            run()
    finally:
        spark.conf.set(STORE, before)
    return spark.read.schema(made.schema).parquet(out)


def _stream_path(spark: SparkSession, folder: str, name: str) -> str:
    """A stream reads folders; a table of one file is named by a pattern that matches only it."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}.parquet")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return f"{folder}/{name}.parquet" if fs.getFileStatus(path).isDirectory() else f"{folder}/{name}.parque[t]"
