"""Two-pass external shuffle into shards.

Pass one deals every record by a seeded hash into buckets small enough for memory; a task receives a range of buckets. Pass two
shuffles each bucket (Fisher-Yates, by the engine's ``shuffle``), which gives every record a place in the whole order: the
records of earlier buckets, then its place in its own, and writes the buckets in that order. A shard is a range of places; shards
differ by one record at most. Only DataFrame functions are used.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from spanlight.llm.common import scratch_path, stash, whole


def bucket_offsets(counts: DataFrame, group: int = 1000) -> DataFrame:
    """(bucket, offset): records in all earlier buckets, by a two-level running sum.

    The inner sum runs within groups of ``group`` buckets and the outer one over group totals, so no task
    sees more than ``group`` buckets or all group totals.
    """
    grouped = counts.withColumn("g", F.floor(F.col("bucket") / group))
    inner = W.partitionBy("g").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    outer = W.partitionBy(F.lit(0)).orderBy("g").rowsBetween(W.unboundedPreceding, -1)
    totals = grouped.groupBy("g").agg(F.sum("n").alias("t"))
    totals = totals.select("g", F.coalesce(F.sum("t").over(outer), F.lit(0)).alias("start"))
    within = grouped.select("bucket", "g", F.coalesce(F.sum("n").over(inner), F.lit(0)).alias("inside"))
    return within.join(totals, "g").select("bucket", (F.col("start") + F.col("inside")).alias("offset"))


def text_size(text: Column) -> Column:
    """UTF-8 bytes plus 8."""
    return (F.octet_length(text) + 8).cast("long")


def text_checksum(text: Column) -> Column:
    return F.crc32(text.cast("binary")).cast("long")


class Layout(NamedTuple):
    """What pass one counted and decided: rows, buckets, and tasks that hold a range of buckets each."""

    rows: int
    buckets: int
    tasks: int


def scatter(docs: DataFrame, seed: int, bucket_bytes: int, bucket_rows: int, id_col: str, text_col: str, carry: tuple[str, ...]) -> tuple[DataFrame, Layout]:
    """Pass one's records (doc_id, size, text_crc32, payload, number) with their ``bucket`` and its task ``part``, and the layout.

    The records are written once with their numbers, so a task that runs again deals them out as before. There are as many
    buckets as the session has shuffle partitions, or more, unless they would be under a megabyte; a task holds at most about four full ones.
    """
    text = whole(F.col(text_col))
    records = docs.select(
        F.col(id_col).alias("doc_id"),
        text_size(text).alias("size"),
        text_checksum(text).alias("text_crc32"),
        *[F.col(f"`{c}`").alias(f"payload_{k}") for k, c in enumerate(carry)],
    )
    records = records.withColumn("number", F.monotonically_increasing_id())
    records = stash(records.withColumn("mark", F.xxhash64(F.lit(seed), "doc_id", "size", "text_crc32", "number")), "shard-records", "zstd")
    rows, total = records.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n_buckets = max(1, min(least, total >> 20), math.ceil(total / bucket_bytes), math.ceil(rows / bucket_rows))
    tasks = min(n_buckets, max(least, math.ceil(n_buckets / 4)))
    bucket = F.pmod("mark", F.lit(n_buckets))
    scattered = records.withColumn("bucket", bucket).withColumn("part", F.floor(F.col("bucket") * tasks / n_buckets).cast("int")).drop("mark")
    return scattered, Layout(rows, n_buckets, tasks)


def shard_of(place: Column, rows: int, n_shards: int) -> tuple[Column, Column]:
    """(shard, slot) of a place: each shard is a range of places, and the first ``rows % n_shards`` of them have one record more."""
    base, extra = divmod(rows, n_shards)
    wide = extra * (base + 1)
    early = place < wide
    past, least = place - F.lit(wide), F.lit(max(base, 1))
    slot = F.when(early, F.pmod(place, F.lit(base + 1))).otherwise(F.pmod(past, least))
    shard = F.when(early, (place - slot) / (base + 1)).otherwise((past - slot) / least + extra)
    return shard.cast("int"), slot.cast("long")


def shuffle_into_shards(
    docs: DataFrame,
    n_shards: int = 24,
    seed: int = 17,
    bucket_bytes: int = 64 << 20,
    id_col: str = "doc_id",
    text_col: str = "text",
    carry: tuple[str, ...] = (),
    bucket_rows: int = 200_000,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, text_crc32, law, shard, slot, grown_shard, then ``carry``.

    ``size`` is the text's UTF-8 bytes plus 8; a bucket has about ``bucket_bytes`` and no more than about ``bucket_rows`` rows.
    ``carry`` names payload columns that travel along (none: places only). Null text counts as empty. Repeated rows get a
    place each. An empty table gives no rows. The hash takes id, size, checksum and the number of the row in its input
    partition, so copies of one row are scattered like any others. The order depends on ``seed``, on the number of buckets and, where
    there are several, on how the input is split.
    """
    scattered, layout = scatter(docs, seed, bucket_bytes, bucket_rows, id_col, text_col, carry)
    offsets = bucket_offsets(scattered.groupBy("bucket").agg(F.count("*").alias("n")))
    # Fisher-Yates draws lots for the keys of the records, so a bucket is held in memory without its texts. The array is
    # sorted before it is shuffled, so the same seed gives the same order on every run.
    packed = scattered.groupBy("bucket", "part").agg(F.array_sort(F.collect_list(F.struct("doc_id", "size", "text_crc32", "number"))).alias("rows"))
    drawn = packed.select("bucket", "part", F.posexplode(F.shuffle("rows", F.lit(seed))).alias("pos", "r"))
    lots = drawn.join(offsets, "bucket").select("part", "r.number", (F.col("offset") + F.col("pos")).alias("place"))
    # Records and lots go to the task of their bucket; there the two rows of one number meet. Tasks hold ranges of buckets, and
    # so ranges of places.
    dealt = scattered.drop("bucket").unionByName(lots, allowMissingColumns=True).repartitionById(layout.tasks, F.col("part"))
    met = dealt.withColumn("place", F.max("place").over(W.partitionBy("part", "number"))).where(F.col("size").isNotNull())
    shard, slot = shard_of(F.col("place"), layout.rows, n_shards)
    return met.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        shard.alias("shard"),
        slot.alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        *[F.col(f"payload_{k}").alias(c) for k, c in enumerate(carry)],
    )


def write_shards(placed: DataFrame, path: str) -> None:
    """Write placed records (made with ``carry``) as one folder per shard.

    Each task writes the range of slots that its buckets have, in order, to a file of its own, mostly in one shard; files of a shard follow
    each other by name, so a shard is read in slot order without a sort.
    """
    placed.sortWithinPartitions("shard", "slot").write.option("compression", "zstd").partitionBy("shard").parquet(path)


def sharded(docs: DataFrame, n_shards: int = 24, seed: int = 17, bucket_bytes: int = 64 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The columns of ``shuffle_into_shards``, read from shards that were written with their texts in the shared folder.

    ``size`` and ``text_crc32`` are those of the text that lies in the slot.
    """
    spark = docs.sparkSession
    path = scratch_path(spark, "shards")
    placed = shuffle_into_shards(docs, n_shards, seed, bucket_bytes, id_col, text_col, carry=(text_col,))
    records = placed.select("doc_id", "shard", "slot", F.col(f"`{text_col}`").alias("text"))
    write_shards(records, path)
    text = whole(F.col("text"))
    return spark.read.schema(records.schema).parquet(path).select(
        "doc_id",
        text_size(text).alias("size"),
        text_checksum(text).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
