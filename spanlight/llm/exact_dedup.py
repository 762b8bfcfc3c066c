"""Exact dedup with a log-structured merge index of digests.

Each split of a table is a memtable that is flushed as a sorted run of (digest, id); all runs of one table are a batch of
level 0. Compaction merges the last level 1 with the batches flushed since, into one row per digest with the
smallest and the largest identifier and the number of rows. Digests of a batch that more than one row has are its hits. A
bitmap over the hits is probed where texts are read, so only texts that may be hits leave their
task; groups are then formed on digest and bytes.

Runs of an index that further tables are added to hold the texts too. Such a batch is laid out in slices by a hash of the digest, and a
filter of its digests stands beside it. A further table asks the filters of the earlier batches which of its digests
they may hold, and reads texts only from slices with such digests. What is asked and read grows with the new table
and its hits, not with the index.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlight.llm.bitmaps import MOST, PART, bit_of, bitmap_of, split_by_keys
from spanlight.llm.common import ascii_lower, scratch_path, stash, whole

RUN_SCHEMA = "digest string, doc_id bigint, sha string, body string, batch int, slice int, slices int"
LEVEL_SCHEMA = "digest string, smallest bigint, largest bigint, n bigint"
FILTER_SCHEMA = "part bigint, held binary, bits bigint, slices int"
#: Rows of a slice of a batch that holds texts, and slices of a batch at most.
SLICE_ROWS = 100_000
MOST_SLICES = 1024
#: Bits of a batch's filter for each of its rows. One digest in 16 or fewer is asked for in vain.
FILTER_BITS = 16
#: So many batches wait for a compaction in an index that tables are added to.
FAN_IN = 4


def slice_of(digest: Column, slices: Column) -> Column:
    return F.pmod(F.xxhash64(digest), slices).cast("int")


def sha256_hex(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def _numbers(spark: SparkSession, folder: str) -> list[int]:
    """The numbers N of the finished folders ``name=N`` in a folder, ascending."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(folder)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return []
    found = [f.getPath() for f in fs.listStatus(at)]
    return sorted(int(p.getName().split("=")[1]) for p in found if fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def read_batch(spark: SparkSession, path: str, batch: int) -> DataFrame:
    return spark.read.schema(RUN_SCHEMA).parquet(f"{path}/level0/batch={batch}").withColumn("batch", F.lit(batch))


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """All runs of level 0 with the number of their batch."""
    batches = [read_batch(spark, path, k) for k in _numbers(spark, f"{path}/level0")]
    runs = batches[0]
    for more in batches[1:]:
        runs = runs.unionByName(more)
    return runs


def flush_runs(
    docs: DataFrame,
    path: str,
    digest: Callable[[Column], Column] = sha256_hex,
    id_col: str = "doc_id",
    text_col: str = "text",
    bodies: bool = True,
) -> int:
    """Add the runs of ``docs``, one for each split, to level 0 at ``path`` as a new batch, and return its number.

    Without ``bodies`` only ids and digests are written, which is enough where no later table is compared with this one; sorting
    stays within a split, so that needs no shuffle. With them, rows are shuffled once into slices; rows of one digest come
    from several splits and spread over up to eight files of its slice. Of two writers at once the second fails.
    """
    spark = docs.sparkSession
    text = ascii_lower(whole(F.col(text_col)))
    entries = docs.select(
        digest(text).alias("digest"),
        F.col(id_col).cast("long").alias("doc_id"),
        (F.lit(None).cast("string") if digest is sha256_hex else sha256_hex(text)).alias("sha"),
        (text if bodies else F.lit(None).cast("string")).alias("body"),
    )
    batch = max(_numbers(spark, f"{path}/level0"), default=0) + 1
    target = f"{path}/level0/batch={batch}"
    if bodies:
        rows, slices = docs.count(), 1
        while slices < MOST_SLICES and slices * SLICE_ROWS < rows:
            slices *= 2
        sliced = entries.withColumn("slices", F.lit(slices)).withColumn("slice", slice_of(F.col("digest"), F.col("slices"))).withColumn("split", F.spark_partition_id() % 8)
        sliced.repartition("slice", "split").drop("split").sortWithinPartitions("slice", "digest").write.partitionBy("slice").parquet(target)
        write_filter(spark, path, batch)
    else:
        entries.sortWithinPartitions("digest").write.parquet(target)
    return batch


def write_filter(spark: SparkSession, path: str, batch: int) -> None:
    """Store the filter of a batch: a bitmap of ``FILTER_BITS`` for each row, in rows of 4 KB that are never broadcast."""
    entries = read_batch(spark, path, batch)
    rows, slices = entries.agg(F.count("*"), F.coalesce(F.max("slices"), F.lit(1))).first()
    bits = PART
    while bits < FILTER_BITS * rows:
        bits *= 2
    made = bitmap_of(entries, F.xxhash64("digest"), bits)
    made.select("*", F.lit(bits).cast("long").alias("bits"), F.lit(slices).alias("slices")).write.mode("overwrite").parquet(f"{path}/filters/batch={batch}")


def may_hold(spark: SparkSession, path: str, digests: DataFrame, batches: list[int]) -> DataFrame:
    """(batch, slice, digest): the slices of batches that may hold a digest, by their filters. No batch that holds it is missing.

    Digests meet the rows of the filters in one join. Filters that an earlier failure left out are made first.
    """
    for k in set(batches) - set(_numbers(spark, f"{path}/filters")):
        write_filter(spark, path, k)
    filters = [spark.read.schema(FILTER_SCHEMA).parquet(f"{path}/filters/batch={k}").withColumn("batch", F.lit(k)) for k in batches]
    held = filters[0]
    for more in filters[1:]:
        held = held.unionByName(more)
    sizes = [(k, row["bits"]) for k, f in zip(batches, filters, strict=True) if (row := f.select("bits").first())]
    if not sizes:  # all batches are empty
        return digests.select(F.lit(0).alias("batch"), F.lit(0).alias("slice"), "digest").limit(0)
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("batch"), F.lit(bits).cast("long").alias("bits")) for k, bits in sizes])).alias("f")
    asked = digests.select("digest", each).select("digest", "f.batch", F.pmod(F.xxhash64("digest"), F.col("f.bits")).alias("spot"))
    asked = asked.withColumn("part", F.floor(F.col("spot") / PART))
    found = asked.join(held, ["batch", "part"]).where(bit_of(F.col("held"), F.col("spot") % PART))
    return found.select("batch", slice_of(F.col("digest"), F.col("slices")).alias("slice"), "digest")


def earlier_rows(spark: SparkSession, path: str, asked: DataFrame) -> DataFrame | None:
    """(doc_id, body, digest) of the rows that hold the digests in ``asked`` (batch, slice, digest; written), from these slices only."""
    slices: dict[int, list[int]] = {}
    for batch, number in asked.select("batch", "slice").distinct().collect():  # at most MOST_SLICES numbers for each batch
        slices.setdefault(batch, []).append(number)
    found = None
    for batch, numbers in sorted(slices.items()):
        rows = read_batch(spark, path, batch).where(F.col("slice").isNull() | F.col("slice").isin(numbers))
        rows = rows.join(asked.where(F.col("batch") == batch).select("digest"), "digest", "left_semi").select("doc_id", "body", "digest")
        found = rows if found is None else found.unionByName(rows)
    return found


def compact(spark: SparkSession, path: str) -> DataFrame:
    """Merge level 1 and the batches flushed since: (digest, smallest, largest, n), sorted, one row per digest.

    Counts and identifiers combine before the shuffle, so a digest that holds a third of all rows reaches
    the merge as one row per task. The new level stands beside the old one; an attempt that failed counts for nothing.
    """
    levels, batches = _numbers(spark, f"{path}/level1"), _numbers(spark, f"{path}/level0")
    done, last = max(levels, default=0), max(batches, default=0)
    target = f"{path}/level1/upto={last}"
    if last > done:
        fresh = read_runs(spark, path).where(F.col("batch") > done)
        rows = fresh.select("digest", F.col("doc_id").alias("smallest"), F.col("doc_id").alias("largest"), F.lit(1).cast("long").alias("n"))
        if done:
            rows = rows.unionByName(spark.read.schema(LEVEL_SCHEMA).parquet(f"{path}/level1/upto={done}"))
        merged = rows.groupBy("digest").agg(F.min("smallest").alias("smallest"), F.max("largest").alias("largest"), F.sum("n").alias("n"))
        merged.sortWithinPartitions("digest").write.mode("overwrite").parquet(target)
    return spark.read.schema(LEVEL_SCHEMA).parquet(target)


def dedup(
    docs: DataFrame,
    keep: str = "smallest",
    digest: Callable[[Column], Column] = sha256_hex,
    id_col: str = "doc_id",
    text_col: str = "text",
    index_path: str | None = None,
    filter_bits: int = MOST,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; null counts as empty, so null and empty texts form
    one group. Of equal texts the row with the smallest (or largest) id stays; if that id occurs in several
    rows of the group, all of them count as staying; ids that are null come into question only if all are. An empty
    table gives no rows. Two texts with one digest but different bytes end in different groups.

    At ``index_path`` lies an index that may hold tables of earlier calls. Their rows count in the groups (``keep_id`` may be
    one of theirs) but are not returned, and ``docs`` is added to the index; every ``FAN_IN`` tables it is compacted. The filter has ``filter_bits`` at most; where that
    is few for the hits, more texts are verified, and none is missed.
    """
    spark = docs.sparkSession
    path = index_path or scratch_path(spark, "digest-index")
    pick = {"smallest": F.min, "largest": F.max}[keep]
    batch = flush_runs(docs, path, digest, id_col, text_col, bodies=index_path is not None)
    own = read_batch(spark, path, batch).select("digest", "doc_id", F.coalesce("sha", "digest").alias("sha"))
    earlier = [k for k in _numbers(spark, f"{path}/level0") if k < batch]
    if earlier:
        counted = stash(own.groupBy("digest").agg(F.count("*").alias("n")), "digest-own")
        asked = stash(may_hold(spark, path, counted.select("digest"), earlier), "digest-asked")
        several = counted.where("n > 1").select("digest").unionByName(asked.select("digest")).distinct()
        if batch - max(_numbers(spark, f"{path}/level1"), default=0) >= FAN_IN:
            compact(spark, path)
    else:
        several = compact(spark, path).where("n > 1").select("digest")
    keys = stash(several.select(F.xxhash64("digest").alias("k")), "digest-hits")

    def probe(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        return split_by_keys(rows, F.xxhash64("digest"), keys, filter_bits)

    single = probe(own)[1].select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), "sha")
    text = ascii_lower(whole(F.col(text_col)))
    bodies = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("body")).withColumn("digest", digest(F.col("body")))
    hits = stash(probe(bodies)[0], "digest-bodies")
    # Byte verification: the class of a hit is its digest and its bytes. Classes are written, so that both sides of the
    # join are plain shuffles and a group that holds a third of all rows is split over tasks.
    found = earlier_rows(spark, path, asked) if earlier else None
    met = hits if found is None else hits.unionByName(found)
    classes = met.groupBy("digest", "body").agg(pick("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    classes = stash(classes, "digest-classes")
    sha = F.col("digest") if digest is sha256_hex else sha256_hex(F.col("body"))
    grouped = hits.join(classes, ["digest", "body"]).select("doc_id", "keep_id", "group_size", sha.alias("sha"))
    return single.unionByName(grouped).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("sha").alias("text_sha256")
    )
