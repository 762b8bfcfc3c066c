"""The registered sharding query returns what lies in written shards."""

import zlib

import pyarrow.parquet as pq
from data import DOCUMENTS, awkward_rows

from spanlight.llm import queries, sharding


def test_query_reads_written_shards(spark, tmp_path):
    rows = [r for r in awkward_rows() if r[0] is not None]
    docs = spark.createDataFrame(rows, DOCUMENTS)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    out = queries.op10_sharding(spark, str(tmp_path))
    files = out.inputFiles()
    assert files and all("/shard=" in f for f in files)
    held = spark.read.parquet(files[0].split("/shard=")[0]).collect()
    key = lambda r: tuple(map(repr, r))
    assert sorted(key((r["doc_id"], r["text"])) for r in held) == sorted(key(r[:2]) for r in rows)
    texts = {(r["shard"], r["slot"]): (r["doc_id"], (r["text"] or "").encode()) for r in held}
    got = out.collect()
    assert len(got) == len(texts) == len(rows)
    for r in got:
        i, text = texts[r["shard"], r["slot"]]
        assert (r["doc_id"], r["size"], r["text_crc32"]) == (i, len(text) + 8, zlib.crc32(text))
    assert sorted(map(key, got)) == sorted(map(key, sharding.shuffle_into_shards(docs, n_shards=24).collect()))


def test_shards_of_nothing(spark):
    assert sharding.sharded(spark.createDataFrame([], DOCUMENTS)).collect() == []


def buckets_of(spark, rows, bucket_bytes=64 << 20, bucket_rows=10**6):
    scattered, _ = sharding.scatter(spark.createDataFrame(rows, DOCUMENTS), 17, bucket_bytes, bucket_rows, "doc_id", "text", ())
    return [r["count"] for r in scattered.groupBy("bucket").count().collect()]


def test_copies_of_one_row_are_scattered(spark):
    sizes = buckets_of(spark, [(5, "the same text", "en", "a", 0)] * 2000, bucket_bytes=400)
    assert len(sizes) > 60 and max(sizes) < 150


def test_empty_texts_are_bounded_by_rows(spark):
    sizes = buckets_of(spark, [(k, None, "en", "a", 0) for k in range(3000)], bucket_rows=100)
    assert len(sizes) > 15 and max(sizes) < 500


def test_files_of_a_shard_follow_each_other_by_slot(spark, tmp_path):
    rows = [(k // 3, f"text {k // 3} " * (k % 7), "en", "a", 0) for k in range(500)]
    placed = sharding.shuffle_into_shards(spark.createDataFrame(rows, DOCUMENTS).repartition(5), n_shards=3, bucket_bytes=1000, carry=("text",))
    assert placed._jdf.queryExecution().executedPlan().toString().count("shufflepartitionidpassthrough") == 1
    sharding.write_shards(placed, f"{tmp_path}/shards")
    held = 0
    for shard in range(3):
        slots = []
        for file in sorted((tmp_path / "shards" / f"shard={shard}").glob("*.parquet")):
            slots += pq.read_table(file, columns=["slot"])["slot"].to_pylist()
        assert slots == list(range(len(slots)))
        held += len(slots)
        assert len(slots) in (166, 167)
    assert held == 500


def test_fewer_records_than_shards(spark):
    rows = [(k, "a", "en", "a", 0) for k in range(5)]
    got = sharding.shuffle_into_shards(spark.createDataFrame(rows, DOCUMENTS), n_shards=24).collect()
    assert sorted((r["shard"], r["slot"]) for r in got) == [(k, 0) for k in range(5)]
