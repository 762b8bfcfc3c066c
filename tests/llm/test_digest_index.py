"""Exact dedup against an index of earlier tables."""

import random

import pytest
from data import DOCUMENTS
from pyspark.sql import functions as F

from spanlight.llm import exact_dedup


def frame(spark, texts):
    return spark.createDataFrame([(k, t, "en", "a", 0) for k, t in texts], DOCUMENTS)


@pytest.mark.parametrize("digest", [exact_dedup.sha256_hex, lambda c: F.substring(F.sha2(c.cast("binary"), 256), 1, 1)], ids=["sha256", "colliding"])
def test_earlier_tables_count(spark, tmp_path, digest):
    path = f"file://{tmp_path}/index"
    first = [(5, "one"), (6, "two"), (7, "TWO"), (8, None)]
    second = [(2, "Two"), (9, "ONE"), (10, "three"), (11, "four"), (12, "four"), (13, "")]
    said = lambda rows: sorted((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in rows.collect())
    assert said(exact_dedup.dedup(frame(spark, first), "smallest", digest, index_path=path)) == [(5, 5, 1, True), (6, 6, 2, True), (7, 6, 2, False), (8, 8, 1, True)]
    assert said(exact_dedup.dedup(frame(spark, second), "smallest", digest, index_path=path)) == [
        (2, 2, 3, True), (9, 5, 2, False), (10, 10, 1, True), (11, 11, 2, True), (12, 11, 2, False), (13, 8, 2, False)
    ]
    exact_dedup.flush_runs(frame(spark, [(1, "three")]), path, digest)
    assert said(exact_dedup.dedup(frame(spark, [(20, "Three")]), "smallest", digest, index_path=path)) == [(20, 1, 3, False)]


def test_results_outlive_the_next_table(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    first = exact_dedup.dedup(frame(spark, [(1, "a"), (2, "b")]), index_path=path)
    exact_dedup.dedup(frame(spark, [(3, "a")]), index_path=path)
    assert sorted((r["doc_id"], r["group_size"]) for r in first.collect()) == [(1, 1), (2, 1)]


@pytest.mark.parametrize("digest", [exact_dedup.sha256_hex, lambda c: F.substring(F.sha2(c.cast("binary"), 256), 1, 1)], ids=["sha256", "colliding"])
@pytest.mark.parametrize("keep,pick", [("smallest", min), ("largest", max)])
def test_three_batches_are_one_table(spark, tmp_path, digest, keep, pick):
    """What each batch says is what brute force says of all rows so far; the last batch agrees with one table of everything."""
    rng = random.Random(7)
    texts = ["", None, *(f"Text {k}" for k in range(30)), *(f"TEXT {k}" for k in range(30))]
    rows = [(k if k % 11 else None, rng.choice(texts)) for k in range(150)] + [(40, "text 1"), (40, "text 1")]
    path, so_far = f"file://{tmp_path}/index", []
    for batch in (rows[:60], rows[60:61], rows[61:]):
        so_far += batch
        groups = {}
        for i, t in so_far:
            groups.setdefault((t or "").lower(), []).append(i)
        want = []
        for i, t in batch:
            ids = groups[(t or "").lower()]
            best = pick((x for x in ids if x is not None), default=None)
            want.append((i, best, len(ids), i == best))
        got = exact_dedup.dedup(frame(spark, batch), keep, digest, index_path=path)
        assert sorted(map(repr, ((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in got.collect()))) == sorted(map(repr, want))


def test_texts_of_single_rows_are_not_shuffled(spark, tmp_path):
    """Only bodies that may be hits are written for verification."""
    rows = [(k, f"a text of its own {k}" * 20) for k in range(2000)] + [(3000 + k, "twice") for k in range(2)]
    held = []
    stash = exact_dedup.stash
    exact_dedup.stash = lambda df, name: held.append((name, out := stash(df, name))) or out
    try:
        assert exact_dedup.dedup(frame(spark, rows)).where("not kept").count() == 1
    finally:
        exact_dedup.stash = stash
    assert dict(held)["digest-bodies"].count() < 10


def test_a_small_table_reads_slices_of_its_hits(spark, tmp_path, monkeypatch):
    """A tenth table of few rows asks the filters of nine others, and reads texts of few slices."""
    path = f"file://{tmp_path}/index"
    monkeypatch.setattr(exact_dedup, "SLICE_ROWS", 130)
    for k in range(9):
        exact_dedup.flush_runs(spark.range(k * 2000, k * 2000 + 2000, 1, 1).select(F.col("id").alias("doc_id"), F.concat(F.lit("Text "), "id").alias("text")), path)
    fresh = [(90_000, "TEXT 5"), (90_001, "text 17000"), *((91_000 + k, f"new {k}") for k in range(20))]
    read = []
    rows_of = exact_dedup.earlier_rows
    exact_dedup.earlier_rows = lambda *a: read.append((a[2].select("batch", "slice").collect(), out := rows_of(*a))) or out
    try:
        got = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in exact_dedup.dedup(frame(spark, fresh), index_path=path).collect()}
    finally:
        exact_dedup.earlier_rows = rows_of
    assert got == {90_000: (5, 2), 90_001: (17_000, 2)} | {91_000 + k: (91_000 + k, 1) for k in range(20)}
    ((asked, rows),) = read
    scanned = sum(exact_dedup.read_batch(spark, path, batch).where(F.col("slice") == number).count() for batch, number in set(asked))
    assert rows.count() == 2 and scanned < 18_000 / 10
    scans = [s for s in rows._jdf.queryExecution().executedPlan().toString().split("FileScan")[1:] if "body" in s.split("]")[0]]
    assert scans and all("slice" in s.split("PartitionFilters: [")[1].split("]")[0] for s in scans)


def test_filters_miss_nothing_and_little_is_asked_in_vain(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    docs = lambda lo, hi: spark.range(lo, hi).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text"))
    exact_dedup.flush_runs(docs(0, 40_000).coalesce(1), path)
    exact_dedup.flush_runs(docs(0, 0), path)
    digests = docs(20_000, 60_000).select(exact_dedup.sha256_hex(F.col("text")).alias("digest"))
    asked = exact_dedup.may_hold(spark, path, digests, [1, 2])
    assert asked.join(exact_dedup.read_batch(spark, path, 1), "digest").count() == 20_000
    assert asked.count() < 20_000 + 20_000 / 16
    assert exact_dedup.may_hold(spark, path, digests, [2]).count() == 0


def test_a_filter_that_was_not_finished_is_made(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    exact_dedup.flush_runs(frame(spark, [(1, "a")]), path)
    (tmp_path / "index" / "filters" / "batch=1" / "_SUCCESS").unlink()
    got = exact_dedup.dedup(frame(spark, [(2, "A")]), index_path=path).collect()
    assert [(r["keep_id"], r["group_size"]) for r in got] == [(1, 2)]


def test_more_hits_than_bits(spark):
    docs = spark.range(100_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.col("id") % 50_000).alias("text"))
    got = exact_dedup.dedup(docs, filter_bits=1 << 15)
    assert got.agg(F.count_if(F.expr("group_size = 2 and keep_id = doc_id % 50000")), F.count_if("kept")).first()[:] == (100_000, 50_000)


def test_index_is_compacted_now_and_then(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    for k in range(exact_dedup.FAN_IN + 1):
        exact_dedup.dedup(frame(spark, [(10 - k, "same"), (100 + k, f"own {k}")]), index_path=path)
    assert len(list((tmp_path / "index" / "level1").glob("upto=*"))) == 2
    assert exact_dedup.compact(spark, path).where("n > 1").select("smallest", "n").first()[:] == (10 - exact_dedup.FAN_IN, exact_dedup.FAN_IN + 1)
