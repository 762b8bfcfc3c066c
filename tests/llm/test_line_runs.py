"""Line dedup against brute force over runs of any length."""

import random

import numpy as np
import pytest
from data import DOCUMENTS, random_text

import corpus_pipeline
from spanlight.llm import line_dedup


def frame(spark, texts):
    return spark.createDataFrame([(k, t, "en", "a", 0) for k, t in texts], DOCUMENTS)


def deduped(spark, texts):
    return {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(frame(spark, texts)).collect()}


def test_a_copy_of_every_deleted_line_stays(spark):
    rng = random.Random(1)
    long = [" ".join(f"w{k}x{n}" for n in range(25 + k)) for k in range(4)]
    pool = long + [random_text(rng, rng.randrange(1, 12), 400, 1000) for _ in range(8)] + ["", "a b"]
    rows = [(0, f"{long[0]}\n\n{long[0]}"), *((k, "\n".join(rng.choice(pool) for _ in range(rng.randrange(1, 14)))) for k in range(1, 40))]
    got = deduped(spark, rows)
    assert got[0].strip() == long[0]
    assert {x.strip() for t in got.values() for x in t.split("\n")} >= {x.strip() for _, t in rows for x in t.split("\n")} - {""}


def test_the_stage_keeps_a_doubled_paragraph(spark):
    line = " ".join(f"w{n}" for n in range(30))
    got = corpus_pipeline.line_stage(spark, frame(spark, [(1, f"{line}\n{line}")]), "").collect()
    assert [r["text"] for r in got] == [line]


def brute_runs(rows, window, long_words, min_words):
    """All runs of any length against their first occurrences."""
    first, out = {}, {}
    for i, text in sorted(rows):
        lines = (text or "").split("\n")
        units = [(line.strip(" \t\n\x0b\x0c\r"), k, len(line.split())) for k, line in enumerate(lines) if line.strip()]
        dead = set()
        for at in range(len(units)):
            for to in range(at + 1, len(units) + 1):
                run = units[at:to]
                if sum(n for *_, n in run) >= min_words and (len(run) >= window or any(n >= long_words for *_, n in run)):
                    places = {(i, k) for _, k, _ in run}
                    dead |= {k for _, k in places - first.setdefault(tuple(line for line, *_ in run), places)}
        out[i] = "\n".join(line for k, line in enumerate(lines) if k not in dead)
    return out


@pytest.mark.parametrize("window,long,least", [(1, 25, 1), (2, 25, 10), (3, 8, 20), (2, 5, 0)])
def test_runs_of_any_length(spark, window, long, least):
    rng = random.Random(window + least)
    pool = [random_text(rng, rng.randrange(1, 8), 400, 1000) for _ in range(6)] + [random_text(rng, 30, 400, 1000), "", " ", "a", "b"]
    rows = [(k, "\n".join(rng.choice(pool) for _ in range(rng.randrange(1, 14)))) for k in range(40)] + [(50, None), (51, "")]
    got = line_dedup.dedup_lines(frame(spark, rows), window, long, least).collect()
    assert {r["doc_id"]: r["text"] or "" for r in got} == brute_runs(rows, window, long, least)


def test_many_short_lines_are_one_run(spark):
    verse = "\n".join(f"line {k} of verse" for k in range(20))
    assert deduped(spark, [(1, verse), (2, f"before\n{verse}\nafter")]) == {1: verse, 2: "before\nafter"}


def test_minima_are_guaranteed_and_few():
    rng = np.random.default_rng(5)
    for window in (1, 2, 4, 7):
        prints = rng.integers(-1000, 1000, 3000)
        chosen = line_dedup.select_minima(prints, np.ones(3000, np.int32), window, 25)
        assert all(np.isin(chosen, np.arange(s, s + window)).any() for s in range(3000 - window + 1))
        assert len(chosen) < 3000 * 2 / (window + 1) * 1.1
    assert line_dedup.select_minima(np.zeros(4, np.int64), np.array([1, 30, 1, 1]), 9, 25).tolist() == [1]


def test_least_runs():
    rng = np.random.default_rng(6)
    for _ in range(200):
        words = rng.integers(1, 9, rng.integers(0, 12)).astype(np.int32)
        window, long_words, least = rng.integers(1, 4), rng.integers(4, 12), rng.integers(0, 14)
        fits = lambda s, e: sum(words[s:e]) >= least and (e - s >= window or (words[s:e] >= long_words).any())
        pairs = [(s, e) for s in range(len(words)) for e in range(s + 1, len(words) + 1) if fits(s, e)]
        want = {p for p in pairs if (p[0], p[1] - 1) not in pairs} | {p for p in pairs if (p[0] + 1, p[1]) not in pairs}
        starts, ends = line_dedup.least_runs(words, window, long_words, least)
        assert set(zip(starts.tolist(), ends.tolist(), strict=True)) == want


def test_matches_grow_to_both_sides(spark):
    """A run of nine lines that two documents share is one match, whatever stands around it."""
    shared = [f"the shared line number {k} of this passage" for k in range(9)]
    rows = [(1, "\n".join(["own beginning of one", *shared, "own end of one"])), (2, "\n".join(["x", "", "y", *shared[:4], " ", *shared[4:], "z"]))]
    runs = line_dedup.longest_runs(line_dedup.repeated_runs(frame(spark, rows))).collect()
    assert [(r["doc_id"], r["at"], r["n"], r["first_doc"], r["first_at"]) for r in runs] == [(2, 2, 9, 1, 1)]


def test_a_line_in_every_document(spark):
    """A frequent line makes no pairs: each later position meets one place."""
    rows = [(k, f"the very same line of words that all have here\nown line {k} of this document and no other has it") for k in range(400)]
    rows += [(1000 + k, "the very same line of words that all have here\nand the same second line after it everywhere") for k in range(300)]
    runs = line_dedup.repeated_runs(frame(spark, rows)).collect()
    assert len(runs) == 299 and {r["first_doc"] for r in runs} == {1000}


def test_texts_of_one_id_are_told_apart(spark):
    line = "this line stands in the two texts and has many words"
    rows = [(None, f"{line}\n{line} again"), (None, "another text\nwithout repeats"), (7, f"first\n{line}\n{line} again"), (7, "second\nof the same id")]
    got = sorted((r["doc_id"] or 0, r["text"]) for r in line_dedup.dedup_lines(frame(spark, rows)).collect())
    assert got == sorted([(0, rows[0][1]), (0, rows[1][1]), (7, "first"), (7, rows[3][1])])


def test_bitmap_loses_no_row(spark):
    from pyspark.sql import functions as F

    from spanlight.llm.bitmaps import split_by_keys

    docs = spark.range(3000).toDF("spot").withColumn("part", F.col("spot"))
    keys = spark.range(0, 3000, 7).select(F.xxhash64("id").alias("k"))
    for most in (1 << 15, 1 << 27):
        hit, clean = split_by_keys(docs, F.xxhash64("spot"), keys, most)
        held, free = ({r["spot"] for r in x.collect()} for x in (hit, clean))
        assert held | free == set(range(3000)) and not held & free and set(range(0, 3000, 7)) <= held and len(held) < 700
