"""Levels of calls against brute force, and chains of any length."""

import random

from spanlight.llm import chat_format

CALLS = "conv_id long, call_id string, after array<string>"


def levels(spark, rows):
    return {(r["conv_id"], r["call_id"]): r["level"] for r in chat_format.topo_levels(spark.createDataFrame(rows, CALLS)).collect()}


def brute(rows):
    known = {(c, i) for c, i, _ in rows}
    open_ = {(c, i): {(c, n) for n in after or [] if (c, n) in known} for c, i, after in rows}
    done = {}
    while ready := [k for k, needs in open_.items() if k not in done and needs <= done.keys()]:
        done |= {k: 1 + max([done[n] for n in open_[k]], default=-1) for k in ready}
    return {k: done.get(k) for k in open_}


def test_a_long_chain_is_no_cycle(spark):
    rows = [(1, f"c{k}", [f"c{k - 1}"]) for k in range(1500)]
    rows += [(2, "a", ["b"]), (2, "b", ["c"]), (2, "c", ["a"]), (2, "d", ["c"]), (2, "e", [])]
    got = levels(spark, rows)
    assert [got[1, f"c{k}"] for k in range(1500)] == list(range(1500))
    assert [got[2, i] for i in "abcde"] == [None, None, None, None, 0]


def test_levels(spark):
    rng = random.Random(4)
    rows = []
    for conv in [*range(30), None]:
        size = rng.randrange(1, 14)
        for k in range(size):
            pool = range(k) if rng.random() < 0.93 else range(size)
            rows.append((conv, f"c{k}", [f"c{n}" for n in pool if rng.random() < 0.3] + ["gone"] * rng.randrange(2)))
    assert levels(spark, rows) == brute(rows)
