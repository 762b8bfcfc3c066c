"""Exact, near and line dedup against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
from data import DOCUMENTS, awkward_rows, random_text
from pyspark.sql import functions as F

from spanlight.llm import exact_dedup, near_dedup
from spanlight.llm.components import connected_components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(65 + k): chr(97 + k) for k in range(26)})


def frame(spark, texts):
    return spark.createDataFrame([(k, t, "en", "a", 0) for k, t in texts], DOCUMENTS)


def brute_exact(rows, keep):
    groups = {}
    for i, text, *_ in rows:
        groups.setdefault((text or "").translate(LOWER), []).append(i)
    out = []
    for text, ids in groups.items():
        best = keep([i for i in ids if i is not None], default=None)
        out += [(i, best, len(ids), i == best, hashlib.sha256(text.encode()).hexdigest()) for i in ids]
    return sorted(out, key=repr)


@pytest.mark.parametrize("keep,pick", [("largest", max), ("smallest", min)])
@pytest.mark.parametrize("digest", [exact_dedup.sha256_hex, lambda c: F.substring(F.sha2(c.cast("binary"), 256), 1, 1)], ids=["sha256", "colliding"])
def test_exact_dedup(spark, keep, pick, digest):
    rows = awkward_rows()
    got = exact_dedup.dedup(spark.createDataFrame(rows, DOCUMENTS), keep, digest).collect()
    assert sorted([tuple(r[c] for c in ("doc_id", "keep_id", "group_size", "kept", "text_sha256")) for r in got], key=repr) == brute_exact(rows, pick)


def test_index_takes_further_runs(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    exact_dedup.flush_runs(frame(spark, [(5, "a"), (6, "b")]), path)
    exact_dedup.flush_runs(frame(spark, [(2, "A"), (9, "c")]), path)
    merged = {r["smallest"]: r["n"] for r in exact_dedup.compact(spark, path).collect()}
    assert merged == {2: 2, 6: 1, 9: 1}


def shingles(text, width):
    words = WORD.findall((text or "").translate(LOWER))
    if not words:
        return set()
    return {tuple(words)} if len(words) < width else {tuple(words[k : k + width]) for k in range(len(words) - width + 1)}


def brute_near(rows, width, percent=80):
    sets = {i: shingles(t, width) for i, t in rows}
    label = {i: i for i in sets}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    ids = sorted(i for i in sets if sets[i])
    for a in ids:
        for b in ids:
            if a < b and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                p, q = sorted((root(a), root(b)))
                label[q] = p
    return sorted((i, len(sets[i]), root(i), root(i) == i) for i in sets)


def families(rng, count, size):
    rows = []
    for _ in range(count):
        words = random_text(rng, rng.randrange(3, 120), 400).split()
        for _ in range(size):
            changed = list(words)
            for _ in range(rng.randrange(0, 1 + len(words) // 8)):
                changed[rng.randrange(len(changed))] = rng.choice(["new", "other", "word"])
            rows.append(" ".join(changed))
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("width", [2, 5])
@pytest.mark.parametrize("block", [500, 3])
def test_near_dedup(spark, width, block):
    rng = random.Random(width)
    rows = families(rng, 12, 14) + [(1000, None), (1001, ""), (1002, "single"), (1003, "Single"), (1004, " \t"), (1005, "a b"), (1006, "A  b")]
    rule = near_dedup.NearRule(words=width, block_docs=block)
    got = near_dedup.near_duplicates(frame(spark, rows), rule).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in got) == brute_near(rows, width)


def test_all_pairs_within_the_guaranteed_distance_meet(spark):
    rule = near_dedup.NearRule()
    rng = np.random.default_rng(3)
    base = rng.integers(0, 65536, rule.size, dtype=np.uint16)
    rows = [(0, base.tobytes())]
    for k in range(1, 200):
        other = base.copy()
        at = rng.permutation(rule.size)[: 2 * rule.chunks - 1]
        other[at] ^= np.uint16(1)
        rows.append((k, other.tobytes()))
    keys = near_dedup.index_entries(spark.createDataFrame(rows, "rep long, signature binary"), rule)
    base_keys = keys.where("rep = 0").select("key")
    assert keys.where("rep > 0").join(base_keys, "key").select("rep").distinct().count() == 199


def test_distance_follows_from_recall():
    assert near_dedup.NearRule().max_distance == 25
    assert near_dedup.NearRule(recall=0.5).max_distance == 10
    assert near_dedup.NearRule(recall=1.0).max_distance == near_dedup.NearRule().size


def test_components(spark):
    rng = random.Random(9)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(k, k + 1) for k in range(500, 620)] + [(700, k) for k in range(701, 780)]
    label = {}

    def root(x):
        while label.setdefault(x, x) != x:
            x = label[x]
        return x

    for a, b in edges:
        if a != b:
            p, q = sorted((root(a), root(b)))
            label[q] = p
    want = {n: root(n) for n in label}
    got = {r["node"]: r["label"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == want
