"""Phrase collocations, ranked search and the quality classifier, against brute force."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pytest
from data import DOCUMENTS, awkward, awkward_rows, clashing, empty, random_text
from pyspark.sql import functions as F

from spanlight.llm import collocations, lexical_search, quality_classifier
from spanlight.llm.collocations import PhraseRule

FOLD = str.maketrans({chr(k): chr(k + 32) for k in range(65, 91)})


def brute_phrases(rows, least, top):
    often, n = collections.Counter(), collections.Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(FOLD)):
            words = [w for w in re.split("[ \t]+", piece) if w]
            n[lang] += len(words)
            for size in range(1, 6):
                often.update((lang, *words[k : k + size]) for k in range(len(words) - size + 1))
    often = {g: f for g, f in often.items() if f >= least}
    inside = collections.Counter()
    for (lang, *g), f in often.items():
        for size in range(2, len(g)):
            for k in range(len(g) - size + 1):
                inside[(lang, *g[k : k + size])] = max(inside[(lang, *g[k : k + size])], f)
    found = collections.defaultdict(list)
    for (lang, *g), a in often.items():
        if len(g) > 1 and inside[(lang, *g)] < a:
            cuts = [(1000 * a * n[lang] // (often[(lang, *g[:k])] * often[(lang, *g[k:])]), k) for k in range(1, len(g))]
            score, k = min(cuts)
            found[lang].append((-score, -a, " ".join(g).encode(), often[(lang, *g[:k])], often[(lang, *g[k:])]))
    return {(lang, r, p.decode(), -a, lft, rgt, n[lang], -s) for lang, x in found.items() for r, (s, a, p, lft, rgt) in enumerate(sorted(x)[:top], 1)}


def phrase_rows():
    rng = random.Random(3)
    words = ["the", "of", "Zürich", "new", "york", "times", "a", "b-c", "漢", "x\x01y", " "]
    rows = awkward_rows()
    for k in range(120):
        text = "".join(rng.choice(words[: 3 + k % 9]) + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\x0b"]) for _ in range(60))
        rows.append((1000 + k, text, rng.choice(["en", "en", "de", None, "und"]), "a", 1))
    return rows + rows[-5:]


@pytest.mark.parametrize("rule", [PhraseRule(min_count=5, top=50), PhraseRule(min_count=2, top=10**6, chunk_tokens=90, block_keys=70, range_keys=50, sampled=2000)], ids=["large", "small"])
def test_phrases(spark, rule):
    rows = phrase_rows()
    got = collocations.mine(spark.createDataFrame(rows, DOCUMENTS).repartition(5), rule).collect()
    want = brute_phrases(rows, rule.min_count, rule.top)
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_phrases_of_clashing_and_empty_tables(spark):
    rule = PhraseRule(min_count=3)
    assert sorted(map(tuple, collocations.mine(clashing(spark), rule).collect())) == sorted(map(tuple, collocations.mine(awkward(spark), rule).collect()))
    assert collocations.mine(empty(spark)).count() == 0
    assert collocations.mine(awkward(spark), PhraseRule(min_count=10**9)).count() == 0


def test_scores_past_64_bits(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(1, 10**13), rng.randrange(1, 10**15), rng.randrange(1, 10**13), rng.randrange(1, 10**13)) for _ in range(200)]
    rows = [(min(a, x, y), n, x, y) for a, n, x, y in rows]
    df = spark.createDataFrame(rows, "a long, n long, l long, r long")
    got = df.select("a", "n", "l", "r", collocations.exact_score(F.col("a"), F.col("n"), F.col("l"), F.col("r")).alias("s")).collect()
    assert all(s == 1000 * a * n // (x * y) for a, n, x, y, s in got)


def test_wide_keys_keep_their_order():
    rng = np.random.default_rng(2)
    ids = rng.integers(0, 70_000, 4000) * rng.integers(0, 2, 4000)
    for digits in (2, 3):
        columns, counts = collocations.radix_sorted(collocations.key_columns(ids, collocations.begun(ids), digits), np.ones(len(collocations.begun(ids)), np.int64))
        keys = [r.tobytes() for r in np.ascontiguousarray(columns.T).astype(">u2")]
        want = collections.Counter()
        for at in collocations.begun(ids):
            run = []
            for x in ids[at : at + 5]:
                if not x:
                    break
                run.append(int(x).to_bytes(2 * digits, "big"))
            want[b"".join(run).ljust(10 * digits, b"\0")] += 1
        assert dict(zip(keys, counts.tolist(), strict=True)) == want and keys == sorted(keys)
        assert (collocations.unsqueeze(collocations.squeeze(np.ascontiguousarray(columns.T)), np.uint16, 5 * digits) == columns.T).all()
    assert [collocations.id_digits(n) for n in (0, 65_535, 65_536, 1 << 32)] == [1, 1, 2, 3]


def test_long_texts_come_in_blocks():
    text = random_text(random.Random(4), 5000).replace("a", "A.").encode() + b"x" * 5000
    for size in (7, 100):
        assert [w for some in collocations.tokens(text, size) for w in some] == next(collocations.tokens(text, 1 << 30))
        assert [w for some in lexical_search.term_lists(text, size) for w in some] == next(lexical_search.term_lists(text, 1 << 30))


def brute_search(rows, items, top):
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(FOLD))
    docs = [(i, collections.Counter(w), len(w)) for i, t, *_ in rows if (w := terms(t))]
    n, total = len(docs), sum(x for *_, x in docs)
    df = collections.Counter(t for _, tf, _ in docs for t in tf)
    out = []
    for item, text in items:
        found = []
        for doc_id, tf, size in docs:
            m = 25 + 75 * size * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * tf[t] // (1000 * tf[t] + 8 * m)) for t in terms(text) if tf[t])
            if score > 0:
                found.append((-score, doc_id is None, doc_id))
        out += [(item, r, d, -s) for r, (s, _, d) in enumerate(sorted(found)[:top], 1)]
    return collections.Counter(out)


@pytest.mark.parametrize(("block_bytes", "top"), [(1 << 22, 10), (60, 3)])
def test_search(spark, block_bytes, top):
    rows = phrase_rows()
    items = [(1, "the New york TIMES the"), (2, None), (3, "!!"), (4, "nothing-here 漢 b"), (5, "of of of zürich"), (5, "of of of zürich"), (None, "york"), (7, "one license a a")]
    frame = spark.createDataFrame(items, "item_id long, text string").withColumn("rank", F.lit(1)).withColumn("score", F.lit("x"))
    got = lexical_search.search(spark.createDataFrame(rows, DOCUMENTS).repartition(4).withColumn("item", F.lit(1)), frame, top=top, block_bytes=block_bytes)
    assert collections.Counter(map(tuple, got.collect())) == brute_search(rows, items, top)
    assert got.dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]


def test_search_sorts_few_entries_at_once(spark):
    rows, items = phrase_rows(), [(k, t) for k, t in enumerate(["the of", "new york", "a b c", "times the"])]
    block = lexical_search.item_block([(k, t.encode()) for k, t in items])
    texts = spark.createDataFrame(rows, DOCUMENTS).select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    held = lexical_search.postings(texts, block)
    scoring = lexical_search.Scoring(block.item_ids, block.starts, block.items, block.repeats, np.arange(len(block.numbers)), 100, 5000)
    some, all_ = (sorted(map(tuple, lexical_search.best_documents(held, scoring, 10**6, most=m).collect()), key=repr) for m in (3, 1 << 22))
    assert some == all_ and some


def test_search_of_empty_tables(spark):
    items = spark.createDataFrame([(1, "the")], "item_id long, text string")
    assert lexical_search.search(empty(spark), items).count() == 0
    assert lexical_search.search(awkward(spark), items.limit(0)).count() == 0
    assert sorted(map(tuple, lexical_search.search(clashing(spark), items).collect())) == sorted(map(tuple, lexical_search.search(awkward(spark), items).collect()))


def test_radix_order():
    keys = np.random.default_rng(5).integers(0, 1 << 40, 3000)
    assert (lexical_search.radix_order(keys, (1 << 40) - 1) == np.argsort(keys, kind="stable")).all()


def test_sum_of_squares_identity():
    rule = quality_classifier.QualityRule(buckets=64, rank=3)
    rng = np.random.default_rng(1)
    machine = quality_classifier.Machine(0.3, rng.normal(size=rule.size), rng.normal(size=(rule.size, 3)))
    rows = [quality_classifier.features(t, n, quality_classifier.Buckets(64)) for t, n in ((b"", None), (b"one two two THREE!", 17), (b"a b\nc d\na b", 0))]
    for (cells, values), got in zip(rows, machine.scores(rows), strict=True):
        raw = machine.bias + sum(machine.linear[c] * v for c, v in zip(cells, values, strict=True))
        for i in range(len(cells)):
            for j in range(i):
                raw += machine.factors[cells[i]] @ machine.factors[cells[j]] * values[i] * values[j]
        assert abs(got - 1 / (1 + math.exp(-raw))) < 1e-9


def test_gradients_lower_the_loss_of_pairs_alone():
    """Two features that say nothing alone and all together: only the factors can learn it."""
    rule = quality_classifier.QualityRule(buckets=4, rank=4, epochs=200, shrink=0.0)
    cases = [([], 1), ([0, 1], 1), ([0], 0), ([1], 0)]
    rows = [(np.array([*x, 5]), np.ones(len(x) + 1)) for x, _ in cases] * 20
    machine = quality_classifier.train(rows, np.array([y for _, y in cases] * 20, float), rule)
    assert [s > 0.5 for s in machine.scores(rows[:4])] == [True, True, False, False]


def test_long_text_has_the_features_of_its_blocks():
    text = random_text(random.Random(8), 3000).encode()
    one, many = (quality_classifier.features(text, 5, quality_classifier.Buckets(1 << 10, 50), limit) for limit in (1 << 30, 100))
    assert (one[0] == many[0]).all() and np.allclose(one[1], many[1])


def auc(rows):
    ranked = sorted((s, y) for s, y in rows)
    good = sum(y for _, y in ranked)
    below, wins = 0, 0
    for _, y in ranked:
        wins += below * y
        below += 1 - y
    return wins / (good * (len(ranked) - good))


def test_quality_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    rule = quality_classifier.QualityRule(max_rows=2000)
    machine = quality_classifier.fit(docs, labels, rule)
    rows = quality_classifier.predict(docs, machine, rule).where("held_out").join(labels, "doc_id").select("score", "quality", "predicted").collect()
    assert len(rows) > 500 and auc([(r["score"], r["quality"]) for r in rows]) > 0.97
    assert sum(r["predicted"] == r["quality"] for r in rows) > 0.96 * len(rows)
    again = quality_classifier.fit(docs.repartition(7).drop("lang", "source"), labels.withColumn("toxic", F.lit(0)), rule)
    assert again.bias == machine.bias and (again.factors == machine.factors).all()


def test_quality_of_awkward_tables(spark):
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(4, 40)] + [(None, 1, 0), (5, None, 0), (7, 3, 0), (9, 1, 0), (9, 0, 0)], "doc_id long, quality int, toxic int")
    rule = quality_classifier.QualityRule(max_rows=20, epochs=1)
    machine = quality_classifier.fit(awkward(spark), labels, rule)
    got = quality_classifier.predict(awkward(spark), machine, rule)
    rows = got.collect()
    assert collections.Counter(r["doc_id"] for r in rows) == collections.Counter(i for i, *_ in awkward_rows())
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) and r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert got.dtypes == [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")]
    assert sorted(map(repr, quality_classifier.predict(clashing(spark), machine, rule).collect())) == sorted(map(repr, rows))
    nothing = quality_classifier.fit(empty(spark), labels, rule)
    assert quality_classifier.predict(empty(spark), nothing, rule).count() == 0
    assert {r["score"] for r in quality_classifier.predict(awkward(spark), nothing, rule).collect()} == {0.5}
