"""Sharding, mixing, chat formatting, and the whole pipeline."""

import collections
import json
import math
import random
import zlib

import public_tokenizers
import pytest
from data import DOCUMENTS, awkward_rows, random_text
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from spanlight.llm import chat_format, sharding, source_mixing


def documents(spark, rows):
    return spark.createDataFrame(rows, DOCUMENTS)


@pytest.mark.parametrize("bucket_bytes", [64 << 20, 2000])
def test_sharding(spark, bucket_bytes):
    rows = [r for r in awkward_rows() if r[0] is not None]
    placed = sharding.shuffle_into_shards(documents(spark, rows), n_shards=5, bucket_bytes=bucket_bytes)
    got = placed.collect()
    assert collections.Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == collections.Counter(
        (i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, *_ in rows
    )
    slots = collections.defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = [len(slots[k]) for k in range(5)]
    assert max(sizes) - min(sizes) <= 1
    assert sorted(map(tuple, placed.collect()), key=repr) == sorted(map(tuple, got), key=repr)
    other = sharding.shuffle_into_shards(documents(spark, rows), n_shards=5, bucket_bytes=bucket_bytes, seed=4).collect()
    assert {(r["doc_id"], r["shard"], r["slot"]) for r in other} != {(r["doc_id"], r["shard"], r["slot"]) for r in got}


def test_offsets_over_groups(spark):
    counts = spark.createDataFrame([(k, k % 7 + 1) for k in range(500)], "bucket long, n long")
    got = {r["bucket"]: r["offset"] for r in sharding.bucket_offsets(counts, group=16).collect()}
    at, want = 0, {}
    for k in range(500):
        want[k] = at
        at += k % 7 + 1
    assert got == want


def test_shards_are_written_with_their_texts(spark, tmp_path):
    rows = [(k, f"text {k}", "en", "a", 0) for k in range(50)]
    placed = sharding.shuffle_into_shards(documents(spark, rows), n_shards=4, carry=("text",))
    sharding.write_shards(placed, f"{tmp_path}/shards")
    back = spark.read.parquet(f"{tmp_path}/shards")
    assert {(r["doc_id"], r["text"]) for r in back.collect()} == {(k, f"text {k}") for k in range(50)}


def mixed_rows(seed=1):
    rng = random.Random(seed)
    rows = []
    for source, n in (("big", 240), ("mid", 60), ("small", 20), (None, 8)):
        rows += [(len(rows) + k, random_text(rng, rng.randrange(1, 30)), "en", source, 0) for k in range(n)]
    return rows + [(900, "", "en", "silent", 0), (901, None, "en", "silent", 0)]


def brute_weights(tokens, exponent):
    total = sum(tokens.values())
    raw = {s: (t / total) ** exponent for s, t in tokens.items() if t}
    return {s: w / sum(raw.values()) for s, w in raw.items()}


def entropy(weights):
    return -sum(w * math.log(w) for w in weights.values())


@pytest.mark.parametrize(
    "target",
    [source_mixing.MixTarget(max_repeats=2.5, bucket_rows=7), source_mixing.MixTarget(entropy=1.2, budget_tokens=2500, bucket_rows=7), source_mixing.MixTarget(max_repeats=50.0)],
    ids=["repeats", "entropy", "free"],
)
def test_mixing(spark, target):
    rows = mixed_rows()
    docs = documents(spark, rows)
    got = source_mixing.mix(docs, target).collect()
    size = {i: len((t or "").split()) for i, t, *_ in rows}
    tokens = collections.Counter()
    for i, _, _, s, _ in rows:
        tokens[s] += size[i]
    weights = {r["source"]: r["weight"] for r in got if r["source"] != "silent"}
    low, high = 0.0, 1.0
    for _ in range(80):
        mid = (low + high) / 2
        w = brute_weights(tokens, mid)
        if target.entropy:
            low, high = (mid, high) if entropy(w) >= target.entropy else (low, mid)
        else:
            epochs = {s: w[s] / tokens[s] for s in w}
            low, high = (low, mid) if max(epochs.values()) / min(epochs.values()) <= target.max_repeats else (mid, high)
    want = brute_weights(tokens, low if target.entropy else high)
    assert weights.keys() == want.keys() and all(abs(weights[s] - want[s]) < 1e-6 for s in want)
    share = {s: want[s] / tokens[s] for s in want}
    scale = target.budget_tokens or 1 / min(share.values())
    passes = collections.defaultdict(lambda: collections.defaultdict(list))
    for r in got:
        passes[r["source"]][r["block"]].append(r)
    for source, blocks in passes.items():
        ids = sorted(i for i, _, _, s, _ in rows if s == source)
        epochs = 1.0 if source == "silent" else share[source] * scale
        whole = math.floor(epochs + 1e-6)
        for block, part in blocks.items():
            assert len({r["doc_id"] for r in part}) == len(part) and sorted(r["position"] for r in part) == list(range(len(part)))
            if block < whole:
                assert sorted(r["doc_id"] for r in part) == ids
            else:
                rest = (epochs - whole) * tokens[source]
                used = sum(r["n_tokens"] for r in part)
                assert block == whole and used <= rest + 1e-3 and used + 30 > rest - 1e-3
        orders = [[r["doc_id"] for r in sorted(p, key=lambda r: r["position"])] for p in blocks.values()]
        assert len(ids) < 5 or all(o != ids for o in orders)
    again = collections.Counter(r["doc_id"] for r in source_mixing.repeat_documents(docs, target).collect())
    assert again == collections.Counter(r["doc_id"] for r in got)


@pytest.mark.parametrize(
    "target,reached",
    [(source_mixing.MixTarget(max_repeats=50.0), True), (source_mixing.MixTarget(max_repeats=2.0, budget_tokens=10**6), False), (source_mixing.MixTarget(entropy=9.0), False), (source_mixing.MixTarget(entropy=0.5), True)],
)
def test_targets_out_of_reach_are_told(spark, target, reached):
    plan = source_mixing.source_plan(source_mixing.count_tokens(documents(spark, mixed_rows())), target)
    assert {r["reached"] for r in plan.select("reached").collect()} == {reached}


CHAT = "conv_id long, turn long, role string, text string"


def test_chat_formatting(spark):
    tools = chat_format.TOOLS | {"find": {"q": chat_format.Param("STRING"), "top": chat_format.Param("BIGINT", required=False)}}
    call = lambda i, name, args, after=(): json.dumps({"call_id": i, "name": name, "arguments": args, "after": list(after)})
    rows = [
        (1, 0, "system", "be brief"),
        (1, 1, "user", "hi \"you\"\n"),
        (1, 2, "assistant", "hello"),
        (1, 3, "assistant", call("c", "find", {"top": 3, "q": "x"}, ["b"])),
        (1, 4, "assistant", call("a", "find", {"q": 5})),
        (1, 5, "assistant", call("b", "find", {"q": "y", "z": 1}, ["a", "gone"])),
        (1, 6, "tool", json.dumps({"call_id": "a", "content": "A"})),
        (1, 7, "tool", json.dumps({"call_id": "zz", "content": "nobody asked"})),
        (1, 8, "assistant", call("l1", "nope", {}, ["l2"])),
        (1, 9, "assistant", call("l2", "find", {}, ["l1"])),
        (2, 0, "user", "alone"),
        (2, 0, "user", "alone"),
        (None, None, None, None),
        (3, 1, "user", None),
        (3, 2, "assistant", "{not json"),
    ]
    got = {(r["conv_id"], r["call_id"], r["status"]): r for r in chat_format.format_chats(spark.createDataFrame(rows, CHAT), tools).collect()}
    one = {k[1]: v for k, v in got.items() if k[0] == 1 and k[2] != "context"}
    assert [one[i]["level"] for i in ("a", "b", "c", "l1", "l2", "1")] == [0, 1, 2, None, None, 0]
    assert [one[i]["args_valid"] for i in ("a", "b", "c", "l1", "l2", "1")] == [False, False, True, False, False, True]
    assert one["a"]["status"] == "linked" and one["b"]["status"] == "unanswered" and one["zz"]["status"] == "orphan"
    assert one["c"]["message"] == '{"arguments":{"q":"x","top":3},"call_id":"c","name":"find"}'
    assert json.loads(one["1"]["message"]) == {"arguments": {"prompt": 'hi "you"\n'}, "call_id": "1", "name": "reply", "result": "hello"}
    assert got[(2, "0", "unanswered")]["n_calls"] == 2
    assert json.loads(got[(3, "1", "linked")]["message"])["result"] == "{not json"
    assert got[(None, "", "context")]["n_calls"] == 1


def test_identifiers_and_turns_are_two_name_spaces(spark):
    call = json.dumps({"call_id": "3", "name": "find", "arguments": {}, "after": ["1"]})
    rows = [(1, 3, "user", "hi"), (1, 4, "assistant", "hello"), (1, 5, "assistant", call), (1, 6, "tool", json.dumps({"call_id": "3", "content": "found"})), (1, 1, "user", "first")]
    got = sorted((r["call_id"], r["status"], r["n_calls"], r["level"], json.loads(r["message"]).get("result")) for r in chat_format.format_chats(spark.createDataFrame(rows, CHAT)).collect())
    assert got == [("1", "unanswered", 1, 0, None), ("3", "linked", 1, 0, "found"), ("3", "linked", 1, 1, "hello")]


def test_prompts_against_the_schema(spark):
    texts = ["", None, "x", "é" * 300, "é" * 301, "y" * 2_000_000]
    rows = [(k, 0, "user", t) for k, t in enumerate(texts)]
    got = {r["conv_id"]: (r["args_valid"], json.loads(r["message"])["arguments"]["prompt"]) for r in chat_format.format_chats(spark.createDataFrame(rows, CHAT)).collect()}
    assert got == {k: (1 <= len(t or "") <= 300, t or "") for k, t in enumerate(texts)}


def test_chats_with_awkward_rows(spark):
    rows = [(None, None, None, None), (None, None, "user", "u"), (None, None, "user", "u"), (None, None, "assistant", "a"), (1, None, "tool", "{"), (1, 2, "assistant", '{"call_id": null}')]
    plain = spark.createDataFrame(rows, CHAT)
    extra = plain
    for name in ("key", "level", "call_id", "after", "n", "message", "c", "r", "status"):
        extra = extra.withColumn(name, extra["role"])
    key = lambda df: sorted(map(repr, chat_format.format_chats(df).collect()))
    assert key(plain) == key(extra)
    got = collections.Counter((r["conv_id"], r["status"], r["n_calls"], r["n_results"]) for r in chat_format.format_chats(plain).collect())
    assert got == {(None, "context", 1, 0): 1, (None, "linked", 2, 1): 1, (1, "context", 1, 0): 1, (1, "orphan", 0, 1): 1}


def test_chat_formatting_of_nothing(spark):
    assert chat_format.format_chats(spark.createDataFrame([], CHAT)).collect() == []


def test_pipeline(spark, tmp_path):
    """Each stage against what it should do to its own input."""
    rng = random.Random(8)
    words = {"en": "the and with from that this house goes there again", "de": "der und mit von dass dieses haus geht dort wieder"}
    rows = []
    for k in range(80):
        lang = rng.choice(list(words))
        rows.append((k, "\n".join(" ".join(rng.choices(words[lang].split(), k=12)) + f" w{k}x{n}" for n in range(4)), lang, "a" if k % 3 else "b", 0))
    rows += [(200, "123 456", "en", "a", 7), (201, None, "en", "a", 0), (202, rows[5][1], "en", "a", 0), (203, rows[6][1].replace("\n", " "), "en", "b", 0), (204, rows[6][1].replace("\n", " ") + " end", "en", "b", 0)]
    documents(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    docs = documents(spark, rows)
    known = stages["language_id"](spark, docs, str(tmp_path))
    ids = lambda d: sorted(r["doc_id"] for r in d.select("doc_id").collect())
    assert ids(known) == [*range(80), 202, 203, 204]
    lines = stages["line_dedup"](spark, known, str(tmp_path))
    assert ids(lines) == [*range(80), 203, 204]
    near = stages["near_dedup"](spark, lines, str(tmp_path))
    assert 6 in ids(near) and not {203, 204} & set(ids(near)) and len(ids(near)) == 80
    mixed = collections.Counter(ids(stages["source_mixing"](spark, near, str(tmp_path))))
    assert mixed.keys() == set(range(80)) and set(mixed.values()) <= {1, 2} and 2 in mixed.values()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = {r["doc_id"]: r["text"] for r in near.collect()}
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert collections.Counter(r["doc_id"] for r in out) == mixed
    assert all(r["ids"] == tokenizer.encode(texts[r["doc_id"]], add_special_tokens=False).ids and r["n_tokens"] == len(r["ids"]) for r in out)


@pytest.mark.parametrize("ids", ["unique", "null", "one"])
def test_a_cut_pass_takes_rows_one_by_one(spark, ids):
    """Rows without an id, or all of one id, are cut like any others: within one document of the plan, over many buckets."""
    each = {"unique": F.col("id"), "null": F.lit(None).cast("long"), "one": F.lit(7)}[ids]
    text = F.when(F.col("id") % 4 == 0, "a b c d").otherwise("a b")
    docs = spark.range(6000).select(each.alias("doc_id"), F.when(F.col("id") % 3 == 0, "small").otherwise("large").alias("source"), text.alias("text"))
    target = source_mixing.MixTarget(entropy=0.65, budget_tokens=9000, bucket_rows=100)
    rows = source_mixing.mix(docs, target)
    got = {r["source"]: r for r in rows.groupBy("source").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("n"), F.max("weight").alias("w"), F.max("position").alias("last")).collect()}
    assert set(got) == {"small", "large"} and all(abs(r["t"] - r["w"] * 9000) <= 5 and r["last"] == r["n"] - 1 for r in got.values())
    assert rows.where("position >= 0").groupBy("source", "block", "position").count().where("count > 1").count() == 0
    again = source_mixing.repeat_documents(docs, target).groupBy("source").agg(F.sum(F.size(F.split("text", " "))).alias("t"), F.count("*").alias("n"))
    assert {(r["source"], r["t"], r["n"]) for r in again.collect()} == {(s, r["t"], r["n"]) for s, r in got.items()}


def test_half_a_budget_of_one_id_is_half_its_rows(spark):
    docs = spark.range(40_000).select(F.lit(1).alias("doc_id"), F.lit("s").alias("source"), F.lit("one two three").alias("text"))
    target = source_mixing.MixTarget(budget_tokens=60_000, bucket_rows=1000)
    assert source_mixing.mix(docs, target).count() == 20_000
    counted = source_mixing.stash(source_mixing.count_tokens(docs), "test-tokens")
    rows = source_mixing.permuted(counted, source_mixing.source_plan(counted, target), target)
    buckets = rows.groupBy(F.floor(F.col("before") / 1000)).count()
    assert rows.count() == 40_000 and buckets.count() == 40
    assert rows.groupBy(F.shiftright(F.shiftrightunsigned("key", 32) * 40, 31)).count().agg(F.max("count")).first()[0] < 2000
