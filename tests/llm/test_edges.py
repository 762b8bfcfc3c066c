"""Every operator and stage on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import collections

import public_tokenizers
import pytest
from data import awkward, awkward_rows, clashing, empty

import corpus_pipeline
from spanlight.llm import bpe_codec, exact_dedup, language_id, license_scan, line_dedup, near_dedup, quality_rules, sharding, source_mixing

PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")

OPERATORS = {
    "quality": quality_rules.apply_rules,
    "license": license_scan.scan,
    "near": near_dedup.near_duplicates,
    "exact": exact_dedup.dedup,
    "mix": source_mixing.mix,
    "repeat": source_mixing.repeat_documents,
    "bpe": lambda d: bpe_codec.digests(d, WORD_BPE),
    "lines": line_dedup.dedup_lines,
    "language": lambda d: language_id.predict(d, language_id.fit(d, PIECES), PIECES),
    "shards": sharding.shuffle_into_shards,
}
ONE_ROW_EACH = set(OPERATORS) - {"mix", "repeat"}


@pytest.mark.parametrize("name", OPERATORS)
def test_awkward_rows(spark, name):
    rows = OPERATORS[name](awkward(spark)).collect()
    want = collections.Counter(r[0] for r in awkward_rows())
    got = collections.Counter(r["doc_id"] for r in rows)
    if name in ONE_ROW_EACH:
        assert got == want
    else:
        assert set(got) == set(want) and all(got[k] >= want[k] for k in want)


@pytest.mark.parametrize("name", OPERATORS)
def test_clashing_columns_do_not_matter(spark, name):
    plain, more = OPERATORS[name](awkward(spark)), OPERATORS[name](clashing(spark))
    shared = [c for c in plain.columns if c in more.columns] if name not in ("repeat", "lines") else ["doc_id", "text"]
    if name == "shards":  # the order is the same, too
        shared = plain.columns
    key = lambda r: tuple(map(repr, r))
    assert sorted(map(key, plain.select(shared).collect())) == sorted(map(key, more.select(shared).collect()))


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name](empty(spark)).collect() == []


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages(spark, name, stage):
    assert stage(spark, empty(spark), "").collect() == []
    for docs in (awkward(spark), clashing(spark)):
        out = stage(spark, docs, "")
        assert out.count() > 0
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
