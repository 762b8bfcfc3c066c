"""From raw documents to token ids, in five stages."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlight.llm import bpe_codec, language_id, line_dedup, near_dedup, source_mixing
from spanlight.llm.common import BLANKS, fresh, stash
from spanlight.scratch import drop, scratch_path, scratch_scope

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language: no letter at all, or no language that is likelier than all others together.

    Null, empty and blank texts go. Rows that repeat, null ids and further columns stay as they are.
    """
    model = language_id.fit(docs.where(~language_id.held_out(F.col("doc_id"))), PIECES)
    lang, score = fresh(docs, "__lang", "__score")
    told = language_id.add_language(docs, model, PIECES, names=(lang, score))
    return told.where((F.col(lang) != language_id.UNKNOWN) & (F.col(score) > 0.5)).select(docs.columns)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deletes repeated runs of lines; a document of which nothing is left goes.

    A document that loses no line stays as it is, empty or not; so do rows that repeat, which are one occurrence.
    """
    lines, deleted = fresh(docs, "__n_lines", "__n_deleted")
    done = line_dedup.dedup_lines(docs, counts=(lines, deleted))
    done = done.where((F.col(deleted) == 0) | (F.btrim("text", F.lit(BLANKS)) != ""))
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.when(F.col(deleted) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return done.select(docs.columns)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates: five words, similarity 0.8.

    Texts without words and rows with a null id are linked with nothing and stay; rows that repeat stay or go alike.
    """
    judged = near_dedup.near_duplicates(docs, near_dedup.NearRule(words=5, percent=80))
    gone = stash(judged.where("not kept").select("doc_id").distinct(), "near-gone")
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats documents so that the sources come near to equal weights, none more than twice.

    No row goes: texts without tokens and null sources are passed once at least, rows that repeat each for itself.
    """
    return source_mixing.repeat_documents(docs, source_mixing.MixTarget(max_repeats=2.0))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each row; null and empty texts have none."""
    coded = bpe_codec.encode(docs, WORD_BPE)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_stage),
    ("line_dedup", line_stage),
    ("near_dedup", near_stage),
    ("source_mixing", mixing_stage),
    ("bpe_encoding", token_stage),
]

#: Language scores and the seeded order of the mix are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the table ``documents``. Each result is a written table before the next stage reads it; what a stage wrote
    on its way, and the table before, go then."""
    docs, held = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, name)
        with scratch_scope(spark):
            made = stage(spark, docs, sf_dir)
            made.write.parquet(path)
        if held:
            drop(spark, held)
        docs, held = spark.read.schema(made.schema).parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
