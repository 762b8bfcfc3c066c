"""Line dedup by winnowing over line hashes.

The lines of a document that are not blank are hashed in order. Of every ``window`` consecutive hashes the smallest is
selected (the last of equal ones), so two equal runs of ``window`` lines always select the same fingerprint. Only selected
minima go into the search, as positions: those whose fingerprint stands at one position alone are dropped, the
others are extended both ways, line by line, until the run is long enough to count. Extended runs
meet by their content, each with the first place that has it (by document, then line); there all but the first go.
A longer run is a chain of such matches that overlap, and it is found whole: every stretch of it that counts
holds a minimum. A fingerprint that stands in a third of all documents makes no pairs, as each position meets one place only.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql import types as T

from spanlight.llm.batches import record_batch, slices
from spanlight.llm.bitmaps import split_by_keys
from spanlight.llm.common import BLANKS, fresh, ship, stash, whole

HASH = 16  # bytes of a line's hash; the first 8 are its fingerprint

LINES = "doc_id long, tag long, hashes binary, words binary, minima array<int>, prints array<long>"
LINES_ARROW = pa.schema(
    [("doc_id", pa.int64()), ("tag", pa.int64()), ("hashes", pa.binary()), ("words", pa.binary()), ("minima", pa.list_(pa.int32())), ("prints", pa.list_(pa.int64()))]
)
RUNS = "doc_id long, tag long, at int, n int, low long, high long"
RUNS_ARROW = pa.schema([("doc_id", pa.int64()), ("tag", pa.int64()), ("at", pa.int32()), ("n", pa.int32()), ("low", pa.int64()), ("high", pa.int64())])


def line_hashes(text: str) -> tuple[bytes, np.ndarray]:
    """Hashes and numbers of words of the lines that are not blank."""
    lines = [line for raw in text.encode().split(b"\n") if (line := raw.strip())]
    return b"".join(map(xxhash.xxh3_128_digest, lines)), np.fromiter((len(line.split()) for line in lines), np.int32, len(lines))


def select_minima(prints: np.ndarray, words: np.ndarray, window: int, long_words: int) -> np.ndarray:
    """Positions of the smallest fingerprint of each window, and of lines that are long enough to be a run alone."""
    chosen = np.flatnonzero(words >= long_words)
    if len(prints) >= window:
        windows = np.lib.stride_tricks.sliding_window_view(prints, window)[:, ::-1]
        chosen = np.concatenate([chosen, np.arange(window - 1, len(prints)) - windows.argmin(axis=1)])
    return np.unique(chosen)


def least_runs(words: np.ndarray, window: int, long_words: int, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs that count and are the shortest that begin, or the shortest that end, at a line."""
    n = len(words)
    upto = np.concatenate([[0], np.cumsum(words, dtype=np.int64)])
    at = np.arange(n + 1)
    is_long = np.flatnonzero(words >= long_words)
    after = np.append(is_long, 2 * n + window)[np.searchsorted(is_long, at[:-1])] + 1  # behind the next long line
    before = np.append(is_long, -1)[np.searchsorted(is_long, at[1:]) - 1]  # the last long line, -1 without one
    end = np.maximum(np.minimum(at[:-1] + window, after), np.searchsorted(upto, upto[:-1] + min_words))
    start = np.minimum(np.maximum(at[1:] - window, before), np.searchsorted(upto, upto[1:] - min_words, "right") - 1)
    starts, ends = np.concatenate([at[:-1], start]), np.concatenate([end, at[1:]])
    fits = (starts >= 0) & (ends <= n)
    both = np.unique(starts[fits] * (n + 1) + ends[fits])
    return both // (n + 1), both % (n + 1)


def line_table(docs: DataFrame, window: int, long_words: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, tag, hashes, words, minima, prints): a row per document that has lines; ``tag`` tells texts of one id apart."""
    ship(docs.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches):
            rows = []
            for text in texts:
                hashes, words = line_hashes(text)
                prints = np.frombuffer(hashes, np.int64)[::2]
                minima = select_minima(prints, words, window, long_words)
                rows.append((hashes, words.tobytes(), minima, prints[minima]))
            columns = dict(zip(LINES_ARROW.names[2:], zip(*rows, strict=True), strict=True))
            yield record_batch(LINES_ARROW, doc_id=part.column(0), tag=part.column(1), **columns)

    text = whole(F.col(text_col))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("tag"), text.alias("text"))
    return rows.mapInArrow(run, LINES).where("size(minima) > 0")


def extended_runs(lines: DataFrame, spots: DataFrame, window: int, long_words: int, min_words: int) -> DataFrame:
    """(doc_id, tag, at, n, low, high): repeated minima ``spots`` (doc_id, tag, spots) extended both ways until the run counts.

    A run is ``n`` lines from the line ``at`` (of those that are not blank) on; ``low`` and ``high`` are 128 bits of its content.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, hashed in slices(batches, "hashes"):
            owner, at, size, keys = [], [], [], []
            for row, (hashes, counts, places) in enumerate(zip(hashed, part.column(3).to_pylist(), part.column(4).to_pylist(), strict=True)):
                words = np.frombuffer(counts, np.int32)
                starts, ends = least_runs(words, window, long_words, min_words)
                marks = np.zeros(len(words) + 1, np.int64)
                marks[np.asarray(places) + 1] = 1
                marks = marks.cumsum()
                held = marks[ends] > marks[starts]
                starts, ends = starts[held], ends[held]
                keys += [xxhash.xxh3_128_digest(hashes[s * HASH : e * HASH]) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
                owner.append(np.full(len(starts), row))
                at.append(starts)
                size.append(ends - starts)
            rows = pa.array(np.concatenate(owner))
            key = np.frombuffer(b"".join(keys), np.int64).reshape(-1, 2)
            yield record_batch(
                RUNS_ARROW, doc_id=part.column(0).take(rows), tag=part.column(1).take(rows), at=np.concatenate(at), n=np.concatenate(size), low=key[:, 0], high=key[:, 1]
            )

    theirs = spots.select(F.col("doc_id").alias("d"), F.col("tag").alias("t"), "spots")
    met = lines.join(theirs.hint("merge"), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("tag") == F.col("t")))
    return met.select("doc_id", "tag", "hashes", "words", "spots").mapInArrow(run, RUNS)


def repeated_runs(docs: DataFrame, window: int = 2, long_words: int = 25, min_words: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, tag, at, n, first_doc, first_tag, first_at): runs that stand earlier too, with the first place that has them.

    ``at`` and ``first_at`` number the lines that are not blank. Of a run that overlaps its own first occurrence only the
    lines behind that are listed.
    """
    lines = stash(line_table(docs, window, long_words, id_col, text_col), "line-hashes")
    minima = lines.select("doc_id", "tag", F.explode(F.arrays_zip("minima", "prints")).alias("m"))
    minima = stash(minima.select("doc_id", "tag", F.col("m.minima").alias("at"), F.col("m.prints").alias("print")), "line-minima")
    # Both sides of the joins are plain shuffles at any size, so that a very frequent line is split over tasks.
    prints = stash(minima.groupBy("print").agg(F.count("*").alias("n")).where("n > 1").select("print"), "line-prints")
    spots = minima.join(prints.hint("merge"), "print", "left_semi").groupBy("doc_id", "tag").agg(F.collect_set("at").alias("spots"))
    runs = stash(extended_runs(lines, spots, window, long_words, min_words), "line-runs")
    place = F.struct("doc_id", "tag", "at")
    first = stash(runs.groupBy("low", "high").agg(F.min(place).alias("first"), F.count("*").alias("copies")).where("copies > 1"), "line-firsts")
    later = runs.join(first.hint("merge"), ["low", "high"]).where(~place.eqNullSafe(F.col("first")))
    shared = F.col("first.at") + F.col("n") - F.col("at")
    own = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("tag") == F.col("first.tag")) & (shared > 0)
    skip = F.when(own, shared).otherwise(0)
    return later.select(
        "doc_id", "tag", (F.col("at") + skip).alias("at"), (F.col("n") - skip).alias("n"), F.col("first.doc_id").alias("first_doc"),
        F.col("first.tag").alias("first_tag"), (F.col("first.at") + skip).alias("first_at"),
    ).distinct()


def longest_runs(runs: DataFrame) -> DataFrame:
    """Matches of ``repeated_runs`` that overlap or touch, with one place each in the same earlier document, as one run.

    Those have one distance between the places, so the runs of a (document, earlier document, distance) are merged in order.
    """
    shift = (F.col("at") - F.col("first_at")).alias("shift")
    on = W.partitionBy("doc_id", "tag", "first_doc", "first_tag", "shift").orderBy("at")
    spans = runs.select("doc_id", "tag", "first_doc", "first_tag", shift, "at", (F.col("at") + F.col("n")).alias("to"))
    reached = F.max("to").over(on.rowsBetween(W.unboundedPreceding, -1))
    begun = spans.withColumn("new", (reached.isNull() | (F.col("at") > reached)).cast("int")).withColumn("run", F.sum("new").over(on))
    merged = begun.groupBy("doc_id", "tag", "first_doc", "first_tag", "shift", "run").agg(F.min("at").alias("at"), F.max("to").alias("to"))
    return merged.select("doc_id", "tag", "at", (F.col("to") - F.col("at")).alias("n"), "first_doc", "first_tag", (F.col("at") - F.col("shift")).alias("first_at"))


def dedup_lines(
    docs: DataFrame,
    window: int = 2,
    long_words: int = 25,
    min_words: int = 10,
    id_col: str = "doc_id",
    text_col: str = "text",
    counts: tuple[str, str] = ("n_lines", "n_deleted"),
) -> DataFrame:
    """The rows of ``docs`` with ``text_col`` rewritten and two columns more (long), named by ``counts``; like-named columns go.

    A line goes if it lies in a run of at least ``window`` lines (a line of ``long_words`` or more words counts as a
    whole run) and ``min_words`` words that stands earlier too: in a document with a smaller id, or higher up in the
    same one. A later run leaves the lines of its first occurrence alone, so a copy of every deleted line stays.
    Null text stays null and counts as one line; blank lines stay. Rows with equal id and text are one occurrence, so none
    of them counts as the later one; different texts of one id are ordered by their hash. Null ids come first. An empty table
    gives no rows. Documents without a deletion are not shuffled.
    """
    key, tag, gone = fresh(docs, "__id", "__tag", "__dead")
    runs = repeated_runs(docs, window, long_words, min_words, id_col, text_col)
    each = F.sequence(F.col("at"), F.col("at") + F.col("n") - 1)
    dead = runs.groupBy("doc_id", "tag").agg(F.array_distinct(F.flatten(F.collect_list(each))).alias("dead"))
    dead = stash(dead.select(F.col("doc_id").alias(key), F.col("tag").alias(tag), F.col("dead").alias(gone)), "line-dead")
    own_id, own_tag = F.col(id_col).cast("long"), F.xxhash64(whole(F.col(text_col)))
    hit, clean = split_by_keys(docs, F.xxhash64(own_id, own_tag), dead.select(F.xxhash64(key, tag)))
    hit = hit.join(dead.hint("merge"), own_id.eqNullSafe(F.col(key)) & (own_tag == F.col(tag)), "left")

    def result(rows: DataFrame, text: Column, deleted: Column) -> DataFrame:
        n_lines = F.coalesce(F.size(F.split(F.col(text_col), "\n", -1)), F.lit(1)).cast("long")
        kept = [text.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns if c not in counts]
        return rows.select(*kept, n_lines.alias(counts[0]), deleted.cast("long").alias(counts[1]))

    changed = result(hit, without_lines(F.col(text_col), F.col(gone)), F.coalesce(F.size(gone), F.lit(0)))
    return changed.unionByName(result(clean, F.col(text_col), F.lit(0)))


@F.pandas_udf(T.StringType())
def without_lines(texts: pd.Series, gone: pd.Series) -> pd.Series:
    """Texts without the lines numbered in ``gone``, which leaves blank lines out of the count; null changes nothing."""

    def rest(text: str, dead: set[int]) -> str:
        kept, k = [], 0
        for line in text.split("\n"):
            if line.strip(BLANKS):
                k += 1
                if k - 1 in dead:
                    continue
            kept.append(line)
        return "\n".join(kept)

    return pd.Series([t if d is None else rest(t, set(d.tolist())) for t, d in zip(texts, gone, strict=True)], dtype=object)
