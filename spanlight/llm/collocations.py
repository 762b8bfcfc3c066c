"""Phrase collocations by sorting dictionary-encoded n-grams.

Texts are cut once, into chunks of token numbers with a word list of their own. Word counts of all chunks give the dictionary: words
that are frequent in their language, numbered from 1. Each chunk's numbers are exchanged for those of the dictionary;
any other word is 0 and breaks a piece there. From each place on, up to five numbers are packed into one binary key of
fixed width; 0 fills it up. Keys are radix sorted and run-length counted in blocks, dealt out by ranges, and sorted and counted
again in each range, where the runs of all prefixes are the counts of the shorter phrases. Nothing that grows with the rows
is broadcast or held on the driver.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from spanlight.llm.batches import record_batch, slices
from spanlight.llm.common import ship, stash, whole

LONGEST = 5  # words of a phrase

CHUNKS = "chunk long, lang string, n_words long, words array<string>, counts array<long>, places binary"
CHUNKS_ARROW = pa.schema(
    [("chunk", pa.int64()), ("lang", pa.string()), ("n_words", pa.int64()), ("words", pa.list_(pa.string())), ("counts", pa.list_(pa.int64())), ("places", pa.binary())]
)
CODED = "n_keys long, ids binary, sample binary"
CODED_ARROW = pa.schema([("n_keys", pa.int64()), ("ids", pa.binary()), ("sample", pa.binary())])
BLOCKS = "part int, keys binary, counts binary"
BLOCKS_ARROW = pa.schema([("part", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])
GRAMS = "key binary, f long"
GRAMS_ARROW = pa.schema([("key", pa.binary()), ("f", pa.int64())])


@dataclass(frozen=True)
class PhraseRule:
    min_count: int = 100
    top: int = 2000
    chunk_tokens: int = 1 << 18  # tokens of a chunk, unless one text has more
    block_keys: int = 1 << 21  # keys that are sorted at once before they are dealt out
    range_keys: int = 1 << 22  # keys of a range before equal ones are counted together
    sampled: int = 1 << 20  # keys that the borders of the ranges are taken from, at most


# --- tokens -------------------------------------------------------------------------------------------------------------------

#: A-Z to a-z, the tab to a space, and every character that ends a piece to a full stop.
FOLD = bytes(ord(".") if b in b".,;:!?\n\x0b\x0c\r" else ord(" ") if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))
CUT = re.compile(rb"[ .]")


def tokens(text: bytes, limit: int = 1 << 20) -> Iterator[list[bytes]]:
    """The words of a text in order, with ``b"."`` where a piece ends; a long text comes in several lists."""
    text, at = text.translate(FOLD), 0
    while at < len(text):
        border = CUT.search(text, at + limit)
        upto = border.start() if border else len(text)
        yield text[at:upto].replace(b".", b" . ").split()
        at = upto


class Numbers(dict):
    """Numbers the words that it is asked for; 0 is the end of a piece."""

    def __init__(self) -> None:
        super().__init__({b".": 0})

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


def squeeze(values: np.ndarray) -> bytes:
    """Compressed by planes of bytes, as neighbours differ in the low ones only."""
    return zstandard.ZstdCompressor(level=1).compress(values.reshape(len(values), -1).view(np.uint8).T.tobytes())


def unsqueeze(held: bytes, kind: np.dtype, columns: int = 1) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(held), np.uint8).reshape(np.dtype(kind).itemsize * columns, -1)
    return np.ascontiguousarray(planes.T).view(kind)


def chunked(docs: DataFrame, rule: PhraseRule) -> DataFrame:
    """Chunks of texts (lang, text binary) of one language: its words, how often each occurs, and all places as numbers of words."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made = TaskContext.get().partitionId() << 32, 0
        held: dict[str, tuple[Numbers, list[np.ndarray]]] = {}

        def flush() -> pa.RecordBatch:
            nonlocal made
            rows = []
            for lang, (numbers, parts) in held.items():
                places = np.concatenate(parts)
                counts = np.bincount(places, minlength=len(numbers))[1:]
                rows.append((task + made, lang, int(counts.sum()), list(numbers)[1:], counts, squeeze(places)))
                made += 1
            held.clear()
            return record_batch(CHUNKS_ARROW, **dict(zip(CHUNKS_ARROW.names, map(list, zip(*rows, strict=True)), strict=True)))

        size = 0
        for part, texts in slices(batches):
            for lang, text in zip(part.column(0).to_pylist(), texts, strict=True):
                numbers, parts = held.setdefault(lang, (Numbers(), []))
                for some in tokens(text):
                    parts.append(np.fromiter(map(numbers.__getitem__, some), np.int32, len(some)))
                    size += len(some)
                parts.append(np.zeros(1, np.int32))
                if size > rule.chunk_tokens:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    return docs.mapInArrow(run, CHUNKS)


# --- keys ---------------------------------------------------------------------------------------------------------------------


def id_digits(size: int) -> int:
    """Digits of 16 bits that a number up to ``size`` takes."""
    return max(1, -(-size.bit_length() // 16))


def begun(ids: np.ndarray) -> np.ndarray:
    """The places that a phrase of two words or more begins at."""
    return np.flatnonzero((ids[:-1] > 0) & (ids[1:] > 0))


def key_columns(ids: np.ndarray, at: np.ndarray, digits: int) -> np.ndarray:
    """[digit, key]: the numbers from each place ``at`` on up to the end of the piece, five at most."""
    columns, alive = [], np.ones(len(at), bool)
    padded = np.concatenate([ids, np.zeros(LONGEST, ids.dtype)])
    for k in range(LONGEST):
        number = padded[at + k]
        alive = alive & (number > 0)
        number = np.where(alive, number, 0)
        columns += [(number >> (16 * d)).astype(np.uint16) for d in range(digits - 1, -1, -1)]
    return np.stack(columns)


def radix_sorted(columns: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and their counts: a least significant digit radix sort (numpy's stable sort of 16 bits is one), then runs."""
    n = columns.shape[1]
    order = np.arange(n)
    for column in columns[::-1]:
        if n and column.min() != column.max():
            order = order[np.argsort(column[order], kind="stable")]
    columns, counts = columns[:, order], counts[order]
    starts = run_starts(columns)
    return columns[:, starts], np.add.reduceat(counts, starts) if n else counts


def run_starts(columns: np.ndarray) -> np.ndarray:
    new = np.ones(columns.shape[1], bool)
    if len(new):
        new[1:] = (columns[:, 1:] != columns[:, :-1]).any(axis=0)
    return np.flatnonzero(new)


def as_bytes(columns: np.ndarray) -> np.ndarray:
    """Keys as byte strings that order as the keys do; numpy strips zeros at the end, which changes no comparison."""
    rows = np.ascontiguousarray(columns.T).astype(">u2")
    return rows.view(f"S{2 * columns.shape[0]}").ravel()


def dictionary(chunks: DataFrame, rule: PhraseRule) -> tuple[DataFrame, int]:
    """(lang, word, id, f) of the words that are frequent in their language, and how many there are."""
    words = chunks.select("lang", F.explode(F.arrays_zip("words", "counts")).alias("w"))
    often = words.groupBy("lang", F.col("w.words").alias("word")).agg(F.sum("w.counts").alias("f")).where(F.col("f") >= rule.min_count)
    numbered = stash(often.withColumn("at", F.monotonically_increasing_id()), "phrase-words")
    sizes = numbered.groupBy(F.shiftright("at", 33).alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect()  # one row for each file
    before, total = [], 0
    for r in sizes:
        before.append((r["part"], total))
        total += r["n"]
    start = F.broadcast(chunks.sparkSession.createDataFrame(before, "part long, start long"))
    placed = numbered.join(start, F.shiftright("at", 33) == F.col("part"))
    number = F.col("start") + F.col("at").bitwiseAND((1 << 33) - 1) + 1
    return placed.select("lang", "word", number.alias("id"), "f"), total


def coded(chunks: DataFrame, words: DataFrame, digits: int, sampled: int = 256) -> DataFrame:
    """(n_keys, ids, sample): each chunk's places as numbers of the dictionary, and some of its keys, evenly spread."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                local = unsqueeze(batch.column(0)[row].as_py(), np.int32).ravel()
                known = batch.column(1)[row].values
                number = np.zeros(int(local.max()) + 1, np.int64)
                number[known.field("pos").to_numpy() + 1] = known.field("id").to_numpy()
                ids = number[local]
                at = begun(ids)
                keys = key_columns(ids, at[:: max(1, len(at) // sampled)], digits)
                yield record_batch(CODED_ARROW, n_keys=[len(at)], ids=[squeeze(ids)], sample=[np.ascontiguousarray(keys.T).tobytes()])

    listed = chunks.select("chunk", "lang", F.posexplode("words").alias("pos", "word"))
    known = listed.join(words.select("lang", "word", "id"), ["lang", "word"]).groupBy("chunk").agg(F.collect_list(F.struct("pos", "id")).alias("known"))
    return chunks.select("chunk", "places").join(known, "chunk").select("places", "known").mapInArrow(run, CODED)


def borders(codes: DataFrame, digits: int, parts: int, most: int) -> np.ndarray:
    """Where the ranges begin (but for the first), from a bounded sample of keys."""
    chunks = codes.count()
    share = min(1.0, most / 256 / max(1, chunks))
    found = codes.select("sample") if share == 1 else codes.sample(share, seed=11).select("sample")
    rows = [np.frombuffer(b, np.uint16).reshape(-1, LONGEST * digits) for b in found.toArrow().column(0).to_pylist()]
    if parts < 2 or not sum(map(len, rows)):
        return np.zeros(0, f"S{2 * LONGEST * digits}")
    keys = np.sort(as_bytes(np.concatenate(rows).T))
    return np.unique(keys[np.arange(1, parts) * len(keys) // parts])


def dealt(codes: DataFrame, edges: np.ndarray, digits: int, rule: PhraseRule) -> DataFrame:
    """(part, keys, counts): sorted blocks of distinct keys with their counts, cut at the borders of the ranges."""
    shared = codes.sparkSession.sparkContext.broadcast(edges)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            columns = np.concatenate(held, axis=1)
            held.clear()
            columns, counts = radix_sorted(columns, np.ones(columns.shape[1], np.int64))
            cut = np.concatenate([[0], np.searchsorted(as_bytes(columns), shared.value), [len(counts)]])
            full = np.flatnonzero(cut[1:] > cut[:-1])
            rows = np.ascontiguousarray(columns.T)
            return record_batch(
                BLOCKS_ARROW, part=full, keys=[squeeze(rows[cut[p] : cut[p + 1]]) for p in full], counts=[squeeze(counts[cut[p] : cut[p + 1]]) for p in full]
            )

        size = 0
        for batch in batches:
            for ids in batch.column(0):
                ids = unsqueeze(ids.as_py(), np.int64).ravel()
                at = begun(ids)
                for k in range(0, len(at), rule.block_keys):
                    held.append(key_columns(ids, at[k : k + rule.block_keys], digits))
                    size += held[-1].shape[1]
                    if size >= rule.block_keys:
                        yield flush()
                        size = 0
        if size:
            yield flush()

    return codes.select("ids").mapInArrow(run, BLOCKS)


def prefix_counts(columns: np.ndarray, counts: np.ndarray, digits: int, min_count: int) -> Iterator[tuple[list[bytes], np.ndarray]]:
    """Phrases of two to five words in a sorted range, with their counts; rare ones only at the ends, where a neighbour may have more."""
    for n in range(2, LONGEST + 1):
        columns_n = columns[: n * digits]
        starts = run_starts(columns_n)
        sums = np.add.reduceat(counts, starts)
        used = sums >= min_count
        used[[0, -1]] = True
        used &= columns_n[(n - 1) * digits :, starts].any(axis=0)
        rows = np.ascontiguousarray(columns_n[:, starts[used]].T).astype(">u2")
        yield [r.tobytes() for r in rows], sums[used]


def counted(blocks: DataFrame, parts: int, digits: int, rule: PhraseRule) -> DataFrame:
    """(key, f): all phrases that occur often enough. Ranges are disjoint, so only phrases at their ends are summed again."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns, counts = np.zeros((LONGEST * digits, 0), np.uint16), np.zeros(0, np.int64)
        held, size = [(columns, counts)], 0

        def compact() -> None:
            held[:] = [radix_sorted(np.concatenate([c for c, _ in held], axis=1), np.concatenate([n for _, n in held]))]

        for batch in batches:
            for keys, often in zip(batch.column(1), batch.column(2), strict=True):
                held.append((unsqueeze(keys.as_py(), np.uint16, LONGEST * digits).T, unsqueeze(often.as_py(), np.int64).ravel()))
                size += len(held[-1][1])
                if size > 2 * max(rule.range_keys, len(held[0][1])):
                    compact()
                    size = len(held[0][1])
        compact()
        columns, counts = held[0]
        if len(counts):
            for keys, sums in prefix_counts(columns, counts, digits, rule.min_count):
                yield record_batch(GRAMS_ARROW, key=keys, f=sums)

    ranged = blocks.repartitionById(parts, F.col("part")).mapInArrow(run, GRAMS)
    return ranged.groupBy("key").agg(F.sum("f").alias("f")).where(F.col("f") >= rule.min_count)


# --- scores -------------------------------------------------------------------------------------------------------------------


def exact_score(a: Column, n: Column, l: Column, r: Column) -> Column:  # noqa: E741
    """``floor(1000 * a * n / (l * r))`` in decimals of 38 digits."""
    whole_number = lambda c: c.cast("decimal(18,0)")
    return F.call_function("div", (a * 1000).cast("decimal(19,0)") * whole_number(n), whole_number(l) * whole_number(r))


def mine(docs: DataFrame, rule: PhraseRule | None = None, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best phrases of each language.

    Null text is empty, a null language is ``und``. Rows that repeat count each; an empty table or one without a frequent phrase
    gives no rows. Only the two columns are read, so others may have any name. Memory depends on the longest text, on
    ``rule`` and on the keys of one range.
    """
    rule, spark = rule or PhraseRule(), docs.sparkSession
    ship(spark)
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), whole(F.col(text_col)).cast("binary").alias("text"))
    chunks = stash(chunked(texts, rule), "phrase-chunks", "none")
    words, size = dictionary(chunks, rule)
    words, digits = stash(words, "phrase-dictionary"), id_digits(size)
    codes = stash(coded(chunks, words, digits), "phrase-codes", "none")
    total = codes.agg(F.sum("n_keys")).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // rule.range_keys))
    edges = borders(codes, digits, parts, rule.sampled)
    grams = stash(counted(dealt(codes, edges, digits, rule), parts, digits, rule), "phrase-counts")
    return scored(grams, words, chunks.groupBy("lang").agg(F.sum("n_words").alias("n")), 2 * digits, rule)


def scored(grams: DataFrame, words: DataFrame, totals: DataFrame, width: int, rule: PhraseRule) -> DataFrame:
    """Phrases (key, f) with the lowest-scoring cut of each, without those that a longer one stands for.

    A phrase inside a longer one that is as frequent lies in one with a word more that is, so those are all that is looked at.
    """
    size = F.expr(f"CAST(length(key) DIV {width} AS INT)")
    single = words.select(F.unhex(F.lpad(F.hex("id"), 2 * width, "0")).alias("key"), "lang", "word", "f")
    longer = grams.where(size > 2)
    inside = longer.select(F.expr(f"substring(key, 1, length(key) - {width})").alias("key"), "f")
    inside = inside.unionByName(longer.select(F.expr(f"substring(key, {width} + 1)").alias("key"), "f"))
    inside = inside.groupBy("key").agg(F.max("f").alias("outer"))
    open_ = grams.select("key", F.col("f").alias("a")).join(inside, "key", "left").where(F.col("outer").isNull() | (F.col("outer") < F.col("a"))).drop("outer")

    spelt = open_.select("key", F.explode(F.sequence(F.lit(0), size - 1)).alias("at"))
    spelt = spelt.withColumn("w", F.expr(f"substring(key, at * {width} + 1, {width})"))
    spelt = spelt.join(single.select(F.col("key").alias("w"), "lang", "word"), "w").groupBy("key").agg(
        F.first("lang").alias("lang"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase")
    )

    often = grams.unionByName(single.select("key", "f"))
    left, right = often.select(F.col("key").alias("first"), F.col("f").alias("l")), often.select(F.col("key").alias("rest"), F.col("f").alias("r"))
    cuts = open_.select("key", "a", F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cuts = cuts.select("*", F.expr(f"substring(key, 1, k * {width})").alias("first"), F.expr(f"substring(key, k * {width} + 1)").alias("rest"))
    cuts = cuts.join(left, "first").join(right, "rest").join(spelt, "key").join(totals, "lang")
    cuts = cuts.withColumn("score", exact_score(F.col("a"), F.col("n"), F.col("l"), F.col("r")))
    best = cuts.groupBy("lang", "n", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("b")).select("lang", "n", "phrase", "a", "b.*")
    order = W.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    ranked = best.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= rule.top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
