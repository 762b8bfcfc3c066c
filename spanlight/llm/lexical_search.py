"""Ranked lexical search by sort-based accumulation.

The query items are held in blocks of bounded size. A block's terms are looked up in all texts, which gives postings (document, term,
frequency) by document, and the statistics of the corpus. Scoring takes the postings of a few documents at a time: it concatenates,
for all terms, the arrays of (item, document, impact), radix sorts them by the packed pair of item and document, and
adds up runs with ``reduceat``. Each task keeps a heap of the best documents for each item, and the heaps meet in ranges of items.
"""

from __future__ import annotations

import heapq
import math
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from spanlight.llm.batches import record_batch, slices
from spanlight.llm.common import ship, stash, whole

#: ASCII that is no letter or digit to a space, A-Z to a-z; bytes of other characters stay.
FOLD = bytes(b if b >= 128 or chr(b).isalnum() and not 65 <= b <= 90 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
CUT = re.compile(rb" ")

POSTINGS = "n_docs long, n_terms long, docs array<long>, lengths array<long>, sizes array<int>, terms array<int>, often array<long>"
POSTINGS_ARROW = pa.schema(
    [("n_docs", pa.int64()), ("n_terms", pa.int64()), ("docs", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32())), ("terms", pa.list_(pa.int32())), ("often", pa.list_(pa.int64()))]
)
FREQUENCIES = "term int, df long"
FREQUENCIES_ARROW = pa.schema([("term", pa.int32()), ("df", pa.int64())])
HITS = "item int, item_id long, doc_id long, score long"
HITS_ARROW = pa.schema([("item", pa.int32()), ("item_id", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])


def term_lists(text: bytes, limit: int = 1 << 20) -> Iterator[list[bytes]]:
    """The terms of a text in order; a long text comes in several lists."""
    text, at = text.translate(FOLD), 0
    while at < len(text):
        border = CUT.search(text, at + limit)
        upto = border.start() if border else len(text)
        yield text[at:upto].split()
        at = upto


@dataclass
class ItemBlock:
    """Items by place, the number of each term, and for each term the items that have it with its repeats."""

    item_ids: list[int | None]
    numbers: dict[bytes, int]
    starts: np.ndarray
    items: np.ndarray
    repeats: np.ndarray


def item_block(rows: list[tuple[int | None, bytes]]) -> ItemBlock:
    numbers: dict[bytes, int] = {}
    pairs: dict[tuple[int, int], int] = {}
    for item, (_, text) in enumerate(rows):
        for some in term_lists(text):
            for term in some:
                key = (numbers.setdefault(term, len(numbers)), item)
                pairs[key] = pairs.get(key, 0) + 1
    table = np.array(sorted((t, i, n) for (t, i), n in pairs.items()), np.int64).reshape(-1, 3)
    starts = np.searchsorted(table[:, 0], np.arange(len(numbers) + 1))
    return ItemBlock([i for i, _ in rows], numbers, starts, table[:, 1], table[:, 2])


def postings(docs: DataFrame, block: ItemBlock) -> DataFrame:
    """Postings of the block's terms, a row for each run of documents (doc_id, text binary), with the counts of all their terms."""
    shared = docs.sparkSession.sparkContext.broadcast(block.numbers)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value.get
        for part, texts in slices(batches):
            n_docs = n_terms = 0
            docs, lengths, sizes, terms, often = [], [], [], [], []
            for doc_id, text in zip(part.column(0).to_pylist(), texts, strict=True):
                n, found = 0, []
                for some in term_lists(text):
                    n += len(some)
                    found.append(np.array([t for t in map(known, some) if t is not None], np.int32))
                n_docs, n_terms = n_docs + (n > 0), n_terms + n
                if n and sum(map(len, found)):
                    term, count = np.unique(np.concatenate(found), return_counts=True)
                    docs.append(doc_id)
                    lengths.append(n)
                    sizes.append(len(term))
                    terms.append(term)
                    often.append(count)
            flat = [np.concatenate(x) if x else [] for x in (terms, often)]
            yield record_batch(POSTINGS_ARROW, n_docs=[n_docs], n_terms=[n_terms], docs=[docs], lengths=[lengths], sizes=[sizes], terms=[flat[0]], often=[flat[1]])

    return docs.mapInArrow(run, POSTINGS)


def document_frequencies(found: DataFrame, n_terms: int) -> np.ndarray:
    """In how many documents each term of the block stands; each task adds up its own."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_terms, np.int64)
        for batch in batches:
            total += np.bincount(batch.column(0).flatten().to_numpy(), minlength=n_terms)
        seen = np.flatnonzero(total)
        yield record_batch(FREQUENCIES_ARROW, term=seen, df=total[seen])

    summed = found.select("terms").mapInArrow(run, FREQUENCIES).groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    df = np.zeros(n_terms, np.int64)
    df[summed.column("term").to_numpy()] = summed.column("df").to_numpy()
    return df


@dataclass
class Scoring:
    item_ids: list[int | None]
    starts: np.ndarray
    items: np.ndarray
    repeats: np.ndarray
    weights: np.ndarray
    n_docs: int  # N
    n_terms: int  # L


def radix_order(keys: np.ndarray, most: int) -> np.ndarray:
    """Stable order of keys from 0 to ``most``, sixteen bits a pass."""
    order, shift = np.arange(len(keys)), 0
    while most >> shift:
        order = order[np.argsort(((keys >> shift) & 0xFFFF).astype(np.uint16)[order], kind="stable")]
        shift += 16
    return order


def accumulated(s: Scoring, terms: np.ndarray, owner: np.ndarray, impact: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(item, document, score) of all pairs of a few documents, from their postings."""
    size = s.starts[terms + 1] - s.starts[terms]
    flat = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(s.starts[terms], size)
    keys = s.items[flat] * n_docs + np.repeat(owner, size)
    impacts = s.repeats[flat] * np.repeat(impact, size)
    order = radix_order(keys, len(s.item_ids) * n_docs - 1)
    keys, impacts = keys[order], impacts[order]
    begin = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[begin] // n_docs, keys[begin] % n_docs, np.add.reduceat(impacts, begin)


def best_documents(found: DataFrame, scoring: Scoring, top: int, most: int = 1 << 22) -> DataFrame:
    """(item, item_id, doc_id, score): of each task the ``top`` documents of each item. ``most`` entries are sorted at once."""
    shared = found.sparkSession.sparkContext.broadcast(scoring)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = shared.value
        heaps: list[list[tuple]] = [[] for _ in s.item_ids]
        least = np.ones(len(heaps), np.int64)  # a lower score is no use to the item
        for batch in batches:
            for row in range(batch.num_rows):
                docs = batch.column(0)[row].as_py()
                lengths, sizes, terms, often = (batch.column(k)[row].values.to_numpy() for k in range(1, 5))
                m = np.array([25 + 75 * int(n) * s.n_docs // s.n_terms for n in lengths], np.int64)
                owner = np.repeat(np.arange(len(docs)), sizes)
                impact = s.weights[terms] * ((10**9 * often) // (1000 * often + 8 * m[owner]))
                ends = np.cumsum(sizes)
                work = np.append(0, np.cumsum(s.starts[terms + 1] - s.starts[terms]))[ends] if len(docs) else ends
                at = 0
                while at < len(docs):
                    done = work[at - 1] if at else 0
                    upto = max(at + 1, int(np.searchsorted(work, done + most, "right")))
                    a, b = ends[at - 1] if at else 0, ends[upto - 1]
                    item, doc, score = accumulated(s, terms[a:b], owner[a:b] - at, impact[a:b], upto - at)
                    good = np.flatnonzero(score >= least[item])
                    for i, d, x in zip(item[good].tolist(), doc[good].tolist(), score[good].tolist(), strict=True):
                        heap, doc_id = heaps[i], docs[at + d]
                        entry = (x, doc_id is not None, -(doc_id or 0))
                        if len(heap) < top:
                            heapq.heappush(heap, entry)
                        else:
                            heapq.heappushpop(heap, entry)
                        if len(heap) == top:
                            least[i] = heap[0][0]
                    at = upto
        rows = [(i, s.item_ids[i], -negative if some else None, x) for i, heap in enumerate(heaps) for x, some, negative in heap]
        if rows:
            yield record_batch(HITS_ARROW, **dict(zip(HITS_ARROW.names, map(list, zip(*rows, strict=True)), strict=True)))

    return found.where("size(docs) > 0").select("docs", "lengths", "sizes", "terms", "often").mapInArrow(run, HITS)


def search(docs: DataFrame, items: DataFrame, top: int = 10, block_bytes: int = 4 << 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` documents of each item with a score above 0; equal scores by id, a null id last.

    Null texts have no terms, and count nowhere; an item without terms, or without a match, has no rows. Rows that repeat
    are ranked each, on either side. Empty tables give no rows; other columns are not read. Items come in blocks of
    about ``block_bytes`` of text; the documents are read once for each block, and only a block's own terms, statistics and
    heaps (``top`` for each item) are held in memory.
    """
    spark = docs.sparkSession
    ship(spark)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole(F.col(text_col)).cast("binary").alias("text"))
    asked = items.select(F.col(item_col).cast("long").alias("item_id"), whole(F.col(item_text)).cast("binary").alias("text"))
    size = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = max(1, -(-size // block_bytes))
    found = []
    for k in range(n_blocks):
        rows = asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == k).toArrow()
        block = item_block(sorted(zip(*(c.to_pylist() for c in rows.columns), strict=True), key=lambda r: (r[0] is None, r[0] or 0, r[1])))
        found.append(_ranked(texts, block, top))
    return reduce(DataFrame.unionByName, found)


def _ranked(texts: DataFrame, block: ItemBlock, top: int) -> DataFrame:
    held = stash(postings(texts, block), "postings")
    n_docs, n_terms = held.agg(F.sum("n_docs"), F.sum("n_terms")).first()
    df = document_frequencies(held, len(block.numbers))
    weights = np.array([math.floor(1000 * math.log((2 * (n_docs or 0) + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)
    scoring = Scoring(block.item_ids, block.starts, block.items, block.repeats, weights, n_docs or 0, n_terms or 1)
    hits = stash(best_documents(held, scoring, top), "search-heaps").repartitionByRange("item")
    order = W.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")
