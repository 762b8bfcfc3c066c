"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

The score is the logistic function of ``w0 + sum w_i x_i + sum over i < j of <v_i, v_j> x_i x_j``. The pairs are not listed: by the identity
``sum over i < j of <v_i, v_j> x_i x_j = 1/2 sum over f of ((sum v_if x_i) ** 2 - sum (v_if x_i) ** 2)`` a text costs as much as it has
features. The model is fitted with AdaGrad on a bounded sample of labelled rows; every text is scored as a whole.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanlight.llm.batches import record_batch, slices
from spanlight.llm.collocations import CUT
from spanlight.llm.common import ship, whole

SAMPLE = "pick long, label int, cells binary, values binary"
SAMPLE_ARROW = pa.schema([("pick", pa.int64()), ("label", pa.int32()), ("cells", pa.binary()), ("values", pa.binary())])
MODEL = "bias double, linear binary, factors binary"
MODEL_ARROW = pa.schema([("bias", pa.float64()), ("linear", pa.binary()), ("factors", pa.binary())])
SCORES = "doc_id long, score double"
SCORES_ARROW = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
CLASSES = {"upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "mark": b".,;:?", "shout": b"!", "symbol": b"#*$%&<>", "bar": b"|", "end": b"\n", "bracket": b"()[]{}", "slash": b"/\\@_=~^`+-", "other": range(192, 256)}
MEMBERS = np.zeros((256, len(CLASSES)))
for _k, _held in enumerate(CLASSES.values()):
    MEMBERS[list(_held), _k] = 1
STATISTICS = len(CLASSES) + 10
SIZES = 40  # one-hot: bits of the number of characters that the metadata tells


@dataclass(frozen=True)
class QualityRule:
    buckets: int = 1 << 15  # of hashed words
    rank: int = 8
    max_rows: int = 8000  # labelled rows that are learned from, at most: a sample by hash of the id
    epochs: int = 6
    batch: int = 64
    rate: float = 0.08
    shrink: float = 2e-5
    seed: int = 7
    threshold: float = 0.3

    @property
    def size(self) -> int:
        return self.buckets + STATISTICS + SIZES


class Buckets(dict):
    """The bucket of a word by checksum; forgets all at a number of words."""

    def __init__(self, buckets: int, memory: int = 200_000):
        super().__init__()
        self.buckets, self.memory = buckets, memory

    def __missing__(self, word: bytes) -> int:
        if len(self) > self.memory:
            self.clear()
        self[word] = found = zlib.crc32(word) % self.buckets
        return found


def features(text: bytes, n_chars: int | None, buckets: Buckets, limit: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Cells and values of a whole text. Word values are damped counts of length 1; statistics lie between 0 and about 1."""
    folded, parts, lengths, at = text.translate(LOWER), [], 0, 0
    while at < len(folded):
        border = CUT.search(folded, at + limit)
        upto = border.start() if border else len(folded)
        words = folded[at:upto].split()
        parts.append(np.fromiter(map(buckets.__getitem__, words), np.int64, len(words)))
        lengths += sum(map(len, words))
        at = upto
    ids = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    n, kinds = len(ids), np.bincount(np.frombuffer(text, np.uint8), minlength=256) @ MEMBERS
    cells, often = np.unique(ids, return_counts=True)
    values = np.log1p(often)
    values /= np.sqrt((values**2).sum()) or 1
    statistics = np.zeros(STATISTICS)
    statistics[: len(CLASSES)] = np.minimum(3 * kinds / max(1, len(text)), 1)
    if n:
        lines = [line for line in text.split(b"\n") if line.strip()]
        pairs = ids[:-1] * buckets.buckets + ids[1:]
        letters = kinds[0] + kinds[1]
        statistics[len(CLASSES) :] = (
            1, len(cells) / n, often.max() / n, (ids[1:] == ids[:-1]).mean() if n > 1 else 0, len(np.unique(pairs)) / max(1, n - 1),
            len(set(lines)) / len(lines), min(1, lengths / n / 15), min(1, np.log1p(n) / 12), kinds[0] / max(1, letters), min(1, (kinds[4] + kinds[5] + kinds[6]) / n),
        )
    seen = np.flatnonzero(statistics)
    told = min(SIZES - 1, (n_chars or 0).bit_length())
    cells = np.concatenate([cells, buckets.buckets + seen, [buckets.buckets + STATISTICS + told]])
    return cells, np.concatenate([values, statistics[seen], [1.0]])


@dataclass
class Machine:
    """The fitted numbers: a bias, a weight for each feature, and ``rank`` factors for each."""

    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def parts(self, cells: np.ndarray, values: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The scores before the logistic function, and the sums ``sum v_if x_i`` of each text."""
        weighted = self.factors[cells] * values[:, None]
        sums = np.add.reduceat(weighted, starts)
        pairs = 0.5 * (sums**2 - np.add.reduceat(weighted**2, starts)).sum(axis=1)
        return self.bias + np.add.reduceat(self.linear[cells] * values, starts) + pairs, sums

    def scores(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        sizes = np.array([len(c) for c, _ in rows])
        raw, _ = self.parts(np.concatenate([c for c, _ in rows]), np.concatenate([v for _, v in rows]), np.cumsum(sizes) - sizes)
        return logistic(raw)


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def train(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, rule: QualityRule) -> Machine:
    """AdaGrad on the logistic loss, in batches of rows in a seeded order."""
    rng = np.random.default_rng(rule.seed)
    share = (labels.sum() + 1) / (len(labels) + 2)
    machine = Machine(float(np.log(share / (1 - share))), np.zeros(rule.size), rng.normal(0, 0.05, (rule.size, rule.rank)))
    seen_linear, seen_factors, seen_bias = np.full(rule.size, 1e-6), np.full((rule.size, rule.rank), 1e-6), 1e-6
    for _ in range(rule.epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(rows), rule.batch):
            some = order[at : at + rule.batch]
            sizes = np.array([len(rows[k][0]) for k in some])
            cells, values = np.concatenate([rows[k][0] for k in some]), np.concatenate([rows[k][1] for k in some])
            raw, sums = machine.parts(cells, values, np.cumsum(sizes) - sizes)
            owner = np.repeat(np.arange(len(some)), sizes)
            miss = (logistic(raw) - labels[some]) / len(some)
            used, place = np.unique(cells, return_inverse=True)
            linear = np.bincount(place, miss[owner] * values, len(used)) + rule.shrink * machine.linear[used]
            each = (miss[owner] * values)[:, None] * (sums[owner] - machine.factors[cells] * values[:, None])
            factors = np.stack([np.bincount(place, each[:, f], len(used)) for f in range(rule.rank)], axis=1) + rule.shrink * machine.factors[used]
            bias = miss.sum()
            seen_bias += bias**2
            seen_linear[used] += linear**2
            seen_factors[used] += factors**2
            machine.bias -= rule.rate * bias / np.sqrt(seen_bias)
            machine.linear[used] -= rule.rate * linear / np.sqrt(seen_linear[used])
            machine.factors[used] -= rule.rate * factors / np.sqrt(seen_factors[used])
    return machine


def held_out(doc_id: Column) -> Column:
    """Whether a document belongs to the fifth that nothing is learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _inputs(docs: DataFrame, id_col: str, text_col: str, chars_col: str) -> DataFrame:
    text = whole(F.col(text_col))
    chars = F.coalesce(F.col(chars_col).cast("long"), F.length(text)) if chars_col in docs.columns else F.length(text)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text.cast("binary").alias("text"), chars.cast("long").alias("chars"))


def fit(docs: DataFrame, labels: DataFrame, rule: QualityRule | None = None, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars", label_col: str = "quality") -> Machine:
    """Learn from at most ``rule.max_rows`` labelled documents that are not held out; several labels of one id: the smallest.

    The sample is of bounded size, so it may be broadcast and learned from in one task. Without any row, the bias is 0.
    """
    rule, spark = rule or QualityRule(), docs.sparkSession
    ship(spark)
    usable = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    chosen = usable.groupBy(F.col(id_col).cast("long").alias("id")).agg(F.min(F.col(label_col).cast("int")).alias("label"))
    chosen = chosen.withColumn("pick", F.xxhash64(F.lit(rule.seed), "id")).orderBy("pick", "id").limit(rule.max_rows)

    def cells(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = Buckets(rule.buckets)
        for part, texts in slices(batches):
            rows = [features(t, c, buckets) for t, c in zip(texts, part.column(2).to_pylist(), strict=True)]
            packed = {"cells": [c.astype(np.int32).tobytes() for c, _ in rows], "values": [v.tobytes() for _, v in rows]}
            yield record_batch(SAMPLE_ARROW, pick=part.column(0), label=part.column(3), **packed)

    def learn(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = sorted((r["pick"], r["cells"], r["values"], r["label"]) for b in batches for r in b.to_pylist())
        rows = [(np.frombuffer(c, np.int32), np.frombuffer(v)) for _, c, v, _ in held]
        if not rows:
            return
        m = train(rows, np.array([y for *_, y in held], float), rule)
        yield record_batch(MODEL_ARROW, bias=[m.bias], linear=[m.linear.tobytes()], factors=[m.factors.tobytes()])

    sample = _inputs(docs, id_col, text_col, chars_col).join(F.broadcast(chosen), F.col("doc_id") == F.col("id"))
    sample = sample.select("pick", "text", "chars", "label").mapInArrow(cells, SAMPLE)
    sample = sample.groupBy("pick").agg(F.min(F.struct("label", "cells", "values")).alias("r")).select("pick", "r.*")  # one row for each id
    found = sample.repartition(1).mapInArrow(learn, MODEL).first()
    if found is None:
        return Machine(0.0, np.zeros(rule.size), np.zeros((rule.size, rule.rank)))
    return Machine(found["bias"], np.frombuffer(found["linear"]), np.frombuffer(found["factors"]).reshape(rule.size, rule.rank))


def predict(docs: DataFrame, machine: Machine, rule: QualityRule | None = None, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs``, in one pass without a shuffle.

    Null and empty texts have only the bias and the size from the metadata. A missing or null number of characters is counted from the text.
    Repeated rows score alike; an empty table gives no rows; columns beside id, text and number of characters are not read.
    """
    rule, spark = rule or QualityRule(), docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(machine)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = Buckets(rule.buckets)
        for part, texts in slices(batches):
            rows = [features(t, c, buckets) for t, c in zip(texts, part.column(2).to_pylist(), strict=True)]
            yield record_batch(SCORES_ARROW, doc_id=part.column(0), score=shared.value.scores(rows))

    scored = _inputs(docs, id_col, text_col, chars_col).mapInArrow(run, SCORES)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= rule.threshold).cast("int").alias("predicted"))
