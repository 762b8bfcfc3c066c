"""Near-duplicate documents: MinHash signatures, a multi-index Hamming join, exact confirmation.

A document's word shingles give a signature of 10 chunks of 5 components of 16 bits. Two signatures that differ in d
components share a chunk with at most d / 10 differences, so indexing every chunk with one allowed error finds
all pairs with d <= 19: each chunk is entered five times, each time with another component left out. At the
similarity threshold 0.8 a component differs with probability 0.2, and a pair has no common entry with
probability 0.263 ** 10, below two in a million.

Pairs that share an entry are candidates if their signatures differ in no more components than ``recall`` asks for (25 of
50); a recall of 1 makes every such pair a candidate.

Pairs are never listed within a group. Documents with equal sets are one from the start. In each index entry
every member is compared with the smallest one; entries whose members are not yet in one cluster are compared
in full, inside tasks, on signatures. Links are then confirmed on the shingle sets. A small cluster is compared in full.
In a larger one all members are compared with the smallest first; those linked with it need no comparison among
each other, and the rest meet all members in blocks of bounded size. A task returns no more than a spanning
forest of the confirmed links of its block pair.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanlight.llm.batches import record_batch, slices
from spanlight.llm.bitmaps import split_by_keys
from spanlight.llm.common import ship, stash
from spanlight.llm.components import connected_components

U = np.uint64
MIX1, MIX2 = U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F)


@dataclass(frozen=True)
class NearRule:
    """Two documents are linked if 100 * common shingles >= ``percent`` * all shingles."""

    words: int = 5
    percent: int = 80
    chunks: int = 10
    chunk: int = 5
    recall: float = 0.999998  # of pairs at the similarity itself that share an entry; 1 holds every such pair a candidate
    seed: int = 11
    salts: int = 16
    block_docs: int = 500
    block_shingles: int = 400_000

    @property
    def size(self) -> int:
        return self.chunks * self.chunk

    @property
    def max_distance(self) -> int:
        """Components that may differ in a candidate pair: as few as the recall allows, where each differs by chance alone."""
        differ, kept = 1 - self.percent / 100, 0.0
        if self.recall >= 1:
            return self.size
        for d in range(self.size + 1):
            kept += math.comb(self.size, d) * differ**d * (1 - differ) ** (self.size - d)
            if kept >= self.recall:
                return d
        return self.size

    def multipliers(self) -> np.ndarray:
        return np.random.default_rng(self.seed).integers(1, 2**63, self.size, dtype=np.uint64) * U(2) + U(1)


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """Distinct 64-bit hashes, sorted, of the shingles of a text: A-Z lower-cased, words ``[^\\x20\\x09-\\x0D]+``.

    With fewer words than a shingle has, the whole sequence is the only shingle; without words there is none.
    """
    found = (text or "").encode().lower().split()
    if not found:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))
    width = min(words, len(found))
    count = len(found) - width + 1
    folded = np.full(count, len(found) if width < words else words, np.uint64)
    for k in range(width):
        folded = (folded ^ hashes[k : k + count]) * MIX1
        folded ^= folded >> U(29)
    return np.unique(folded)


def signatures(sets: list[np.ndarray], multipliers: np.ndarray) -> np.ndarray:
    """Signatures (rows) of sets that are not empty: 16 bits of the smallest product for each multiplier."""
    flat = np.concatenate(sets)
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    out = np.empty((len(sets), len(multipliers)), np.uint16)
    for k, a in enumerate(multipliers):
        out[:, k] = (np.minimum.reduceat(flat * a, starts) * MIX2) >> U(48)
    return out


FEATURES = "doc_id long, n_shingles long, digest binary, signature binary"
FEATURES_ARROW = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.binary()), ("signature", pa.binary())])


def features(docs: DataFrame, rule: NearRule, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, digest, signature); digest (128 bits of the set) and signature are null for empty sets."""
    ship(docs.sparkSession)
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        multipliers = rule.multipliers()
        for part, texts in slices(batches):
            sets = [shingle_hashes(t, rule.words) for t in texts]
            full = [s for s in sets if len(s)]
            made = iter(signatures(full, multipliers)) if full else iter(())
            signed = [next(made).tobytes() if len(s) else None for s in sets]
            digests = [set_digest(s) if len(s) else None for s in sets]
            yield record_batch(FEATURES_ARROW, doc_id=part.column(0), n_shingles=[len(s) for s in sets], digest=digests, signature=signed)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, FEATURES)


def set_digest(hashes: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(hashes.tobytes())


KEYS_ARROW = pa.schema([("key", pa.int64()), ("rep", pa.int64())])


def index_entries(reps: DataFrame, rule: NearRule) -> DataFrame:
    """(key, rep): a signature's entry for each chunk and each component of it that is left out."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                signed = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint16).reshape(-1, rule.size).astype(np.uint64)
                ids = np.asarray(part.column(0))
                keys = []
                for c in range(rule.chunks):
                    for left_out in range(rule.chunk):
                        key = np.full(len(signed), c * rule.chunk + left_out, np.uint64) * MIX2
                        for k in range(rule.chunk):
                            if k != left_out:
                                key = (key ^ signed[:, c * rule.chunk + k]) * MIX1
                                key ^= key >> U(31)
                        keys.append(key)
                yield record_batch(KEYS_ARROW, key=np.concatenate(keys).view(np.int64), rep=np.tile(ids, len(keys)))

    return reps.select("rep", "signature").mapInArrow(run, "key long, rep long")


def distance(a: Column, b: Column, rule: NearRule) -> Column:
    """Components in which two signatures differ."""

    @F.pandas_udf("int")
    def differ(x: pd.Series, y: pd.Series) -> pd.Series:
        if not len(x):
            return pd.Series([], dtype="int32")
        p, q = (np.frombuffer(b"".join(s), np.uint16).reshape(-1, rule.size) for s in (x, y))
        return pd.Series((p != q).sum(axis=1).astype(np.int32))

    return differ(a, b)


def salt_of(parts: Column) -> Column:
    """Which of the copies of its group's row (see ``copied``) the member ``rep`` meets."""
    return F.pmod(F.xxhash64("rep"), parts).alias("salt")


def copied(rows: DataFrame, parts: Column) -> DataFrame:
    """Each row ``parts`` times, numbered by ``salt``: a join by group and salt leaves no task with all members of a group."""
    return rows.select("*", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("salt"))


def block_pairs(members: DataFrame, group: str, sizes: DataFrame) -> DataFrame:
    """Copies of ``members`` (group, rep, ...) for each pair of blocks (``bi`` <= ``bj``) that they take part in.

    ``sizes``: (group, blocks), a written table. Members are dealt to blocks by a hash. The pairs are shuffled by group
    and blocks, so a group of any size becomes many tasks.
    """
    dealt = members.join(sizes, group).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other")
    return pair_up(dealt.select("*", other), group, "blocks")


def pair_up(dealt: DataFrame, group: str, *spent: str) -> DataFrame:
    both = dealt.withColumn("bi", F.least("block", "other")).withColumn("bj", F.greatest("block", "other"))
    return both.drop("other", *spent).repartition(group, "bi", "bj")


def pairs_between(blocks: np.ndarray, bi: int, bj: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of the two sides; a pair of one block has all its rows on both."""
    return np.flatnonzero(blocks == bi), np.flatnonzero(blocks == bj)


def forest(a: np.ndarray, b: np.ndarray) -> list[int]:
    """Positions of edges that connect what all edges (a, b) connect, without a cycle."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        return x

    kept = []
    for k, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        p, q = root(x), root(y)
        if p != q:
            parent[p] = q
            kept.append(k)
    return kept


def close_signatures(members: DataFrame, rule: NearRule) -> DataFrame:
    """(a, b): a forest of the pairs within ``max_distance`` in each group of ``members`` (key, rep, signature, label).

    Only pairs with different labels matter.
    """
    sizes = stash(members.groupBy("key").agg(F.ceil(F.count("*") / (2 * rule.block_docs)).alias("blocks")), "near-key-sizes")

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        left, right = pairs_between(pdf["block"].to_numpy(), key[1], key[2])
        signed = np.frombuffer(b"".join(pdf["signature"]), np.uint16).reshape(-1, rule.size)
        labels, reps = pdf["label"].to_numpy(), pdf["rep"].to_numpy()
        a, b = [], []
        for row in left:
            near = (signed[right] != signed[row]).sum(axis=1) <= rule.max_distance
            near &= labels[right] != labels[row]
            b.append(right[near])
            a.append(np.full(len(b[-1]), row))
        a, b = (np.concatenate(x).astype(np.int64) if x else np.empty(0, np.int64) for x in (a, b))
        kept = forest(labels[a], labels[b])
        return pd.DataFrame({"a": reps[a[kept]], "b": reps[b[kept]]})

    return block_pairs(members, "key", sizes).groupBy("key", "bi", "bj").applyInPandas(run, "a long, b long")


def linked_in_block(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, percent: int, width: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row of left, row of right) of sets that reach the similarity, by counting common shingles exactly.

    Shingles that one set has alone are left out; the rest are counted ``width`` at a time with a product of
    0/1 matrices.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, column, seen = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = seen[column] > 1
    owner, column = owner[shared], column[shared]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    _, column = np.unique(column, return_inverse=True)
    common = np.zeros((len(left), len(right)), np.float64)
    total = column[-1] + 1 if len(column) else 0
    for start in range(0, total, width):
        lo, hi = np.searchsorted(column, [start, start + width])
        matrix = np.zeros((len(sets), min(width, total - start)), np.float32)
        matrix[owner[lo:hi], column[lo:hi] - start] = 1
        common += matrix[left] @ matrix[right].T
    union = sizes[left][:, None] + sizes[right][None, :] - common
    x, y = np.nonzero(100 * common >= percent * union)
    return left[x], right[y]


MARKED = "cluster long, blocks long, rep long, n_shingles long, digest binary, text string, core boolean"
MARKED_ARROW = pa.schema(
    [("cluster", pa.int64()), ("blocks", pa.int64()), ("rep", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.binary()), ("text", pa.string()), ("core", pa.bool_())]
)


def with_core(held: DataFrame, rule: NearRule) -> DataFrame:
    """Rows of ``held`` (cluster, blocks, rep, n_shingles, digest, text) and ``core``: linked with the smallest member of the cluster.

    The smallest member has the cluster's label. Its text meets the members in a join, in one copy for each block that the cluster
    fills, so the work and what is written grow with the members only. Rows whose text is not that of the digest go.
    """
    first = held.where("rep = cluster").dropDuplicates(["cluster", "text"])
    first = stash(first.select("cluster", F.col("blocks").alias("parts"), F.col("text").alias("pivot_text"), F.col("digest").alias("pivot_digest")), "near-pivots")
    pivots = copied(first, F.col("parts")).drop("parts")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_pivot: tuple = (None, None)
        for part, texts in slices(batches):
            rows = []
            pivots, pivot_digests, digests = (part.column(part.schema.get_field_index(c)).to_pylist() for c in ("pivot_text", "pivot_digest", "digest"))
            for k, text in enumerate(texts):
                if held_pivot[0] != pivots[k]:
                    held_pivot = (pivots[k], shingle_hashes(pivots[k], rule.words))
                one, other = held_pivot[1], shingle_hashes(text, rule.words)
                if set_digest(one) != pivot_digests[k] or set_digest(other) != digests[k]:
                    rows.append(None)
                    continue
                common = len(np.intersect1d(one, other, assume_unique=True))
                rows.append(100 * common >= rule.percent * (len(one) + len(other) - common))
            kept = part.append_column("core", pa.array(rows, pa.bool_())).filter(pa.array([r is not None for r in rows]))
            yield kept.select(MARKED_ARROW.names).cast(MARKED_ARROW)

    return held.select("*", salt_of(F.col("blocks"))).join(pivots, ["cluster", "salt"]).mapInArrow(run, MARKED)


def confirmed_links(members: DataFrame, docs: DataFrame, rule: NearRule, id_col: str, text_col: str) -> DataFrame:
    """(a, b): a forest of the links in each cluster of ``members`` (cluster, rep, n_shingles, digest), on full sets.

    A cluster that fits one block is compared in full. In a larger one, members linked with the smallest one are its core, which
    needs no comparison within; the others are compared with all members, in pairs of blocks.
    """

    def blocks(some: Column) -> Column:
        """Blocks that the rows of a group with ``some`` need; 0 if there are none."""
        rows, shingles = F.count_if(some), F.sum(F.when(some, F.col("n_shingles")).otherwise(0))
        return F.greatest(F.ceil(rows / rule.block_docs), F.ceil(shingles / rule.block_shingles))

    sizes = stash(members.groupBy("cluster").agg(blocks(F.lit(True)).alias("blocks")), "near-sizes")
    texts = docs.select(F.col(id_col).cast("long").alias("rep"), F.col(text_col).alias("text"))
    salts = F.lit(rule.salts).cast("long")
    sized = members.select("*", salt_of(salts)).join(copied(sizes.where("blocks > 1"), salts), ["cluster", "salt"], "left").drop("salt")
    held = stash(sized.withColumn("blocks", F.coalesce("blocks", F.lit(1).cast("long"))).join(texts, "rep"), "near-texts")

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        sets = [shingle_hashes(t, rule.words) for t in pdf["text"]]
        # An id that stands in several rows brings texts of other sets along; the digest tells.
        right_text = np.array([set_digest(s) == d for s, d in zip(sets, pdf["digest"], strict=True)])
        pdf, sets = pdf[right_text], [s for s, ok in zip(sets, right_text, strict=True) if ok]
        reps = pdf["rep"].to_numpy()
        left, right = pairs_between(pdf["block"].to_numpy(), key[1], key[2])
        if not len(left) or not len(right):
            return pd.DataFrame({"a": reps[:0], "b": reps[:0]})
        x, y = linked_in_block(sets, left, right, rule.percent)
        kept = forest(reps[x], reps[y])
        return pd.DataFrame({"a": reps[x[kept]], "b": reps[y[kept]]})

    columns = ["cluster", "rep", "digest", "text"]
    zero = F.lit(0).cast("long")
    small = held.where("blocks = 1").select(*columns, zero.alias("block"), zero.alias("bi"), zero.alias("bj"))

    marked = stash(with_core(held.where("blocks > 1"), rule), "near-marked")
    needs = F.max("blocks").alias("parts"), blocks(F.col("core")).alias("cores"), blocks(~F.col("core")).alias("others")
    needs = stash(marked.groupBy("cluster").agg(*needs), "near-blocks").where("others > 0")
    dealt = marked.select("*", salt_of(F.col("blocks"))).join(copied(needs, F.col("parts")), ["cluster", "salt"])
    of_hash = lambda n: F.pmod(F.xxhash64("rep"), F.col(n))
    block = F.when(F.col("core"), of_hash("cores")).otherwise(F.col("cores") + of_hash("others"))
    start = F.when(F.col("core"), F.col("cores")).otherwise(0)
    other = F.explode(F.sequence(start, F.col("cores") + F.col("others") - 1)).alias("other")
    large = pair_up(dealt.select(*columns, block.alias("block"), other), "cluster")

    stars = marked.where("core and rep <> cluster").select(F.col("cluster").alias("a"), F.col("rep").alias("b"))
    in_blocks = [pairs.groupBy("cluster", "bi", "bj").applyInPandas(run, "a long, b long") for pairs in (small, large)]
    return stars.unionByName(in_blocks[0]).unionByName(in_blocks[1])


def near_duplicates(docs: DataFrame, rule: NearRule | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id (smallest id reachable over links), kept.

    Null, empty and blank texts have an empty set and are linked with nothing. Rows with a null id are linked with
    nothing, have a null component and are kept. Repeated rows are kept or dropped alike. An empty table gives no rows.
    Other columns of ``docs`` are not read.
    """
    rule = rule or NearRule()
    found = stash(features(docs, rule, id_col, text_col), "near-features")
    usable = found.where(F.col("digest").isNotNull() & F.col("doc_id").isNotNull())
    classes = usable.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.min(F.struct("doc_id", "n_shingles", "signature")).alias("x"))
    classes = stash(classes.select("digest", "rep", "x.n_shingles", "x.signature"), "near-classes")

    entries = stash(index_entries(classes, rule), "near-entries")
    full = entries.groupBy("key").agg(F.min("rep").alias("pivot"), F.count("*").alias("n")).where("n > 1").select("key", "pivot")
    full = stash(full, "near-keys")  # written, so that the join below can split a key with very many entries
    repeated, _ = split_by_keys(entries, F.col("key"), full.select("key"))  # the others need no second shuffle
    members = stash(repeated.join(full, "key"), "near-members")

    signed = classes.select("rep", "signature")
    # A pivot may have very many members, so each of them meets one of several copies of the pivot's signature.
    salts = F.lit(rule.salts).cast("long")
    stars = members.where("rep <> pivot").select("pivot", "rep").distinct().join(signed, "rep").select("*", salt_of(salts))
    pivots = members.select("pivot").distinct().join(signed, F.col("pivot") == F.col("rep"))
    stars = stars.join(copied(pivots.select("pivot", F.col("signature").alias("other")), salts), ["pivot", "salt"])
    stars = stars.withColumn("d", distance(F.col("signature"), F.col("other"), rule)).where(F.col("d") <= rule.max_distance)
    stars = stash(stars.select(F.col("pivot").alias("a"), F.col("rep").alias("b")), "near-stars")

    # Entries whose members the stars have not brought into one cluster.
    labels = stash(connected_components(stars), "near-labels")
    labelled = members.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("key", "rep", F.coalesce("label", "rep").alias("label"))
    mixed = labelled.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("key")
    rest = stash(labelled.join(mixed, "key").join(signed, "rep"), "near-mixed")
    # The labels stand for the stars, as they connect the same; so only what the groups add takes further rounds.
    edges = labels.select(F.col("node").alias("a"), F.col("label").alias("b")).unionByName(close_signatures(rest, rule))
    clusters = connected_components(edges).select(F.col("node").alias("rep"), F.col("label").alias("cluster"))

    clustered = clusters.join(classes.select("rep", "n_shingles", "digest"), "rep")
    links = confirmed_links(clustered, docs, rule, id_col, text_col)
    final = connected_components(links).select(F.col("node").alias("rep"), F.col("label").alias("component"))
    by_class = classes.select("digest", "rep").join(final, "rep", "left").select(F.col("digest").alias("g"), F.coalesce("component", "rep").alias("component"))
    joined = found.join(by_class, F.when(F.col("doc_id").isNotNull(), F.col("digest")) == F.col("g"), "left")
    component = F.coalesce("component", "doc_id")
    return joined.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))
