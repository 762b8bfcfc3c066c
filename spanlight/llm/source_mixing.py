"""Mixing sources to target weights by temperature.

A source with token share p gets a weight in proportion to p ** exponent. The exponent is bisected until the mix meets
a target entropy or a limit on repetition. The weights are then realised within a token budget: a source is
passed over in whole blocks, each a permutation of its documents, and the last block is cut where its
share of the budget ends.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from spanlight.llm.bitmaps import flag_by_keys
from spanlight.llm.common import fresh, stash, whole


@dataclass(frozen=True)
class MixTarget:
    """Give one of the two targets. Without a budget, the smallest one is taken that passes over every source once."""

    max_repeats: float | None = 2.0  # no source is passed over more often; the flattest such mix is taken
    entropy: float | None = None  # in nats; the mix nearest to the sources' own shares with this entropy is taken
    budget_tokens: int | None = None
    seed: int = 29
    probes: int = 16  # exponents tried in one pass over the sources
    rounds: int = 9
    bucket_rows: int = 10_000


def word_count(text: Column) -> Column:
    return F.regexp_count(whole(text), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def numbered(docs: DataFrame, id_col: str, name: str) -> DataFrame:
    """``docs`` with a column ``name`` that tells rows of one id apart: 0 where no other row has the id, else the row's number in the input.

    To be written before use, as numbers hold only then. Repeated ids go into a bounded bitmap: rows that it only suspects have a number
    too, which is right as well; it just ties their place to how the input is split. Only ids are shuffled.
    """
    number = F.monotonically_increasing_id()
    often = docs.select(F.col(id_col).alias("i")).where("i is not null").groupBy("i").count().where("count > 1").select(F.xxhash64("i").alias("h"))
    often = stash(often, "mix-repeated")
    (flag,) = fresh(docs, "__repeated")
    flagged = flag_by_keys(docs, F.xxhash64(F.col(id_col)), often, flag)
    rows = [F.col(f"`{c}`") for c in docs.columns]
    return flagged.select(*rows, F.when(F.col(flag) | F.col(id_col).isNull(), number).otherwise(F.lit(0)).cast("long").alias(name))


def count_tokens(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(doc_id, source, n_tokens, number), to be written before use."""
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("n_tokens"))
    return numbered(slim, "doc_id", "number")


def find_exponent(sources: DataFrame, total: int, target: MixTarget) -> tuple[float, dict[str, float]]:
    """The exponent, and sums that belong to it. ``sources``: (source, tokens, n), with tokens above 0.

    Each round tries several exponents at once, with one aggregate over the sources; only sums come back,
    so the number of sources does not matter. Both measures fall as the exponent rises from 0 to 1.
    """
    p = F.col("tokens") / F.lit(float(total))

    def measure(exponents: list[float]) -> list[dict[str, float]]:
        columns = []
        for k, a in enumerate(exponents):
            columns += [
                F.sum(F.pow(p, F.lit(a))).alias(f"s{k}"),
                F.sum(F.pow(p, F.lit(a)) * F.log(p)).alias(f"l{k}"),
                F.max(F.pow(p, F.lit(a - 1))).alias(f"hi{k}"),
                F.min(F.pow(p, F.lit(a - 1))).alias(f"lo{k}"),
            ]
        row = sources.agg(*columns).first()
        found = []
        for k, a in enumerate(exponents):
            s, hi, lo = row[f"s{k}"], row[f"hi{k}"], row[f"lo{k}"]
            scale = 1 / lo if target.budget_tokens is None else target.budget_tokens / total / s
            found.append({"exponent": a, "sum": s, "entropy": math.log(s) - a * row[f"l{k}"] / s, "repeats": hi * scale, "scale": scale})
        return found

    def good(m: dict[str, float]) -> bool:
        """Monotone: for entropy true at small exponents, for repeats at large ones."""
        return m["entropy"] >= target.entropy if target.entropy is not None else m["repeats"] <= target.max_repeats

    low, high, best = 0.0, 1.0, None
    for _ in range(target.rounds):
        tried = measure([low + (high - low) * k / target.probes for k in range(target.probes + 1)])
        fits = [k for k, m in enumerate(tried) if good(m)]
        if not fits:  # out of reach: the nearest end
            best = tried[0] if target.entropy is not None else tried[-1]
            break
        k = fits[-1] if target.entropy is not None else fits[0]
        best = tried[k]
        low, high = tried[max(0, k - (target.entropy is None))]["exponent"], tried[min(len(tried) - 1, k + (target.entropy is not None))]["exponent"]
        if low == high:
            break
    return best["exponent"], best | {"reached": good(best)}


def source_plan(counted: DataFrame, target: MixTarget) -> DataFrame:
    """(source, tokens, n, reached, weight, epochs, full, rest): passes over each source, whole ones and the tokens of the cut one.

    Sources without any token are passed over once and have weight 0.
    """
    sources = stash(counted.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("n")), "mix-sources")
    total = sources.agg(F.sum("tokens")).first()[0] or 0
    if not total:
        return sources.select("*", F.lit(True).alias("reached"), F.lit(0.0).alias("weight"), F.lit(1.0).alias("epochs"), F.lit(1).cast("long").alias("full"), F.lit(0).cast("long").alias("rest"))
    exponent, found = find_exponent(sources.where("tokens > 0"), total, target)
    p = F.col("tokens") / F.lit(float(total))
    some = F.col("tokens") > 0
    epochs = F.when(some, F.pow(p, F.lit(exponent - 1)) * F.lit(found["scale"])).otherwise(1.0)
    planned = sources.select(
        "*",
        F.lit(found["reached"]).alias("reached"),
        F.when(some, F.pow(p, F.lit(exponent)) / F.lit(found["sum"])).otherwise(0.0).alias("weight"),
        # Nine digits: a pass that is whole but for the last bit of a float counts as whole.
        (F.floor(epochs * 1e9 + 0.5) / 1e9).alias("epochs"),
    )
    full = F.floor("epochs")
    return planned.select("*", full.alias("full"), F.floor((F.col("epochs") - full) * F.col("tokens")).cast("long").alias("rest"))


def order_key(seed: int, block: Column, doc_id: Column, number: Column) -> Column:
    """A place in the permutation of a block, from 0 up to 2 ** 63. The number makes rows of one id, or of none, scatter."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), block, doc_id, number), 1)


def permuted(counted: DataFrame, plan: DataFrame, target: MixTarget) -> DataFrame:
    """(doc_id, source, n_tokens, weight, block, key, number, before, upto): every row in every block of its source.

    ``before`` is the number of earlier documents in the block, ``upto`` the tokens up to and with this one. Running sums go
    over buckets of the key first and then inside each bucket, so that a source with a third of all rows is
    spread over many tasks. Rows with equal keys go by their number, so each has an ``upto`` of its own.
    """
    blocks = F.sequence(F.lit(0).cast("long"), F.col("full") - F.when(F.col("rest") > 0, 0).otherwise(1))
    rows = counted.join(plan.select(F.col("source").alias("s"), "n", "reached", "weight", "full", "rest"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    rows = rows.where("full > 0 or rest > 0").withColumn("block", F.explode(blocks))
    rows = rows.withColumn("key", order_key(target.seed, F.col("block"), F.col("doc_id"), F.col("number")))
    buckets = F.ceil(F.col("n") / target.bucket_rows)
    rows = rows.withColumn("bucket", F.shiftright(F.shiftrightunsigned("key", 32) * buckets, 31))
    group = ["source", "block"]
    sums = rows.groupBy(*group, "bucket").agg(F.count("*").alias("rows"), F.sum("n_tokens").alias("sum"))
    before = W.partitionBy(*group).orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select(
        F.col("source").alias("s"),
        F.col("block").alias("k"),
        F.col("bucket").alias("b"),
        F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows0"),
        F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("sum0"),
    )
    inside = W.partitionBy(*group, "bucket").orderBy("key", "number").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.select("*", F.count("*").over(inside).alias("rn"), F.sum("n_tokens").over(inside).alias("cum"))
    on = F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("k")) & (F.col("bucket") == F.col("b"))
    return rows.join(sums, on).select(
        "doc_id", "source", "n_tokens", "weight", "reached", "full", "rest", "block", "key", "number", (F.col("rows0") + F.col("rn") - 1).alias("before"), (F.col("sum0") + F.col("cum")).alias("upto")
    )


def mix(docs: DataFrame, target: MixTarget | None = None, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """One row for each time a document is passed: doc_id, source, n_tokens, weight, reached, block, position (from 0 in its block).

    ``reached`` is false in all rows if no exponent from 0 to 1 meets the target; the nearest one is taken then. Null text has no tokens; a null source is a source. Rows that repeat, and rows of one id or of a null id, are passed each for itself, and
    a cut pass takes them one by one. An empty table gives no rows. The order depends on the seed and the ids, for rows that share an id also on
    how the input is split.
    """
    target = target or MixTarget()
    counted = stash(count_tokens(docs, id_col, source_col, text_col), "mix-tokens")
    plan = stash(source_plan(counted, target), "mix-plan")
    rows = permuted(counted, plan, target)
    taken = rows.where((F.col("block") < F.col("full")) | (F.col("upto") <= F.col("rest")))
    return taken.select("doc_id", "source", "n_tokens", "weight", "reached", "block", F.col("before").alias("position"))


def repeat_documents(docs: DataFrame, target: MixTarget | None = None, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, each as often as ``mix`` passes it.

    Rows are written once with their number and tokens. A source's cut block ends at one key and number, so the texts meet one row
    per source and are not joined by document.
    """
    target = target or MixTarget()
    source, tokens, number, passing, full, last_key, each = fresh(docs, "__source", "__tokens", "__number", "__passing", "__full", "__cut", "__pass")
    plain = [F.col(f"`{c}`") for c in docs.columns]
    rows = docs.select(*plain, F.col(source_col).cast("string").alias(source), word_count(F.col(text_col)).alias(tokens))
    rows = stash(numbered(rows, id_col, number), "mix-rows", "zstd")
    counted = rows.select(F.col(id_col).alias("doc_id"), F.col(source).alias("source"), F.col(tokens).alias("n_tokens"), F.col(number).alias("number"))
    plan = stash(source_plan(counted, target), "mix-plan")
    cut = permuted(counted, plan, target).where((F.col("block") == F.col("full")) & (F.col("upto") <= F.col("rest")))
    cut = cut.groupBy("source").agg(F.max(F.struct("key", "number")).alias("cut"))
    passes = plan.join(cut.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left")
    passes = stash(passes.select(F.col("source").alias(passing), F.col("full").alias(full), F.col("cut").alias(last_key)), "mix-passes")
    joined = rows.join(passes, F.col(source).eqNullSafe(F.col(passing)))
    own = F.struct(order_key(target.seed, F.col(full), F.col(id_col), F.col(number)).alias("key"), F.col(number).alias("number"))
    last = F.coalesce(own <= F.col(last_key), F.lit(False)).cast("int")
    times = F.array_repeat(F.lit(0), (F.col(full) + last).cast("int"))
    return joined.withColumn(each, F.explode(times)).select(*plain)
