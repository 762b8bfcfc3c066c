"""Host-level quality rules.

Rules are judged per document, their failures are summed per host, each host's failure rates are shrunk
towards a beta prior that is fitted to all hosts, and the hosts' verdicts are joined back to the documents.
Only DataFrame functions are used.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanlight.llm.common import BLANKS, blank_words, stash, whole

SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class HostRules:
    """Limits of the rules and of the host verdict."""

    min_words: int = 10
    max_repeat_percent: int = 20
    max_symbol_percent: int = 25
    max_dup_line_share: int = 2  # a document fails if one line in so many, or more, is a copy
    max_host_rate: float = 0.5  # a host fails if a shrunk failure rate is above this
    min_strength: float = 2.0  # bounds of the prior's pseudo-documents
    max_strength: float = 1000.0

    def failures(self) -> dict[str, Column]:
        return {
            "short": F.col("n_words") < self.min_words,
            "repeats": F.col("n_repeat_words") * 100 > F.col("n_words") * self.max_repeat_percent,
            "symbols": F.col("n_symbols") * 100 > F.col("word_chars") * self.max_symbol_percent,
            "lines": F.col("n_dup_lines") * self.max_dup_line_share > F.col("n_lines"),
        }


def measure(docs: DataFrame, id_col: str = "doc_id", host_col: str = "source", text_col: str = "text", window: int = 5) -> DataFrame:
    """Counts of one document per row: (doc_id, host, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words).

    Repeated windows are found by 64-bit hashes of the window's words inside one row, so no row is exploded
    and no shuffle is needed: an array with only distinct hashes is done at once, else hashes are sorted
    with their places and neighbours are compared. Null text counts as empty; all counts are then 0.
    """
    text = whole(F.col(text_col))
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(host_col).cast("string").alias("host"), text.alias("text"))
    lines = F.filter(F.split("text", "\n", -1), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    split = base.select(
        "doc_id",
        "host",
        F.length(F.translate("text", BLANKS, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        lines.alias("lines"),
        blank_words(F.col("text")).alias("words"),
    )
    hashed = split.select(
        "doc_id",
        "host",
        "word_chars",
        "n_symbols",
        F.size("words").cast("long").alias("n_words"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"),
    )
    kept = ["doc_id", "host", "word_chars", "n_symbols", "n_words", "n_lines", "n_dup_lines"]
    starts = F.sequence(F.lit(0), F.size("hashes") - window)
    grams = hashed.select(
        *kept,
        F.when(F.size("hashes") < window, F.array().cast("array<bigint>"))
        .otherwise(F.transform(starts, lambda i: F.xxhash64(*[F.get("hashes", i + k) for k in range(window)])))
        .alias("grams"),
    )
    placed = grams.select(
        *kept,
        F.when(
            F.size(F.array_distinct("grams")) < F.size("grams"),
            F.sort_array(F.transform("grams", lambda g, i: F.struct(g.alias("g"), i.alias("i")))),
        ).alias("s"),
    )
    again = F.filter("s", lambda x, i: (F.get("s", i - 1)["g"] == x["g"]) | (F.get("s", i + 1)["g"] == x["g"]))
    at = placed.select(*kept, F.sort_array(F.transform(again, lambda x: x["i"])).alias("at"))
    steps = F.transform("at", lambda x, i: F.least(F.lit(window), F.coalesce(F.get("at", i + 1) - x, F.lit(window))))
    covered = F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)
    return at.select(*kept, F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))


def host_verdicts(measured: DataFrame, rules: HostRules) -> DataFrame:
    """(host, n_docs, worst_rate, host_ok): one row per host; a null host is a host of its own.

    The prior of each rule is the beta distribution with the mean and variance of the hosts' own rates
    (method of moments); its strength stays within the rules' bounds. Sums are combined before the
    shuffle, so a host with a third of all documents costs one row per task.
    """
    names = list(rules.failures())
    sums = measured.groupBy("host").agg(
        F.count("*").alias("n_docs"), *[F.sum(bad.cast("long")).alias(name) for name, bad in rules.failures().items()]
    )
    sums = stash(sums, "host-sums")
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("bad")) for n in names])).alias("x")
    rates = sums.select("host", "n_docs", pairs).select("host", "n_docs", "x.rule", "x.bad")
    rate = F.col("bad") / F.col("n_docs")
    moments = rates.groupBy("rule").agg(F.avg(rate).alias("m"), F.var_samp(rate).alias("v"))
    strength = F.when(F.col("v") > 0, F.col("m") * (1 - F.col("m")) / F.col("v") - 1).otherwise(rules.max_strength)
    prior = moments.select(
        "rule", "m", F.greatest(F.lit(rules.min_strength), F.least(F.lit(rules.max_strength), strength)).alias("k")
    )
    shrunk = (F.col("bad") + F.col("m") * F.col("k")) / (F.col("n_docs") + F.col("k"))
    # One row per rule: a bounded table.
    judged = rates.join(F.broadcast(prior), "rule").select("host", "n_docs", shrunk.alias("rate"))
    return judged.groupBy("host").agg(
        F.max("n_docs").alias("n_docs"),
        F.max("rate").alias("worst_rate"),
        (F.max("rate") <= rules.max_host_rate).alias("host_ok"),
    )


def apply_rules(
    docs: DataFrame, rules: HostRules | None = None, id_col: str = "doc_id", host_col: str = "source", text_col: str = "text"
) -> DataFrame:
    """One row per row of ``docs``: the counts, ``base_failed``, ``host_ok``, ``worst_rate`` and ``kept``.

    Null or empty text: counts 0, so ``base_failed``. Null host: judged like any host. Repeated rows are judged
    each. An empty table gives no rows. Other columns of ``docs`` are not read.
    """
    rules = rules or HostRules()
    measured = stash(measure(docs, id_col, host_col, text_col), "quality-counts")
    bad = rules.failures()
    # Written, so that its size is known: it is broadcast if small, else a host with very many documents can be split.
    verdicts = stash(host_verdicts(measured, rules), "host-verdicts").withColumnRenamed("host", "h")
    failed = bad["short"] | bad["repeats"]
    return (
        measured.join(verdicts, measured["host"].eqNullSafe(verdicts["h"]), "left")
        .withColumn("base_failed", failed)
        .withColumn("kept", ~failed & F.col("host_ok"))
        .drop("h")
    )
