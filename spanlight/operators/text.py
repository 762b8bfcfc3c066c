"""Keyword tagging, classification with a fallback, and text kept inside JSON or HTML."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanlight.functions.scalars import braces, confidence, fingerprint, turkish_lower

#: A classifier takes texts and gives (label, confidence) for each; it runs on batches inside tasks.
Classifier = Callable[[pd.Series], pd.DataFrame]


def keyword_tags(docs: DataFrame, keywords: list[tuple[str, str]], text: Column, id_col: str = "id") -> DataFrame:
    """(id, tag, hits): how many keywords of a tag the text contains, as substrings (not words), for tags with any.

    ``keywords`` are (tag, keyword) settings. They become one expression, so the texts are neither exploded nor joined.
    """
    lowered = turkish_lower(F.coalesce(text, F.lit("")))
    tags = list(dict.fromkeys(t for t, _ in keywords))
    counts = [
        F.struct(F.lit(tag).alias("tag"), sum((F.contains(F.col("_text"), turkish_lower(F.lit(k))).cast("int") for t, k in keywords if t == tag), F.lit(0)).cast("long").alias("hits"))
        for tag in tags
    ]
    found = docs.select(F.col(id_col).alias("id"), lowered.alias("_text"))
    return found.select("id", F.explode(F.filter(F.array(*counts), lambda x: x["hits"] > 0)).alias("x")).select("id", "x.tag", "x.hits")


def tag_lists(tagged: DataFrame, order: list[str]) -> DataFrame:
    """(id, tags): tags by hits, most first; ties in the order of the settings."""
    rank = F.array_position(F.array(*[F.lit(t) for t in order]), F.col("tag"))
    listed = F.sort_array(F.collect_list(F.struct((-F.col("hits")).alias("h"), rank.alias("r"), "tag")))
    return tagged.groupBy("id").agg(F.transform(listed, lambda x: x["tag"]).alias("tags"))


def json_part(df: DataFrame, text: str, schema: str, out: str = "parsed") -> DataFrame:
    """The outermost braces of a text, parsed; null where there is none or it does not parse."""
    return df.withColumn(out, F.from_json(braces(text), schema, {"mode": "PERMISSIVE"}))


def keyword_classifier(labels: dict[str, list[str]]) -> Classifier:
    """Deterministic default: the label with most keywords in the text, confidence by its lead; no keyword: null."""

    def classify(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts.fillna("").str.lower():
            hits = sorted(((sum(k in text for k in words), -at, label) for at, (label, words) in enumerate(labels.items())), reverse=True)
            best, second = hits[0], hits[1] if len(hits) > 1 else (0, 0, "")
            rows.append((best[2], 50.0 + 50.0 * (best[0] - second[0]) / best[0]) if best[0] else (None, None))
        return pd.DataFrame(rows, columns=["label", "confidence"])

    return classify


#: Spark's own number of bytes in a batch for Python, and ours: several batches are held at once in each worker.
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "4194304b"


def _through(docs: DataFrame, run: Callable, schema: str) -> DataFrame:
    """Long texts through a Python function; a session with Spark's own number of ``BATCH_BYTES`` goes on with ours, another number stays."""
    name, own, ours = BATCH_BYTES
    if docs.sparkSession.conf.get(name, own) == own:
        docs.sparkSession.conf.set(name, ours)
    return docs.mapInArrow(run, schema)


def _runs(batches: Iterable[pa.RecordBatch], limit: int = 1 << 20) -> Iterator[tuple[pa.Array, pd.Series]]:
    """(ids, texts) of batches with an id and a text, in runs of rows with about ``limit`` bytes of text.

    A batch is large where the session has a number of its own (``BATCH_BYTES``); only one run at a time becomes Python strings. A longer text is a run of its own
    or ends one.
    """
    for batch in batches:
        ids, texts = batch.columns
        size = pa.compute.fill_null(pa.compute.binary_length(texts), 0).to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(np.diff(np.cumsum(size, dtype="int64") // limit)) + 1
        for at, end in zip([0, *cuts], [*cuts, len(size)], strict=True):
            if end > at:
                yield ids.slice(at, end - at), texts.slice(at, end - at).to_pandas()
        del batch, ids, texts
    pa.default_memory_pool().release_unused()  # a Python worker lives on between tasks


def classify(docs: DataFrame, classifier: Classifier, labels: list[str], text_col: str = "text", id_col: str = "id") -> DataFrame:
    """(id, label, confidence): answers outside ``labels`` are null; confidence is a whole number from 0 to 100."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in _runs(batches):
            told = classifier(texts)
            answers = [pa.array(told["label"], pa.string(), from_pandas=True), pa.array(told["confidence"], pa.float64(), from_pandas=True)]
            yield pa.RecordBatch.from_arrays([ids, *answers], names=["id", "label", "confidence"])

    told = _through(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), run, "id long, label string, confidence double")
    known = F.col("label").isin(*labels)
    return told.select("id", F.when(known, F.col("label")).alias("label"), F.when(known, confidence("confidence")).alias("confidence"))


#: A multi-label classifier takes texts and gives, for each, a list of labels (empty: none fits) or None (no answer).
MultiClassifier = Callable[[pd.Series], list[list[str] | None]]


def keyword_multi_classifier(labels: dict[str, list[str]]) -> MultiClassifier:
    """Deterministic default: all labels of which a keyword is in the text, in the order of ``labels``. Turkish lower case.

    One automaton holds the keywords of all labels, so a text is read once, however many there are. It is built once for each task.
    """
    order, built = list(labels), []

    def fold(text: str) -> str:
        return text.replace("İ", "i").replace("I", "ı").lower()

    def classify(texts: pd.Series) -> list[list[str] | None]:
        if not built:
            import ahocorasick

            owners: dict[str, set[int]] = {}
            for at, words in enumerate(labels.values()):
                for word in filter(None, map(fold, words)):
                    owners.setdefault(word, set()).add(at)
            machine = ahocorasick.Automaton()
            for word, found in owners.items():
                machine.add_word(word, found)
            if owners:
                machine.make_automaton()
            built.append(machine if owners else None)
        machine = built[0]
        hits = (set().union(*(found for _, found in machine.iter(fold(t)))) if machine else set() for t in texts.fillna(""))
        return [[order[k] for k in sorted(found)] for found in hits]

    return classify


def classify_many(docs: DataFrame, classifier: MultiClassifier, valid: list[str], text_col: str = "text", id_col: str = "id") -> DataFrame:
    """(id, labels): the classifier's labels in its order, each once, without those that are not in ``valid``.

    An empty list is an answer (none fits); null is no answer, and the row may be asked again. A null text is asked as empty.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in _runs(batches):
            yield pa.RecordBatch.from_arrays([ids, pa.array(classifier(texts), pa.list_(pa.string()))], names=["id", "labels"])

    told = _through(docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")), run, "id long, labels array<string>")
    return told.select("id", F.array_intersect("labels", F.array(*[F.lit(v) for v in valid]).cast("array<string>")).alias("labels"))


def with_fallback(primary: DataFrame, fallback: DataFrame, id_col: str = "id", name: str = "model", fallback_name: str = "keyword") -> DataFrame:
    """(id, label, confidence, method, pending): the primary answer, else the fallback, which stays pending."""
    p = primary.select(id_col, F.col("label").alias("pl"), F.col("confidence").alias("pc"))
    joined = p.join(fallback.select(id_col, F.col("label").alias("fl"), F.col("confidence").alias("fc")), id_col, "left")
    told = F.col("pl").isNotNull()
    return joined.select(
        id_col,
        F.coalesce("pl", "fl").alias("label"),
        F.when(told, F.col("pc")).otherwise(F.col("fc")).alias("confidence"),
        F.when(told, name).otherwise(fallback_name).alias("method"),
        (~told).alias("pending"),
    )


def distribution_fingerprint(distribution: DataFrame, label: str, *numbers: str) -> DataFrame:
    """One row (fingerprint) of a small distribution: ``label:number:…`` for each row, by label."""
    line = F.concat_ws(":", F.col(label), *[F.col(n).cast("string") for n in numbers])
    return distribution.agg(fingerprint(F.sort_array(F.collect_list(line))).alias("fingerprint"))


#: A narrator takes the lines of distributions and gives, for each, a text that uses their numbers only, or None (it failed).
Narrator = Callable[[pd.Series], list[str | None]]


def insights(
    distribution: DataFrame, groups: list[str], label: str, numbers: list[str], cache: DataFrame, now: Column, narrate: Narrator | None = None
) -> DataFrame:
    """(groups, lines, fingerprint, insight, generated_at, from_cache): a text on the distribution of each group.

    ``lines`` are ``label:number:…`` in order, and always there; ``fingerprint`` is theirs. ``cache``: (fingerprint, insight, generated_at,
    expires_at), one row each; an entry counts until its time is past. What has none is given to ``narrate``, each distribution once, however many
    groups have it. Without an answer, or without a narrator, the text is null. A group holds one line for a label, so it is small.
    """
    line = F.concat_ws(":", F.col(label), *[F.col(n).cast("string") for n in numbers])
    told = distribution.groupBy(*groups).agg(F.sort_array(F.collect_list(line)).alias("lines")).withColumn("fingerprint", fingerprint(F.col("lines")))
    live = cache.where(F.col("expires_at") >= now).select("fingerprint", F.col("insight").alias("_kept"), F.col("generated_at").alias("_at"), F.lit(True).alias("_hit"))
    told = told.join(live, "fingerprint", "left")
    if narrate is None:
        told = told.withColumn("_new", F.lit(None).cast("string"))
    else:

        def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                yield pd.DataFrame({"fingerprint": pdf["fingerprint"], "_new": pd.Series(narrate(pdf["lines"]), index=pdf.index, dtype=object)})

        asked = told.where("_hit is null").groupBy("fingerprint").agg(F.any_value("lines").alias("lines"))
        told = told.join(asked.mapInPandas(run, "fingerprint string, _new string"), "fingerprint", "left")
    hit = F.coalesce("_hit", F.lit(False))
    return told.select(
        *groups,
        "lines",
        "fingerprint",
        F.when(hit, F.col("_kept")).otherwise(F.col("_new")).alias("insight"),
        F.when(hit, F.col("_at")).otherwise(now).alias("generated_at"),
        hit.alias("from_cache"),
    )


def remember_insights(cache: DataFrame, told: DataFrame, hours: int = 24) -> DataFrame:
    """The cache after ``insights``: new texts replace entries of their fingerprint, other entries stay; a failure leaves nothing."""
    fresh = told.where(~F.col("from_cache") & F.col("insight").isNotNull()).groupBy("fingerprint").agg(F.min(F.struct("insight", "generated_at")).alias("x"))
    fresh = fresh.select("fingerprint", "x.insight", "x.generated_at", (F.col("x.generated_at") + F.make_dt_interval(hours=F.lit(hours))).alias("expires_at"))
    kept = cache.select("fingerprint", "insight", "generated_at", "expires_at").join(fresh, "fingerprint", "left_anti")
    return kept.unionByName(fresh)


def search(df: DataFrame, query: str, text: str, least: int = 2) -> DataFrame:
    """Rows whose text contains ``query``, in plain lower case; queries shorter than ``least`` find nothing."""
    if len(query.strip()) < least:
        return df.limit(0)
    return df.where(F.contains(F.lower(text), F.lit(query.strip().lower())))
