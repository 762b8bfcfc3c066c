"""Small tables with awkward rows."""

import random

from pyspark.sql import types as T

DOCUMENTS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)
CLASHING = ["kept", "digest", "body", "rep", "key", "host", "words", "n", "bucket", "block", "label", "component_id", "__id", "__dead", "__source", "sha", "score", "size", "print", "at"]


def random_text(rng: random.Random, words: int, vocabulary: int = 40, line: int = 9) -> str:
    parts = []
    for k in range(words):
        parts.append("".join(rng.choice("abcdeéñü") for _ in range(1 + rng.randrange(vocabulary) % 6)))
        parts.append("\n" if k % line == line - 1 else " ")
    return "".join(parts).strip()


def awkward_rows() -> list[tuple]:
    rng = random.Random(5)
    long = random_text(rng, 30_000)
    base = random_text(rng, 60)
    rows = [
        (1, None, None, None, None),
        (2, "", "en", "a", 0),
        (3, " \n\t ", "en", "a", 4),
        (4, base, "en", "a", len(base)),
        (5, base.upper(), None, "a", len(base)),
        (6, base, "en", None, len(base)),
        (6, base, "en", None, len(base)),
        (7, base + " more words here", "de", "b", 9),
        (8, long, "de", "b", len(long)),
        (9, long, "de", "b", len(long)),
        (10, "x" * 200_000, "fr", "b", 200_000),
        (11, "!!! ??? 123", "fr", "c", 11),
        (12, "one", "en", "c", 3),
        (13, "one", "en", "c", 3),
        (None, base, "en", "a", 1),
        (None, None, None, None, None),
        (14, "MIT License, Apache License and the GNU General Public License", "en", "c", 60),
        (15, "the same line stands here twice, and it has many words\n" * 5, "en", "c", 60),
        (16, "İstanbul ΣΑΣ ǅ 漢字 😀 <|endoftext|>   done", "en", "c", 40),
    ]
    rows += [(20 + k, random_text(rng, 30 + k), rng.choice(["en", "de"]), rng.choice("abc"), k) for k in range(30)]
    return rows


def awkward(spark):
    return spark.createDataFrame(awkward_rows(), DOCUMENTS)


def clashing(spark):
    df = awkward(spark)
    for name in CLASHING:
        df = df.withColumn(name, df["source"])
    return df


def empty(spark):
    return spark.createDataFrame([], DOCUMENTS)
