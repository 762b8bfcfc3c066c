"""What the operators of this subpackage share: shipping code, names and word rules."""

from __future__ import annotations

import string
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlight.scratch import scratch_path, stash  # noqa: F401

#: White space of the word rule ``[^\x20\x09-\x0D]+``.
BLANKS = " \t\n\x0b\x0c\r"
BLANK_RUN = r"[\x20\x09-\x0D]+"


#: Settings for tables of long texts, each with Spark's own value. A batch is held on both sides of a Python task, and the reader's
#: batch of texts is one array, which grows by doubling in the JVM's heap: both were the larger part of an executor's memory.
TEXT_SETTINGS = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "1000"),
    "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "4194304b"),
    "spark.sql.parquet.columnarReaderBatchSize": ("4096", "256"),
}


def ship(spark: SparkSession) -> None:
    """Give this package to the executors' Python, once per application; Spark hands it out like any other file.

    A session that has Spark's own number for one of ``TEXT_SETTINGS`` goes on with ours; another number stays.
    """
    context = spark.sparkContext
    for name, (own, ours) in TEXT_SETTINGS.items():
        if spark.conf.get(name, own) == own:
            spark.conf.set(name, ours)
    if getattr(context, "_spanlight_shipped", False):
        return
    package = Path(__file__).parent.parent
    archive = Path(tempfile.mkdtemp(prefix="spanlight-code-")) / "spanlight.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for source in sorted(package.rglob("*.py")):
            z.write(source, source.relative_to(package.parent))
    context.addPyFile(str(archive))
    context._spanlight_shipped = True


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, lengthened where ``df`` has such a column already."""
    taken, made = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        made.append(name)
    return made


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def whole(text: Column) -> Column:
    """The text, null as empty."""
    return F.coalesce(text.cast("string"), F.lit(""))


def blank_words(text: Column) -> Column:
    """Array of the words ``[^\\x20\\x09-\\x0D]+`` of a text that is not null."""
    trimmed = F.btrim(text, F.lit(BLANKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, BLANK_RUN, -1))
