"""Titles, ratings and local names in one layout: three tables bucketed and sorted by the same id.

They meet bucket by bucket, without a shuffle, and a look-up of an id reads one bucket of each.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlight.functions.scalars import null_if_na
from spanlight.scratch import scratch_path

#: The kinds of title that a search by name looks at.
SERIES_TYPES = ("tvSeries", "tvMiniSeries")


@dataclass(frozen=True)
class TitleLayout:
    """Names of the three catalogue tables."""

    basics: str
    ratings: str
    names: str


def write_layout(basics: DataFrame, ratings: DataFrame, akas: DataFrame, buckets: int = 16, folder: str | None = None) -> TitleLayout:
    r"""Write the tables once and return their names.

    ``basics``: tconst, titleType, primaryTitle, originalTitle, startYear, endYear; ``ratings``: tconst, averageRating, numVotes;
    ``akas``: titleId, ordinal, title, region, isOriginalTitle. ``\N`` and empty text become null. ``folder`` is where the files
    go (the scratch folder if it is unset).
    """
    spark, run = basics.sparkSession, uuid.uuid4().hex
    text = lambda c: null_if_na(F.col(c).cast("string"))
    tables = {
        "basics": basics.select("tconst", "titleType", *[text(c).alias(c) for c in ("primaryTitle", "originalTitle")], *[text(c).try_cast("int").alias(c) for c in ("startYear", "endYear")]),
        "ratings": ratings.select("tconst", text("averageRating").try_cast("double").alias("averageRating"), text("numVotes").try_cast("bigint").alias("numVotes")),
        "names": akas.select(F.col("titleId").alias("tconst"), "ordinal", null_if_na("region").alias("region"), "title", F.col("isOriginalTitle").cast("string").eqNullSafe("1").alias("isOriginal")).where("region is not null"),
    }
    made = {}
    for kind, df in tables.items():
        made[kind] = f"title_{kind}_{run}"
        path = f"{folder}/{kind}-{run}" if folder else scratch_path(spark, f"title-{kind}")
        df.repartition(buckets, "tconst").write.bucketBy(buckets, "tconst").sortBy("tconst").option("path", path).saveAsTable(made[kind])
    return TitleLayout(**made)


def drop_layout(spark: SparkSession, layout: TitleLayout) -> None:
    """Takes the tables out of the catalogue; their files stay with the folder."""
    for name in (layout.basics, layout.ratings, layout.names):
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def folded(text: Column) -> Column:
    """Full case folding: ``straße`` and ``STRASSE`` become one, the dotless i and the i do not, nor do wide and plain letters.

    Upper and then lower case is the folding but for the dotless i, which is kept apart as a character without case; the change
    of that character between the two keeps the optimizer from taking them for lower case alone.
    """
    return F.lower(F.translate(F.upper(F.translate(text, "ı", "\ue000")), "\ue000", "\ue001"))


def find(basics: DataFrame, name_or_id: str, types: tuple[str, ...] = SERIES_TYPES) -> DataFrame:
    """Rows of an id (``tt`` in any case and digits; then compared exactly, of any type), or of a series by either of its titles.

    Titles are compared whole, after trimming the name that is asked for and folding case. Nothing is matched in part.
    """
    if name_or_id.lower().startswith("tt") and name_or_id[2:].isdigit():
        return basics.where(F.col("tconst") == name_or_id)
    wanted = folded(F.lit(name_or_id.strip()))
    return basics.where(F.col("titleType").isin(*types) & ((folded(F.col("primaryTitle")) == wanted) | (folded(F.col("originalTitle")) == wanted)))


def title_rows(spark: SparkSession, layout: TitleLayout, name_or_id: str | None = None) -> DataFrame:
    """One row per title (all of them, or those that are found): its years, its rating if any, and its names by region.

    ``names`` is an array of (ordinal, region, title, is_original) by ordinal; of equal (region, title) the first counts, and it is
    empty where none has a region. The region NA is a region.
    """
    basics = spark.table(layout.basics)
    basics = basics if name_or_id is None else find(basics, name_or_id)
    one = spark.table(layout.names).groupBy("tconst", "region", "title").agg(F.min(F.struct("ordinal", F.col("isOriginal").alias("is_original"))).alias("b"))
    listed = F.sort_array(F.collect_list(F.struct("b.ordinal", "region", "title", "b.is_original")))
    names = one.groupBy("tconst").agg(listed.alias("names"))
    # Sorted sides merge within their buckets; a hint keeps a small side from being sent around.
    joined = basics.join(spark.table(layout.ratings).hint("merge"), "tconst", "left").join(names.hint("merge"), "tconst", "left")
    none = F.array().cast(names.schema["names"].dataType)
    return joined.select(
        "tconst", F.col("titleType").alias("title_type"), F.col("primaryTitle").alias("primary_title"), F.col("originalTitle").alias("original_title"),
        F.col("startYear").alias("start_year"), F.col("endYear").alias("end_year"), F.col("averageRating").alias("rating"), F.col("numVotes").alias("votes"), F.coalesce("names", none).alias("names"),
    )


def first_match(spark: SparkSession, layout: TitleLayout, name_or_id: str) -> DataFrame:
    """The title that a look-up means: of several of one name the smallest id; no row if there is none."""
    return title_rows(spark, layout, name_or_id).orderBy("tconst").limit(1)
