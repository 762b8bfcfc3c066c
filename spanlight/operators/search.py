"""Search over titles, people and countries, and filters that a caller may leave out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from spanlight.functions.scalars import all_of, turkish_lower


def search_index(titles: DataFrame, credits: DataFrame, countries: DataFrame) -> DataFrame:
    """(kind, key, label, related): titles, people with one row for each name of their titles, and countries.

    ``titles``: (id, name); ``credits``: (id, person); ``countries``: (country). Rows are distinct and flat, so a person
    with very many titles is no single value.
    """
    t = titles.select(F.lit("title").alias("kind"), F.col("id").cast("string").alias("key"), F.col("name").alias("label"), F.lit("").alias("related")).distinct()
    people = credits.select("person", "id").join(titles.select("id", F.col("name").alias("related")), "id").select(F.col("person").cast("string").alias("key"), "related").distinct()
    p = people.select(F.lit("person").alias("kind"), "key", F.col("key").alias("label"), "related")
    c = countries.select("country").distinct().select(F.lit("country").alias("kind"), F.col("country").alias("key"), F.col("country").alias("label"), F.lit("").alias("related"))
    return t.unionByName(p).unionByName(c)


def find(index: DataFrame, query: str, per_kind: int = 6, least: int = 2) -> DataFrame:
    """(kind, key, label, rank, related): up to ``per_kind`` entries of each kind whose label contains the query (plain
    lower case), by label; ``related`` joins the names of the entries found by ``|``."""
    hits = index.where(F.contains(F.lower("label"), F.lit(query.strip().lower())) & F.lit(len(query.strip()) >= least))
    entry = ["kind", "key", "label"]
    rank = F.row_number().over(W.partitionBy("kind").orderBy("label", "key"))
    best = hits.select(*entry).distinct().withColumn("rank", rank).where(F.col("rank") <= per_kind)
    return hits.join(best, entry).groupBy(*entry, "rank").agg(F.array_join(F.sort_array(F.collect_set("related")), "|").alias("related"))


def filtered(df: DataFrame, text: str | None = None, text_col: str = "name", equals: dict[str, object] | None = None, contains: dict[str, str] | None = None) -> DataFrame:
    """Only the filters that are given (and not empty) apply."""
    wanted = all_of(
        F.contains(turkish_lower(text_col), turkish_lower(F.lit(text))) if text else None,
        *[F.col(c) == v for c, v in (equals or {}).items() if v not in (None, "")],
        *[F.array_contains(c, v) for c, v in (contains or {}).items() if v not in (None, "")],
    )
    return df.where(wanted)
