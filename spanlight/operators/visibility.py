"""Reach of titles over countries, themes and tags.

Flat facts throughout: ``titles`` one row per title, ``availability`` one row per (title, country, access type).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from spanlight.functions.scalars import exact_sum, half_up

STREAMABLE = ("flatrate", "free")


def streamable(availability: DataFrame, access: str = "access", kinds: tuple[str, ...] = STREAMABLE, id_col: str = "id", country: str = "country") -> DataFrame:
    """(id, country) pairs with at least one access type that counts."""
    return availability.where(F.col(access).isin(*kinds)).select(id_col, country).distinct()


def explode_offers(offers: DataFrame, offers_col: str = "offers", id_col: str = "id") -> DataFrame:
    """Availability rows from a nested map country -> access type -> providers; empty lists give no row."""
    by_country = offers.select(id_col, F.explode(offers_col).alias("country", "kinds"))
    return by_country.select(id_col, "country", F.explode("kinds").alias("access", "providers")).where(F.size("providers") > 0)


def with_themes(titles: DataFrame, store: DataFrame, default: str = "other", id_col: str = "id") -> DataFrame:
    """Titles with ``theme``, ``confidence`` and whether a person set the theme.

    ``store``: (id, model_theme, model_confidence, override_theme). A person's theme wins and has confidence 100;
    a title that is not in the store gets ``default`` with 0.
    """
    joined = titles.join(store, id_col, "left")
    human = F.col("override_theme").isNotNull()
    return joined.withColumns(
        {
            "theme": F.coalesce("override_theme", "model_theme", F.lit(default)),
            "confidence": F.when(human, 100).otherwise(F.coalesce("model_confidence", F.lit(0))).cast("int"),
            "is_human": human,
        }
    ).drop("model_theme", "model_confidence", "override_theme")


def with_tags(titles: DataFrame, store: DataFrame, id_col: str = "id") -> DataFrame:
    """Titles with ``tags``: a person's tags, even an empty list, win over detected ones; null falls back; else empty."""
    tags = F.coalesce("human_tags", "auto_tags", F.array().cast("array<string>"))
    return titles.join(store, id_col, "left").withColumn("tags", tags).drop("human_tags", "auto_tags")


def without(df: DataFrame, *sensitive: str) -> DataFrame:
    """The rows as they may be shown: columns that must not leave the service are gone."""
    return df.drop(*sensitive)


def top_by(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("_rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_rank = 1").drop("_rank")


def visibility(facts: DataFrame, threshold: int = 70, country: str = "country") -> DataFrame:
    """One row per country: score, number of titles, top title, dominant theme and whether that is uncertain.

    ``facts``: (country, id, name, popularity, theme, confidence, ordinal), one row per streamable title and country.
    Ties: the title with the smaller ordinal, the theme whose first title comes first. The best title and
    the best theme are found with aggregates over ordered structs, so the whole needs one shuffle by
    (country, theme) with partial sums and a small one by country.
    """
    by_theme = facts.groupBy(country, "theme").agg(
        F.sum(F.col("popularity").cast("decimal(24,4)")).alias("score"),
        F.count("*").alias("titles"),
        F.max("confidence").alias("confidence"),
        F.min("ordinal").alias("first"),
        F.max(F.struct("popularity", (-F.col("ordinal")).alias("o"), "id", "name")).alias("top"),
    )
    best = F.max(F.struct("score", (-F.col("first")).alias("f"), "theme", "confidence")).alias("theme")
    return by_theme.groupBy(country).agg(
        F.sum("score").cast("double").alias("score"), F.sum("titles").alias("title_count"), F.max("top").alias("top"), best
    ).select(
        country,
        "score",
        "title_count",
        F.col("top.id").alias("top_id"),
        F.col("top.name").alias("top_name"),
        F.col("theme.theme").alias("dominant_theme"),
        F.col("theme.confidence").alias("theme_confidence"),
        (F.col("theme.confidence") < threshold).alias("theme_uncertain"),
    )


def title_list(facts: DataFrame, country: str = "country", limit: int | None = None) -> DataFrame:
    """(country, titles): titles of each country, most popular first. Nested, for the edge of a service only.

    With a limit, each task keeps that many rows of a country before the shuffle, and no more are nested.
    """
    if limit is not None:
        place = F.row_number().over(W.partitionBy(country).orderBy(F.col("popularity").desc(), "ordinal"))
        facts = facts.withColumn("_place", place).where(F.col("_place") <= limit)
    listed = F.sort_array(F.collect_list(F.struct("popularity", (-F.col("ordinal")).alias("o"), "id", "name")), asc=False)
    return facts.groupBy(country).agg(listed.alias("titles"))


def theme_scores(facts: DataFrame, country: str = "country") -> DataFrame:
    return facts.groupBy(country, "theme").agg(exact_sum("popularity").alias("score"), F.max("confidence").alias("confidence"), F.count("*").alias("titles"))


def tag_scores(facts: DataFrame, country: str = "country") -> DataFrame:
    """(country, tag, title_count, score) from facts with an array ``tags``."""
    return facts.select(country, "popularity", F.explode("tags").alias("tag")).groupBy(country, "tag").agg(
        F.count("*").alias("title_count"), exact_sum("popularity").alias("score")
    )


def global_themes(titles: DataFrame, reach: DataFrame) -> DataFrame:
    """(theme, title_count, score, countries_reached) over all titles.

    ``countries_reached`` is the sum over titles of each title's countries, not a count of distinct countries.
    """
    countries = reach.groupBy("id").agg(F.count("*").alias("n"))
    return titles.join(countries, "id").groupBy("theme").agg(
        F.count("*").alias("title_count"), half_up(exact_sum("popularity"), 1).alias("score"), F.sum("n").alias("countries_reached")
    )


def tag_ranking(titles: DataFrame, scores: DataFrame) -> DataFrame:
    """(tag, title_count, country_count, total_score): titles are counted before availability; tags without titles go."""
    counted = titles.select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("title_count"))
    reached = scores.groupBy("tag").agg(F.count("*").alias("country_count"), exact_sum("score").alias("total_score"))
    return counted.join(reached, "tag", "full").select(
        "tag",
        F.coalesce("title_count", F.lit(0)).alias("title_count"),
        F.coalesce("country_count", F.lit(0)).alias("country_count"),
        F.coalesce("total_score", F.lit(0.0)).alias("total_score"),
    ).where("title_count > 0")


def proxy_union(countries: DataFrame, fallback: DataFrame, country: str = "country", label: str = "label", ordinal: str = "ordinal") -> DataFrame:
    """Countries and, marked as proxies, those fallback rows whose country is missing; the first label of a country counts."""
    missing = fallback.where(F.col(country).isNotNull()).join(countries, country, "left_anti")
    first = top_by(missing, [country], F.col(ordinal), F.col(label))
    return countries.withColumn("data_source", F.lit("real")).unionByName(first.withColumn("data_source", F.lit("proxy")), allowMissingColumns=True)


def origin_metrics(facts: DataFrame, origin: str = "origin", country: str = "country") -> DataFrame:
    """(origin, title_count, score, countries_reached): titles once each, distinct countries.

    The facts are read once: grouping sets give the titles and the countries of each origin side by side. Rows
    without an origin are left out.
    """
    sets = facts.where(F.col(origin).isNotNull()).groupingSets([[F.col(origin), F.col("id")], [F.col(origin), F.col(country)]], origin, "id", country)
    parts = sets.agg(F.max("popularity").alias("popularity"), (F.grouping("id") == 0).alias("of_title"))
    return parts.groupBy(origin).agg(
        F.count_if("of_title").alias("title_count"),
        half_up(exact_sum(F.when(F.col("of_title"), F.col("popularity"))), 1).alias("score"),
        F.count_if(~F.col("of_title") & F.col(country).isNotNull()).alias("countries_reached"),
    )


def person_impact(facts: DataFrame, credits: DataFrame, totals: DataFrame, country: str = "country") -> DataFrame:
    """(person, id, country_count, impact): per title of a person, the sum of the whole scores of the countries it reaches.

    Scores are rounded before they are added, and the sum is rounded again.
    """
    scored = facts.select("id", country).join(totals.select(country, half_up("score", 1).alias("s")), country)
    per_title = scored.groupBy("id").agg(F.count("*").alias("country_count"), half_up(exact_sum("s"), 1).alias("impact"))
    return credits.select("person", "id").distinct().join(per_title, "id").select("person", "id", "country_count", "impact")


def person_network(facts: DataFrame, credits: DataFrame, places: DataFrame, country: str = "country") -> DataFrame:
    """(person, country, score, title_count, lat, lng) over a person's titles; countries without coordinates are dropped."""
    joined = credits.select("person", "id").distinct().join(facts.select("id", country, "popularity"), "id")
    sums = joined.groupBy("person", country).agg(exact_sum("popularity").alias("score"), F.count("*").alias("title_count"))
    known = places.where(F.col("lat").isNotNull() & F.col("lng").isNotNull())
    return sums.join(known.select(country, "lat", "lng"), country).select("person", country, "score", "title_count", "lat", "lng")


def title_countries(facts: DataFrame, totals: DataFrame, country: str = "country") -> DataFrame:
    """Reverse lookup (id, country, country_score, share): where a title is and how much of the score it makes up."""
    return facts.select("id", country, "popularity").join(totals.select(country, "score"), country).select(
        "id", country, F.col("score").alias("country_score"), half_up(F.col("popularity") / F.col("score") * 100.0, 2).alias("share")
    )
