"""The impact report: one row from one scan of the facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from spanlight.functions.scalars import exact_sum, half_up
from spanlight.operators.temporal import INSUFFICIENT
from spanlight.scratch import stash

PENDING = "pending"


def impact_report(facts: DataFrame, trend: DataFrame, country: str, place: str, value: str, analysis: DataFrame | None = None, key: str = "key", n: int = 5) -> DataFrame:
    """One row (report): JSON of counts by trend, the leading countries and places with what the others add up to, and the fastest risers.

    ``facts`` are read once: countries and places are two grouping sets of one aggregate. ``trend``: (key, direction, change_pct) of
    countries; one without a trend counts as insufficient. ``analysis``: at most one row with a JSON text ``analysis``; without one, and
    where it is null, the report says ``pending``. Scores are rounded to whole numbers. Ties go by name. Null names are left out.
    No facts give a report of zeros and empty lists.
    """
    sums = facts.groupingSets([[country], [place]], country, place).agg(F.grouping(country).alias("by_place"), exact_sum(value).alias("score"))
    sums = sums.select((F.col("by_place") == 1).alias("by_place"), F.coalesce(F.col(country).cast("string"), F.col(place).cast("string")).alias("label"), "score").where("label is not null")
    # As many rows as countries and places: written, as three lists are taken from them.
    rows = sums.join(trend.select(F.col(key).cast("string").alias("_k"), "direction", "change_pct"), (F.col("label") == F.col("_k")) & ~F.col("by_place"), "left").drop("_k")
    rows = stash(rows.withColumn("direction", F.coalesce("direction", F.lit(INSUFFICIENT))), "report-sums")

    first = W.partitionBy("by_place").orderBy(F.col("score").desc(), "label")
    top = rows.withColumn("r", F.row_number().over(first)).where(F.col("r") <= n)
    entry = F.struct("r", F.struct(F.col("label").alias("name"), half_up("score").cast("bigint").alias("score")).alias("e"))
    ups = rows.where(~F.col("by_place") & (F.col("direction") == "rising")).orderBy(F.col("change_pct").desc(), "label").limit(n)
    riser = F.struct((-F.col("change_pct")).alias("c"), F.struct(F.col("label").alias("name"), half_up("score").cast("bigint").alias("score")).alias("e"))

    def names(kept: Column, item: Column) -> Column:
        return F.transform(F.sort_array(F.collect_list(F.when(kept, item))), lambda x: x["e"])

    def total(kept: Column, out: str) -> Column:
        return F.coalesce(exact_sum(F.when(kept, F.col("score"))), F.lit(0.0)).alias(out)

    places, countries = F.col("by_place"), ~F.col("by_place")
    counts = rows.agg(
        F.count_if(countries).alias("total"), F.count_if(countries & (F.col("direction") == "rising")).alias("rising"), F.count_if(countries & (F.col("direction") == "falling")).alias("falling"),
        F.coalesce(F.max(countries & (F.col("direction") != INSUFFICIENT)), F.lit(False)).alias("enough"), total(countries, "all_countries"), total(places, "all_places"),
    )
    lists = top.agg(names(countries, entry).alias("countries"), names(places, entry).alias("places"), total(countries, "top_countries"), total(places, "top_places"))
    listed = ups.agg(names(F.lit(True), riser).alias("risers"))
    told = (analysis if analysis is not None else facts.sparkSession.createDataFrame([], "analysis string")).agg(F.coalesce(F.max("analysis"), F.lit(PENDING)).alias("analysis"))
    row = counts.join(F.broadcast(lists)).join(F.broadcast(listed)).join(F.broadcast(told))  # one row each
    rest = lambda a, b: half_up(F.greatest(F.col(a) - F.col(b), F.lit(0.0))).cast("bigint")
    report = F.struct(
        F.col("total").alias("total_countries"), F.col("rising").alias("rising_count"), F.col("falling").alias("falling_count"), F.col("countries").alias("top_countries"),
        rest("all_countries", "top_countries").alias("other_countries_score"), F.col("risers").alias("rising_countries"), F.col("enough").alias("has_enough_history"),
        F.col("places").alias("top_places"), rest("all_places", "top_places").alias("other_places_score"), F.col("analysis").alias("analysis"),
    )
    return row.select(F.to_json(report).alias("report"))
