"""Shares, top lists with remainders, groups of countries and chart helpers."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from spanlight.functions.scalars import clamp, exact_sum, half_up, share_pct
from spanlight.scratch import stash


def with_total(df: DataFrame, value: str, out: str = "total") -> DataFrame:
    """The total of a column next to each row; one row is broadcast instead of a window over all rows."""
    return df.join(F.broadcast(df.agg(F.coalesce(exact_sum(value), F.lit(0.0)).alias(out))))


def shares(df: DataFrame, value: str, out: str = "share_pct") -> DataFrame:
    """Share of the total in percent with one digit; 0 if the total is not positive."""
    return with_total(df, value, "_total").withColumn(out, share_pct(value, "_total")).drop("_total")


def top_with_remainder(df: DataFrame, n: int, value: str, label: str, rest: str = "others") -> DataFrame:
    """(rank, label, value): the top ``n`` with scores rounded to one digit, and what is left of the rounded total, at least 0.

    The top rows come from a limit, which keeps ``n`` rows per task.
    """
    rounded = df.select(F.col(label).alias("label"), half_up(value, 1).alias("value"))
    top = rounded.orderBy(F.col("value").desc(), "label").limit(n)
    ranked = top.withColumn("rank", F.row_number().over(W.partitionBy(F.lit(0)).orderBy(F.col("value").desc(), "label")))
    total = df.agg(half_up(exact_sum(value), 1).alias("total"))
    kept = top.agg(F.coalesce(exact_sum("value"), F.lit(0.0)).alias("kept"))
    left = F.greatest(F.lit(0.0), half_up(F.col("total") - F.col("kept"), 1))
    other = total.join(F.broadcast(kept)).where("total is not null").select(F.lit(n + 1).alias("rank"), F.lit(rest).alias("label"), left.alias("value"))
    return ranked.select("rank", "label", "value").unionByName(other)


def rising(trended: DataFrame, n: int, key: str = "key", direction: str = "rising") -> DataFrame:
    """The ``n`` keys with the largest change in a direction."""
    rows = trended.where(F.col("direction") == direction).orderBy(F.col("change_pct").desc(), key).limit(n)
    return rows.select(key, "score", "change_pct", "window_days")


def rising_tracked(trended: DataFrame, tracked: DataFrame, n: int = 15, key: str = "key") -> DataFrame:
    """Rising keys for which there is a panel."""
    return rising(trended.join(tracked.select(key).distinct(), key, "left_semi"), n, key)


def trend_counts(trended: DataFrame, insufficient: str = "insufficient") -> DataFrame:
    """One row: rising, falling, total, and whether any key has enough history (a missing direction counts as enough)."""
    d = F.col("direction")
    return trended.agg(
        F.count_if(d == "rising").alias("rising"),
        F.count_if(d == "falling").alias("falling"),
        F.count("*").alias("total"),
        F.coalesce(F.bool_or(~d.eqNullSafe(F.lit(insufficient))), F.lit(False)).alias("enough_history"),
    )


def donut_angles(df: DataFrame, value: str, label: str) -> DataFrame:
    """(label, start, end, mid) in radians, clockwise from the top, largest first. For the short lists of a chart."""
    w = W.partitionBy(F.lit(0)).orderBy(F.col(value).desc(), label).rowsBetween(W.unboundedPreceding, W.currentRow)
    total = F.coalesce(F.nullif(F.sum(value).over(W.partitionBy(F.lit(0))), F.lit(0.0)), F.lit(1.0))
    upto = F.sum(value).over(w)
    turn = 2 * math.pi
    framed = df.select(F.col(label).alias("label"), ((upto - F.col(value)) / total * turn).alias("start"), (upto / total * turn).alias("end"))
    return framed.withColumn("mid", (F.col("start") + F.col("end")) / 2)


def rank_bars(df: DataFrame, value: str, label: str, keys: list[str] | None = None) -> DataFrame:
    """(…keys, rank, label, value, width): width in percent of the largest value, which counts as 1 at least."""
    keys = keys or []
    part = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))
    rank = F.row_number().over(part.orderBy(F.col(value).desc(), label))
    width = half_up(F.col(value) / F.greatest(F.max(value).over(part), F.lit(1.0)) * 100.0, 1)
    return df.select(*keys, rank.alias("rank"), F.col(label).alias("label"), F.col(value).alias("value"), width.alias("width"))


def group_rollup(items: DataFrame, groups: DataFrame, membership: DataFrame, group: str = "continent", country: str = "country", top: int = 5) -> DataFrame:
    """(group, country_count, total, average, top_country, top_countries): all groups, also those without items.

    ``groups`` lists the groups; ``membership`` maps countries to groups; countries without a group are dropped.
    """
    joined = items.join(membership, country)
    ranked = joined.withColumn("_r", F.row_number().over(W.partitionBy(group).orderBy(F.col("score").desc(), country)))
    named = F.sort_array(F.collect_list(F.when(F.col("_r") <= top, F.struct("_r", country))))
    sums = ranked.groupBy(group).agg(
        F.count("*").alias("n"), exact_sum("score").alias("total"), F.max(F.when(F.col("_r") == 1, F.col(country))).alias("top_country"), named.alias("_top")
    )
    return groups.select(group).join(sums, group, "left").select(
        group,
        F.coalesce("n", F.lit(0)).alias("country_count"),
        F.coalesce("total", F.lit(0.0)).alias("total"),
        F.coalesce(half_up(F.col("total") / F.col("n"), 1), F.lit(0.0)).alias("average"),
        "top_country",
        F.array_join(F.transform(F.coalesce("_top", F.array()), lambda x: x[country]), ",").alias("top_countries"),
    )


def group_top_title(facts: DataFrame, membership: DataFrame, group: str = "continent", country: str = "country") -> DataFrame:
    """(group, id, score, country_count): the title with the largest sum over the countries of a group."""
    sums = facts.join(membership, country).groupBy(group, "id").agg(exact_sum("popularity").alias("score"), F.count("*").alias("country_count"))
    best = F.max(F.struct("score", (-F.col("id")).alias("o"), "country_count")).alias("b")
    return sums.groupBy(group).agg(best).select(group, (-F.col("b.o")).alias("id"), F.col("b.score").alias("score"), F.col("b.country_count").alias("country_count"))


def centroid_spread(places: DataFrame, group: str = "continent", low: float = 0.5, high: float = 2.5, factor: float = 0.02) -> DataFrame:
    """(group, lat, lng, spread, altitude): mean place, largest distance from it, and a clamped height of view."""
    centre = places.groupBy(group).agg((exact_sum("lat") / F.count("*")).alias("lat"), (exact_sum("lng") / F.count("*")).alias("lng"))
    away = F.hypot(F.col("p.lat") - F.col("c.lat"), F.col("p.lng") - F.col("c.lng"))
    spread = places.alias("p").join(centre.alias("c"), group).groupBy(group).agg(half_up(F.max(away), 4).alias("spread"))
    return centre.join(spread, group).select(
        group, half_up("lat", 4).alias("lat"), half_up("lng", 4).alias("lng"), "spread", half_up(clamp(F.col("spread") * factor, low, high), 4).alias("altitude")
    )


def top_in_group(items: DataFrame, membership: DataFrame, n: int, value: str, group: str = "continent", country: str = "country") -> DataFrame:
    """(group, country, value, rank): the ``n`` best countries of each group."""
    joined = items.join(membership, country)
    rank = F.row_number().over(W.partitionBy(group).orderBy(F.col(value).desc(), country))
    return joined.withColumn("rank", rank).where(F.col("rank") <= n).select(group, country, F.col(value).alias("value"), "rank")


def placed(df: DataFrame, *order: Column | str, out: str = "rank") -> DataFrame:
    """All rows with their place in an order, from 1. Rows that are equal in it get places in any order among them.

    No task sees all rows: they are sorted in ranges, which are written; the place is the row's number in its range
    plus the rows of earlier ranges, of which there are as many as shuffle partitions.
    """
    row_bits = 33  # ``monotonically_increasing_id`` has the range above them
    written = stash(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()), "placed")
    held = written.groupBy(F.shiftright("_at", row_bits).alias("_range")).agg(F.count("*").alias("_n"))
    before = W.partitionBy(F.lit(0)).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    starts = held.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    joined = written.withColumn("_range", F.shiftright("_at", row_bits)).join(F.broadcast(starts), "_range")
    return joined.withColumn(out, F.col("_start") + F.col("_at").bitwiseAND(F.lit((1 << row_bits) - 1)) + 1).drop("_at", "_range", "_start")


def boolean_first(df: DataFrame, flag: Column, *then: Column | str, out: str = "rank") -> DataFrame:
    """All rows with their place, those with the flag first."""
    return placed(df, F.coalesce(flag, F.lit(False)).desc(), *then, out=out)
