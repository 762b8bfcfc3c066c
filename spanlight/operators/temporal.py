"""Snapshots of scores over time: trends, retention, roll-ups, pairs of periods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from spanlight.functions.scalars import col, day_difference, exact_sum, half_up, millis, pct_change, period

INSUFFICIENT = "insufficient"


def reference_snapshot(history: DataFrame, now: Column, key: str = "key", score: str = "score", ts: str = "ts", days: int = 7) -> DataFrame:
    """As-of join target: the newest snapshot at least ``days`` old, else the oldest one; one aggregate, no self-join."""
    old = F.col(ts) <= now - F.expr(f"INTERVAL {days} DAYS")
    snap = F.struct(F.col(ts), F.col(score))
    return history.groupBy(key).agg(F.coalesce(F.max(F.when(old, snap)), F.min(snap)).alias("ref")).select(
        key, F.col(f"ref.{ts}").alias("ref_ts"), F.col(f"ref.{score}").alias("ref_score")
    )


def trends(current: DataFrame, history: DataFrame, now: Column, key: str = "key", score: str = "score", ts: str = "ts", limit: float = 5.0, days: int = 7, min_hours: int = 24) -> DataFrame:
    """(key, score, direction, change_pct, window_days) against the reference snapshot.

    No reference, or one younger than ``min_hours``: insufficient, with nulls. A base of 0 is a change of 0. Limits are
    inclusive and are compared with the rounded change.
    """
    ref = reference_snapshot(history, now, key, score, ts, days)
    joined = current.select(key, F.col(score).alias("score")).join(ref, key, "left")
    age = millis(now) - millis("ref_ts")
    enough = F.col("ref_ts").isNotNull() & (age >= min_hours * 3_600_000)
    change = pct_change("score", "ref_score", zero=0.0)
    named = F.when(change >= limit, "rising").when(change <= -limit, "falling").otherwise("flat")
    return joined.select(
        key,
        "score",
        F.when(enough, named).otherwise(INSUFFICIENT).alias("direction"),
        F.when(enough, change).alias("change_pct"),
        F.when(enough, day_difference(millis(now), millis("ref_ts"))).alias("window_days"),
    )


def keep_last(history: DataFrame, n: int, key: str | list[str] = "key", order: str | list[str] = "ts") -> DataFrame:
    """The newest ``n`` rows of each key. Ties go by the later order columns."""
    keys, orders = ([x] if isinstance(x, str) else x for x in (key, order))
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*[F.col(o).desc() for o in orders]))
    return history.withColumn("_n", rank).where(F.col("_n") <= n).drop("_n")


def newest_points(history: DataFrame, n: int = 20, key: str = "key", order: list[str] | None = None) -> DataFrame:
    """(key, points): the newest ``n`` rows of each key as an array of structs, oldest first.

    Each task keeps ``n`` rows of a key before the shuffle, so a key's whole history never meets in one task. Ties go by the
    later order columns; the struct begins with them.
    """
    orders = order or ["ts"]
    rest = [c for c in history.columns if c != key and c not in orders]
    kept = keep_last(history, n, key, orders)
    return kept.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*orders, *rest))).alias("points"))


def trend_rows(current: DataFrame, history: DataFrame, now: Column, n: int = 20, key: str = "key", score: str = "score", ts: str = "ts", order: list[str] | None = None, proxy: Column | None = None, limit: float = 5.0) -> DataFrame:
    """``trends`` of each current row with its newest ``n`` points, oldest first; rows without history have an empty list.

    ``proxy`` marks rows whose score is made up: they have no trend and no points, whatever the history says.
    """
    told = trends(current, history, now, key, score, ts, limit)
    joined = told.join(newest_points(history, n, key, order or [ts]), key, "left")
    none = F.array().cast(joined.schema["points"].dataType)
    if proxy is None:
        return joined.withColumn("points", F.coalesce("points", none))
    made_up = current.where(proxy).select(key).distinct().withColumn("_proxy", F.lit(True))
    joined = joined.join(made_up, key, "left")
    real = F.col("_proxy").isNull()
    return joined.select(
        key, "score", F.when(real, F.col("direction")).otherwise(INSUFFICIENT).alias("direction"), F.when(real, F.col("change_pct")).alias("change_pct"),
        F.when(real, F.col("window_days")).alias("window_days"), F.coalesce(F.when(real, F.col("points")), none).alias("points"),
    )


def min_max(df: DataFrame, value: str, real: Column | None = None, key: list[str] | None = None, out: str = "t") -> DataFrame:
    """Scale to 0..1 by the range of the ``real`` rows (of each key), applied to all; a range of 0 counts as 1.

    Without a key the range is one row, joined back, so that no task sees all rows.
    """
    v = F.when(real, F.col(value)) if real is not None else F.col(value)
    if key:
        w = W.partitionBy(*key)
        low, high = F.min(v).over(w), F.max(v).over(w)
        return df.withColumn(out, (F.col(value) - low) / F.coalesce(F.nullif(high - low, F.lit(0.0)), F.lit(1.0)))
    span = df.agg(F.min(v).alias("_low"), F.max(v).alias("_high"))
    scaled = (F.col(value) - F.col("_low")) / F.coalesce(F.nullif(F.col("_high") - F.col("_low"), F.lit(0.0)), F.lit(1.0))
    return df.join(F.broadcast(span)).withColumn(out, scaled).drop("_low", "_high")  # one row


def sparkline(history: DataFrame, key: str = "key", score: str = "score", order: list[str] | None = None) -> DataFrame:
    """Points (key, position, t, rising) of keys with at least two snapshots; rising if the last is not below the first."""
    order = order or ["ts"]
    w = W.partitionBy(key).orderBy(*order)
    whole = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    marked = history.select(
        key,
        score,
        F.row_number().over(w).alias("position"),
        F.count("*").over(whole).alias("_n"),
        (F.last(score).over(whole) >= F.first(score).over(whole)).alias("rising"),
    ).where("_n >= 2")
    return min_max(marked, score, key=[key]).select(key, "position", "t", "rising")


def monthly_rollup(samples: DataFrame, now: Column, key: str = "key", score: str = "score", ts: str = "ts", rolled: DataFrame | None = None) -> DataFrame:
    """(key, year, month, avg_score, sample_count) of completed UTC months that are not rolled yet.

    Months that are rolled stay as they are; late samples of such months are not counted.
    """
    months = samples.select(key, score, F.year(ts).alias("year"), F.month(ts).alias("month"))
    done = months.where((F.col("year") < F.year(now)) | ((F.col("year") == F.year(now)) & (F.col("month") < F.month(now))))
    made = _month_average(done, key, score)
    return made if rolled is None else made.join(rolled, [key, "year", "month"], "left_anti")


def current_month(samples: DataFrame, now: Column, key: str = "key", score: str = "score", ts: str = "ts") -> DataFrame:
    months = samples.select(key, score, F.year(ts).alias("year"), F.month(ts).alias("month"))
    return _month_average(months.where((F.col("year") == F.year(now)) & (F.col("month") == F.month(now))), key, score)


def _month_average(months: DataFrame, key: str, score: str) -> DataFrame:
    return months.groupBy(key, "year", "month").agg(
        half_up(exact_sum(score) / F.count(F.col(score)), 1).alias("avg_score"), F.count("*").alias("sample_count")
    )


def yearly_rollup(monthly: DataFrame, key: str = "key") -> DataFrame:
    """(key, year, avg_score, months_covered, is_partial): plain mean of the rounded months."""
    return monthly.groupBy(key, "year").agg(
        half_up(exact_sum("avg_score") / F.count("*"), 1).alias("avg_score"), F.count("*").alias("months_covered"), (F.count("*") < 12).alias("is_partial")
    )


def global_monthly(monthly: DataFrame, current: DataFrame) -> DataFrame:
    """(year, month, total_score, key_count, is_current): months of all keys added up; the current month replaces a rolled one."""
    def total(df: DataFrame, now: bool) -> DataFrame:
        return df.groupBy("year", "month").agg(half_up(exact_sum("avg_score"), 1).alias("total_score"), F.count("*").alias("key_count")).withColumn("is_current", F.lit(now))

    fresh = total(current, True)
    return total(monthly, False).join(fresh, ["year", "month"], "left_anti").unionByName(fresh)


def global_yearly(global_months: DataFrame) -> DataFrame:
    return yearly_rollup(
        global_months.select(F.lit("global").alias("key"), "year", "month", F.col("total_score").alias("avg_score"))
    ).drop("key")


def monthly_periods(monthly: DataFrame, current: DataFrame, key: str = "key") -> DataFrame:
    """Rolled months and the running one, as (key, period, avg_score, sample_count, is_current)."""
    both = monthly.withColumn("is_current", F.lit(False)).unionByName(current.withColumn("is_current", F.lit(True)))
    return both.select(key, period("year", "month").alias("period"), "avg_score", "sample_count", "is_current")


def arrivals_pair(panel: DataFrame, key: str = "key", value: str = "value", year: str = "year", month: str = "month") -> DataFrame:
    """(key, month, before_year, after_year, before_value, after_value): the newest two years of the best covered month.

    The month with most years counts (two at least); ties go to the month that comes first in (year, month) order.
    The two years need not follow one another.
    """
    w = W.partitionBy(key, month).orderBy(F.col(year).desc())
    ranked = panel.select(key, month, year, value, F.row_number().over(w).alias("rn"))
    pairs = ranked.groupBy(key, month).agg(
        F.count("*").alias("years"),
        F.min(year).alias("first_year"),
        *[F.max(F.when(F.col("rn") == n, F.col(c))).alias(a) for n, c, a in ((2, year, "before_year"), (1, year, "after_year"), (2, value, "before_value"), (1, value, "after_value"))],
    ).where("years >= 2")
    best = W.partitionBy(key).orderBy(F.col("years").desc(), F.col("first_year"), F.col(month))
    return pairs.withColumn("_r", F.row_number().over(best)).where("_r = 1").select(key, month, "before_year", "after_year", "before_value", "after_value")


def latest_arrivals(panel: DataFrame, key: str = "key", value: str = "value") -> DataFrame:
    """The pair with its change in percent, null where the base is 0."""
    return arrivals_pair(panel, key, value).withColumn("change_pct", pct_change("after_value", "before_value"))


def line_points(df: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """(key, x, value): x runs from 0 to 1 along the order; a single point is at 0."""
    w = W.partitionBy(key).orderBy(*order)
    n = F.count("*").over(W.partitionBy(key))
    return df.select(key, ((F.row_number().over(w) - 1) / F.greatest(n - 1, F.lit(1))).alias("x"), col(value).alias("value"))


def axis_domain(df: DataFrame, value: str, pad: float = 0.12) -> DataFrame:
    """One row (low, high): from the smaller of 0 and the minimum to the maximum, padded by a share of the span."""
    low, high = F.least(F.lit(0.0), F.min(value)), F.max(value)
    return df.agg((low - (high - low) * pad).alias("low"), (high + (high - low) * pad).alias("high"))


