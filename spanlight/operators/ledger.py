"""Work that is pending, retries, expiry and limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanlight.functions.scalars import backoff_ms, millis


def pending(items: DataFrame, store: DataFrame, failures: DataFrame, now: Column, id_col: str = "id", settled: Column | None = None) -> DataFrame:
    """Items without a settled entry in the store whose retry time, if any, has come."""
    done = store if settled is None else store.where(settled)
    open_ = items.join(done.select(id_col), id_col, "left_anti").join(failures.select(id_col, "next_retry_at"), id_col, "left")
    return open_.where(F.col("next_retry_at").isNull() | (F.col("next_retry_at") <= now)).drop("next_retry_at")


def failure_ledger(attempts: DataFrame, key: str = "key", ts: str = "ts", ok: str = "ok") -> DataFrame:
    """(key, failure_count, last_failed_at, next_retry_ms): failures since the last success; keys without any are gone."""
    last_ok = F.max(F.when(F.col(ok), F.col(ts)))
    marks = attempts.groupBy(key).agg(last_ok.alias("last_ok"))
    failed = attempts.join(marks, key).where(~F.col(ok) & (F.col("last_ok").isNull() | (F.col(ts) > F.col("last_ok"))))
    counted = failed.groupBy(key).agg(F.count("*").alias("failure_count"), F.max(ts).alias("last_failed_at"))
    return counted.withColumn("next_retry_ms", millis("last_failed_at") + backoff_ms("failure_count"))


def health(items: DataFrame, store: DataFrame, failures: DataFrame, now: Column, id_col: str = "id") -> DataFrame:
    """One row: total, classified, pending, delayed and ready retries, last failure; only stored rows of live items count."""
    live = items.select(id_col).distinct()
    total = live.agg(F.count("*").alias("total"))
    classified = store.join(live, id_col, "left_semi").agg(F.count("*").alias("classified"))
    due = F.col("next_retry_at").isNull() | (F.col("next_retry_at") <= now)
    tried = failures.join(live, id_col, "left_semi").agg(
        F.count_if(~due).alias("delayed_retries"), F.count_if(due).alias("retry_ready"), F.max("last_failed_at").alias("last_failed_at")
    )
    row = total.join(F.broadcast(classified)).join(F.broadcast(tried))  # one row each
    return row.select("total", "classified", F.greatest(F.lit(0), F.col("total") - F.col("classified")).alias("pending"), "delayed_retries", "retry_ready", "last_failed_at")


def expired(rows: DataFrame, now: Column, expires_at: str = "expires_at") -> DataFrame:
    """Rows past their time; the very moment of expiry is not past."""
    return rows.where(now > F.col(expires_at))


def cache_info(rows: DataFrame, now: Column, key: str = "key") -> DataFrame:
    return rows.select(key, "updated_at", "expires_at", (now <= F.col("expires_at")).alias("is_fresh"))


def over_limit(events: DataFrame, most: int, minutes: int, key: str = "key", ts: str = "ts") -> DataFrame:
    """(key, window_start, attempts) of fixed windows in which a key went over its limit."""
    w = F.window(F.col(ts).cast("timestamp"), f"{minutes} minutes")
    counted = events.groupBy(key, w.alias("w")).agg(F.count("*").alias("attempts")).where(F.col("attempts") > most)
    return counted.select(key, F.col("w.start").cast("timestamp_ntz").alias("window_start"), "attempts")


def existing(rows: DataFrame, condition: Column) -> DataFrame:
    """One row (count, exists): how many rows there are that the condition holds for, null counting as not."""
    return rows.agg(F.count_if(condition).alias("count")).select("count", (F.col("count") > 0).alias("exists"))
