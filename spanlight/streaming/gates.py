"""Stateful pieces on Structured Streaming: snapshot gate, windows, retries, expiry."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

SNAPSHOT = "key string, ts timestamp, score double"


def snapshot_gate(events: DataFrame, key: Column, ts: str, score: str, hours: float = 12.0) -> DataFrame:
    """Streaming: accept a snapshot if at least ``hours`` have passed since the last accepted one of its key.

    The recursion on accepted rows is the reason for state. Use a constant key for one marker for all keys. Rows
    of a trigger are taken in time order; rows that are older than the marker are not accepted.
    """
    gap = hours * 3600.0

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        # Rows before the next time that can be accepted never count, so they go before the rest is held and sorted.
        parts = [pdf if last is None else pdf[pdf["ts"].map(lambda t: t.timestamp() - last >= gap)] for pdf in batches]
        rows = pd.concat(parts).sort_values(["ts", "score"])
        keep = []
        for ts in rows["ts"]:
            at = ts.timestamp()
            keep.append(last is None or at - last >= gap)
            if keep[-1]:
                last = at
        if last is not None:
            state.update((last,))
        yield rows[keep][["key", "ts", "score"]]

    rows = events.select(key.cast("string").alias("key"), F.col(ts).cast("timestamp").alias("ts"), F.col(score).cast("double").alias("score"))
    return rows.groupBy("key").applyInPandasWithState(step, SNAPSHOT, "last double", "append", GroupStateTimeout.NoTimeout)


def batch_gate(events: DataFrame, key: Column, ts: str, score: str, hours: float = 12.0) -> DataFrame:
    """The same for a table. A task reads its keys in time order, batch by batch, and holds one marker, so the length
    of a key's history does not matter for memory; the walk along one key is sequential by nature."""
    gap = hours * 3600.0

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, last = None, None
        for pdf in batches:
            keep = []
            for k, ts in zip(pdf["key"], pdf["ts"], strict=True):
                if k != current:
                    current, last = k, None
                keep.append(last is None or (ts - last).total_seconds() >= gap)
                if keep[-1]:
                    last = ts
            yield pdf[keep]

    rows = events.select(key.cast("string").alias("key"), F.col(ts).cast("timestamp").alias("ts"), F.col(score).cast("double").alias("score"))
    return rows.repartition("key").sortWithinPartitions("key", "ts", "score").mapInPandas(walk, SNAPSHOT)


def tumbling(events: DataFrame, ts: str, keys: list[str], value: str, width: str = "1 day", late: str = "1 day") -> DataFrame:
    """Count and sum per key and window; works on streams and tables. Rows later than ``late`` are dropped from streams."""
    timed = events.withColumn(ts, F.col(ts).cast("timestamp"))
    return timed.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), *keys).agg(
        F.count("*").alias("n"), F.sum(value).alias("total")
    ).select(*keys, F.col("w.start").alias("window_start"), "n", "total")


def sessions(events: DataFrame, ts: str, keys: list[str], gap: str = "2 hours", late: str = "1 day") -> DataFrame:
    """Sessions of each key: rows no further apart than ``gap``."""
    timed = events.withColumn(ts, F.col(ts).cast("timestamp"))
    return timed.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), *keys).agg(F.count("*").alias("n")).select(
        *keys, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n"
    )


def retry_ledger(attempts: DataFrame, key: str, ts: str, ok: Column, base_ms: int = 300_000, most_ms: int = 21_600_000) -> DataFrame:
    """Streaming: after each trigger, (key, failure_count, last_failed_ms, next_retry_ms) of the keys it saw; success clears."""
    schema = "key string, failure_count long, last_failed_ms long, next_retry_ms long"

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        count, last = state.get if state.exists else (0, 0)
        for row in pd.concat(batches).sort_values("ts").itertuples():
            count, last = (0, 0) if row.ok else (count + 1, int(row.ts.timestamp() * 1000))
        if count:
            state.update((count, last))
        elif state.exists:
            state.remove()
        wait = min(most_ms, base_ms * 2 ** min(count - 1, 40)) if count else 0
        yield pd.DataFrame({"key": [key[0]], "failure_count": [count], "last_failed_ms": [last], "next_retry_ms": [last + wait if count else 0]})

    rows = attempts.select(F.col(key).cast("string").alias("key"), F.col(ts).cast("timestamp").alias("ts"), ok.alias("ok"))
    return rows.groupBy("key").applyInPandasWithState(step, schema, "failures long, last long", "update", GroupStateTimeout.NoTimeout)
