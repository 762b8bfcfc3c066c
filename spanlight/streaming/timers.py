"""Rules that go by event time, on keyed state: one marker for all keys, retries that fall due, values that expire.

What Spark's own windows can hold they hold. A rule that needs the rows of a key in order has them wait in the state store until the
watermark has passed, with one timer for a key, so it sees them in time order, whatever the order of arrival; a key with very many rows
keeps them by spans of time, and memory does not depend on the rows of a trigger.
State lives in the RocksDB store (``streaming.run`` selects it). Rows older than the watermark are dropped by the engine.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: ``(state, millisecond, rows) -> (state, outputs)``. The last number of a state is the moment to be woken at, or -1; a state of None
#: is cleared. Rows are (microseconds, number) in order, and none where the rule asked to be woken.
Step = Callable[[tuple | None, int, list[tuple[int, int]]], tuple[tuple | None, list[tuple]]]


def in_time_order(rows: DataFrame, step: Step, state: str, output: str, span_ms: int = 3_600_000, most: int = 100_000) -> DataFrame:
    """Apply ``step`` to a stream of (key, ts, number) with a watermark on ``ts`` and return (key, outputs…); ``state``: longs.

    A key's state is one value: that of the rule, its timer, and the rows that wait, so a key costs a few calls to the store in a trigger,
    however its rows are spread over time. Beyond ``most`` rows they wait in parts of spans of ``span_ms``, each written once, until
    all spans are past.
    """
    names = [part.split()[0] for part in output.split(", ")]
    unset = (0,) * len(state.split(", "))

    class Ordered(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.held = handle.getValueState("held", f"known boolean, {state}, timer long, parts long, flat array<long>")
            self.spans = handle.getMapState("spans", "upto long, part long", "flat array<long>")

        def load(self) -> tuple[tuple | None, int, int, list[int]]:
            """The rule's state, the moment of the timer (-1: none), the number of parts written (0: no spans), the rows that wait."""
            if not self.held.exists():
                return None, -1, 0, []
            known, *now, timer, parts, flat = self.held.get()
            return tuple(now) if known else None, timer, parts, list(flat)

        def store(self, now: tuple | None, timer: int, parts: int, flat: list[int], upto: int | None) -> None:
            """Keep the state; ``upto`` is the next moment at which there is something to do."""
            if upto is not None and (timer < 0 or upto < timer):
                self.handle.registerTimer(timer := upto)
            if now is None and not flat and not parts:
                self.held.clear()
            else:
                self.held.update((now is not None, *(now or unset), timer, parts, flat))

        def spill(self, parts: int, flat: list[int]) -> int:
            spans: dict[int, list[int]] = {}
            for micros, number in zip(flat[::2], flat[1::2], strict=True):
                spans.setdefault((micros // 1000 // span_ms + 1) * span_ms, []).extend((micros, number))
            for upto, part in spans.items():
                self.spans.updateValue((upto, parts), (part,))
            return parts + 1

        def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:  # noqa: N802, N803
            now, timer, parts, flat = self.load()
            first = None
            for row in rows:
                first = row.micros if first is None or row.micros < first else first
                flat += (row.micros, row.number)
                if len(flat) >= 2 * most:
                    parts, flat = self.spill(parts, flat), []
            if parts and flat:
                parts, flat = self.spill(parts, flat), []
            if first is not None:
                at = first // 1000
                self.store(now, timer, parts, flat, (at // span_ms + 1) * span_ms if parts else at + 1)
            return iter(())

        def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[Row]:  # noqa: N802, N803
            now, timer, parts, flat = self.load()
            if timer == expiredTimerInfo.getExpiryTimeInMs():
                timer = -1
            # Rows before the watermark are all here, as later ones are dropped. Spans are taken whole.
            limit = timerValues.getCurrentWatermarkInMs()
            limit = limit // span_ms * span_ms if parts else limit
            waiting: dict[int, list[int]] = {}
            for upto, part in self.spans.keys() if parts else ():
                waiting.setdefault(upto, []).append(part)

            def ready() -> Iterator[list[tuple[int, int]]]:
                nonlocal flat
                pairs = list(zip(flat[::2], flat[1::2], strict=True))
                flat = [x for pair in pairs if pair[0] // 1000 >= limit for x in pair]
                yield sorted(pair for pair in pairs if pair[0] // 1000 < limit)
                for upto in sorted(u for u in waiting if u <= limit):
                    pairs = []
                    for part in waiting.pop(upto):
                        one = list(self.spans.getValue((upto, part))[0])
                        pairs += zip(one[::2], one[1::2], strict=True)
                        self.spans.removeKey((upto, part))
                    yield sorted(pairs)

            def wake(upto: int) -> list[tuple]:
                nonlocal now
                made = []
                while now and 0 <= now[-1] <= upto:
                    now, out = step(now, now[-1], [])
                    made += out
                return made

            def told(made: list[tuple]) -> Iterator[Row]:
                return (Row(**dict(zip(["key", *names], [key[0], *out], strict=True))) for out in made)

            for pairs in ready():
                for ms, same in groupby(pairs, lambda r: r[0] // 1000):
                    yield from told(wake(ms))
                    now, out = step(now, ms, list(same))
                    yield from told(out)
            yield from told(wake(limit - 1))
            parts = parts if waiting else 0
            nexts = [min(waiting)] if waiting else [min(flat[::2]) // 1000 + 1] if flat else []
            if now and now[-1] >= 0:
                nexts.append((now[-1] // span_ms + 1) * span_ms if parts else now[-1] + 1)
            self.store(now, timer, parts, flat, min(nexts, default=None))

        def close(self) -> None:
            pass

    timed = rows.select("key", "ts", F.unix_micros("ts").alias("micros"), "number")
    return timed.groupBy("key").transformWithState(Ordered(), f"key string, {output}", "append", "EventTime")


def one_marker(events: DataFrame, ts: str, hours: float = 12.0, late: str = "1 day", span_s: int = 600) -> DataFrame:
    """Streaming: (ts) of the accepted moments. A moment is accepted if ``hours`` have passed since the last accepted one, of any key.

    Spark gathers the distinct moments of each span of ``span_s`` seconds and gives a span out once it is past, so the one marker meets
    a row for each span and never waits for more. The spans of a trigger are laid into the state store, and the walk takes them in
    order and reads those only in which a moment can be accepted: memory depends on the moments of a span. Rows of the moments are
    found by joining the result with the table (``rows_at``).
    """
    gap, width = int(hours * 3_600_000_000), span_s * 1_000_000

    class Marker(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.last = handle.getValueState("last", "last long")
            self.spans = handle.getMapState("spans", "begins long", "moments array<long>")

        def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:  # noqa: N802, N803
            last = self.last.get()[0] if self.last.exists() else None
            for row in rows:
                if last is None or row.begins + width > last + gap:
                    self.spans.updateValue((row.begins,), (row.moments,))
            for begins in sorted(k[0] for k in self.spans.keys()):
                if last is not None and begins + width <= last + gap:
                    continue
                moments = self.spans.getValue((begins,))[0]
                at = 0 if last is None else bisect_left(moments, last + gap)
                while at < len(moments):
                    last = moments[at]
                    yield Row(micros=last)
                    at = bisect_left(moments, last + gap, at + 1)
            self.spans.clear()
            if last is not None:
                self.last.update((last,))

        def close(self) -> None:
            pass

    timed = events.select(F.col(ts).cast("timestamp").alias("ts")).withWatermark("ts", late).groupBy(F.window("ts", f"{span_s} seconds").alias("span"))
    spans = timed.agg(F.sort_array(F.collect_set(F.unix_micros("ts"))).alias("moments"))
    rows = spans.select(F.lit("").alias("key"), F.window_time("span").alias("ts"), F.unix_micros("span.start").alias("begins"), "moments")
    return rows.groupBy("key").transformWithState(Marker(), "micros long", "append", "EventTime").select(F.timestamp_micros("micros").alias("ts"))


def one_marker_batch(events: DataFrame, ts: str, hours: float = 12.0) -> DataFrame:
    """The same for a table: the distinct moments are sorted by ranges and walked once, eight bytes each, in constant memory.

    Each decision needs the one before, so the walk is one task; it reads moments only, never rows.
    """
    gap = int(hours * 3_600_000_000)

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last = None
        for pdf in batches:
            kept, times = [], pdf["micros"].to_numpy()
            at = 0
            while at < len(times):
                at = at if last is None else max(at, int(times.searchsorted(last + gap)))
                if at < len(times):
                    last = int(times[at])
                    kept.append(last)
                    at += 1
            yield pd.DataFrame({"micros": kept}, dtype="int64")

    moments = events.where(F.col(ts).isNotNull()).select(F.unix_micros(F.col(ts).cast("timestamp")).alias("micros")).distinct()
    return moments.orderBy("micros").coalesce(1).mapInPandas(walk, "micros long").select(F.timestamp_micros("micros").alias("ts"))


def rows_at(events: DataFrame, ts: str, moments: DataFrame) -> DataFrame:
    """The rows of the accepted moments; at most one moment for each gap, so the other side is small, and Spark decides by its size."""
    return events.join(moments.select(F.col("ts").alias("_at")), F.col(ts).cast("timestamp") == F.col("_at"), "left_semi")


def _keyed(rows: DataFrame, late: str) -> DataFrame:
    """Rows with a key; those without count for the watermark only (the condition names ``ts``, so it stays behind the watermark)."""
    return rows.withWatermark("ts", late).where("key is not null or ts is null")


def retries_due(
    attempts: DataFrame, key: str, ts: str, ok: Column, order: Column, base_ms: int = 300_000, most_ms: int = 21_600_000, late: str = "1 day", most: int = 100_000
) -> DataFrame:
    """Streaming: (key, failure_count, due_ms) when the retry of a failed key falls due.

    The wait doubles with each failure since the last success, up to ``most_ms``. An attempt before that moment takes the place of the
    retry; success clears the key's state. Rows without a key go. Attempts of one moment go by ``order`` (long, from 0 up to 2 ** 62).
    A key with more than ``most`` rows that wait keeps them by spans.
    """

    def step(held: tuple | None, ms: int, rows: list[tuple[int, int]]) -> tuple[tuple | None, list[tuple]]:
        count, due = held or (0, -1)
        made = [(count, ms)] if count and due == ms else []
        for _, number in rows:
            count = 0 if number % 2 else count + 1
        if not count:
            return None, made
        return (count, ms + min(most_ms, base_ms * 2 ** min(count - 1, 40)) if rows else -1), made

    number = order.cast("long") * 2 + ok.cast("long")
    rows = attempts.select(F.col(key).cast("string").alias("key"), F.col(ts).cast("timestamp").alias("ts"), number.alias("number"))
    return in_time_order(_keyed(rows, late), step, "count long, due long", "failure_count long, due_ms long", most=most)


def expiries(puts: DataFrame, key: str, ts: str, ttl_ms: int, late: str = "1 day") -> DataFrame:
    """Streaming: (key, expired_ms) of each value that outlived its time; ``expired_ms`` is its last good moment.

    A put keeps the value until ``ttl_ms`` later, that moment included (a value is past its time when now > expires), and one
    that comes until then renews it. So the life of a value is a session of its key's puts, which Spark keeps, merges and clears
    on expiry by itself: keys that are gone cost nothing, and no row goes through Python. Times are whole milliseconds, as is the
    last good moment; half a millisecond more on the gap sets the end of a life between that moment and the next one. Rows
    without a key go.
    """
    at = F.timestamp_millis(F.unix_millis(F.col(ts).cast("timestamp")))
    rows = _keyed(puts.select(F.col(key).cast("string").alias("key"), at.alias("ts")), late)
    lives = rows.groupBy("key", F.session_window("ts", f"{ttl_ms * 1000 + 500} microseconds").alias("life")).agg(F.count("*").alias("_n"))
    return lives.select("key", F.unix_millis("life.end").alias("expired_ms"))
