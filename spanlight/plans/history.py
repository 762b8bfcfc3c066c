"""Queries on snapshots, roll-ups, rankings and groups."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanlight.functions.scalars import half_up
from spanlight.operators import ranking as rank
from spanlight.operators import temporal as tm
from spanlight.plans import bindings as b
from spanlight.plans.bindings import NOW, NOW_ORDERS, sql
from spanlight.sources.tables import read_table
from spanlight.streaming import gates, timers
from spanlight.streaming.run import drain


def now():
    return F.expr(NOW)


def now_orders():
    return F.expr(NOW_ORDERS)


def current_scores(spark, d):
    """The newest score of each user stands for the score of now."""
    newest = tm.keep_last(b.history(spark, d), 1, order=["ts", "event_id"])
    return newest.select("key", "score")


def older(spark, d):
    return b.history(spark, d).where("ts < TIMESTAMP_NTZ '2024-01-30 00:00:00'")


def trended(spark, d):
    return tm.trends(current_scores(spark, d), older(spark, d), now())


def single_trend(spark, d):
    """One series: the mean of all events of a day, limits of 1 %."""
    days = read_table(spark, d, "events").groupBy(F.date_trunc("day", "ts").cast("timestamp_ntz").alias("ts")).agg(half_up(F.sum(F.col("value").cast("decimal(24,4)")).cast("double") / F.count("*"), 1).alias("score"))
    days = days.withColumn("key", F.lit("global"))
    current = tm.keep_last(days, 1).select("key", "score")
    return tm.trends(current, days, now(), limit=1.0)


def monthly(spark, d):
    return tm.monthly_rollup(b.order_samples(spark, d), now_orders())


def current(spark, d):
    return tm.current_month(b.order_samples(spark, d), now_orders())


def global_months(spark, d):
    return tm.global_monthly(monthly(spark, d), current(spark, d))


def country_scores(spark, d):
    return b.totals(spark, d).select("country", "score")


def continents(spark, d):
    """All regions and one that is empty."""
    extra = spark.createDataFrame([("ANTARCTICA",)], "continent string")
    return b.membership(spark, d).select("continent").distinct().unionByName(extra)


def gate_source(spark, d):
    return read_table(spark, d, "events")


def run_gate(spark, d):
    build = lambda s: gates.snapshot_gate(s, F.col("event_type"), "ts", "value", 12.0)
    return drain(spark, d, "events", build).select("key", F.col("ts").cast("timestamp_ntz").alias("ts"), "score")


def run_tumbling(spark, d):
    made = drain(spark, d, "events", lambda e: gates.tumbling(e, "ts", ["event_type"], "value"), ts="ts")
    return made.select("event_type", F.col("window_start").cast("timestamp_ntz").alias("window_start"), "n", half_up("total", 2).alias("total"))


def run_sessions(spark, d):
    made = drain(spark, d, "events", lambda e: gates.sessions(e, "ts", ["user_id"]), ts="ts")
    return made.select("user_id", *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("session_start", "session_end")], "n")


def marked_rows(spark, d, moments):
    """The rows of the accepted moments, users as keys."""
    found = timers.rows_at(gate_source(spark, d), "ts", moments)
    return found.select(F.col("user_id").alias("key"), F.col("ts").cast("timestamp_ntz").alias("ts"), F.col("value").alias("score"))


def run_one_marker(spark, d):
    return marked_rows(spark, d, drain(spark, d, "events", lambda e: timers.one_marker(e, "ts"), ts="ts"))


def run_retries(spark, d):
    made = drain(spark, d, "events", lambda e: timers.retries_due(e, "user_id", "ts", F.col("event_type") != "error", F.col("event_id")), ts="ts")
    return made.select(F.col("key").cast("long").alias("key"), "failure_count", "due_ms")


def run_expiries(spark, d):
    made = drain(spark, d, "events", lambda e: timers.expiries(e, "user_id", "ts", 86_400_000), ts="ts")
    return made.select(F.col("key").cast("long").alias("key"), "expired_ms")


def angles(spark, d):
    made = rank.donut_angles(rank.top_with_remainder(country_scores(spark, d), 5, "score", "country"), "value", "label")
    return made.select("label", *[half_up(c, 6).alias(c) for c in ("start", "end", "mid")])


QUERIES = {
    "trend_reference": lambda s, d: tm.reference_snapshot(older(s, d), now()),
    "trend_direction": trended,
    "trend_single_series": single_trend,
    "trend_counts": lambda s, d: rank.trend_counts(trended(s, d)),
    "last_n_snapshots": lambda s, d: tm.keep_last(b.history(s, d), 60, order=["ts", "event_id"]).select("key", "ts", "score", "event_id"),
    "sparkline": lambda s, d: tm.sparkline(tm.keep_last(b.history(s, d), 20, order=["ts", "event_id"]), order=["ts", "event_id"]).select("key", F.col("position").cast("long").alias("position"), half_up("t", 6).alias("t"), "rising"),
    "monthly_rollup": monthly,
    "monthly_rollup_new": lambda s, d: tm.monthly_rollup(b.order_samples(s, d), now_orders(), rolled=monthly(s, d).where("year < 2001").select("key", "year", "month")),
    "current_month": current,
    "yearly_rollup": lambda s, d: tm.yearly_rollup(monthly(s, d)),
    "global_monthly": global_months,
    "global_yearly": lambda s, d: tm.global_yearly(global_months(s, d)),
    "monthly_periods": lambda s, d: tm.monthly_periods(monthly(s, d), current(s, d)),
    "arrivals_pair": lambda s, d: tm.arrivals_pair(b.arrivals(s, d)),
    "latest_arrivals": lambda s, d: tm.latest_arrivals(b.arrivals(s, d)),
    "period_line": lambda s, d: tm.line_points(monthly(s, d), "key", ["year", "month"], "avg_score").select("key", half_up("x", 6).alias("x"), "value"),
    "axis_domain": lambda s, d: tm.axis_domain(monthly(s, d), "avg_score").select(half_up("low", 2).alias("low"), half_up("high", 2).alias("high")),
    "topk_with_remainder": lambda s, d: rank.top_with_remainder(country_scores(s, d), 5, "score", "country"),
    "rising_topk": lambda s, d: rank.rising(trended(s, d), 5),
    "rising_tracked": lambda s, d: rank.rising_tracked(trended(s, d), b.arrivals(s, d).select(F.col("key").cast("long").alias("key"))),
    "donut_angles": angles,
    "rank_bars": lambda s, d: rank.rank_bars(country_scores(s, d).join(b.membership(s, d), "country"), "score", "country", ["continent"]).select("continent", F.col("rank").cast("long").alias("rank"), "label", "value", "width"),
    "share_pct": lambda s, d: rank.shares(country_scores(s, d), "score"),
    "continent_rollup": lambda s, d: rank.group_rollup(country_scores(s, d), continents(s, d), b.membership(s, d)),
    "continent_top_title": lambda s, d: rank.group_top_title(b.facts(s, d), b.membership(s, d)),
    "continent_spread": lambda s, d: rank.centroid_spread(b.places(s, d).where("lat is not null").join(b.membership(s, d), "country")),
    "stream_snapshot_gate": run_gate,
    "snapshot_gate": lambda s, d: gates.batch_gate(gate_source(s, d), F.col("event_type"), "ts", "value", 12.0).select("key", F.col("ts").cast("timestamp_ntz").alias("ts"), "score"),
    "one_marker_gate": lambda s, d: marked_rows(s, d, timers.one_marker_batch(gate_source(s, d), "ts")),
    "stream_one_marker_gate": run_one_marker,
    "stream_retries_due": run_retries,
    "stream_expiries": run_expiries,
    "stream_tumbling": run_tumbling,
    "tumbling": lambda s, d: gates.tumbling(gate_source(s, d), "ts", ["event_type"], "value").select("event_type", F.col("window_start").cast("timestamp_ntz").alias("window_start"), "n", half_up("total", 2).alias("total")),
    "stream_session": run_sessions,
    "sessions": lambda s, d: gates.sessions(gate_source(s, d), "ts", ["user_id"]).select("user_id", *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("session_start", "session_end")], "n"),
}

TREND = """
h AS (SELECT user_id AS key, ts, value AS score, event_id FROM events),
cur AS (SELECT key, score FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts DESC, event_id DESC) AS r FROM h) WHERE r = 1),
old AS (SELECT * FROM h WHERE ts < TIMESTAMP '2024-01-30'),
ref AS (SELECT key, coalesce(max(ts) FILTER (WHERE ts <= TIMESTAMP '2024-01-24'), min(ts)) AS ref_ts FROM old GROUP BY key),
refs AS (SELECT r.key, ref_ts, o.score AS ref_score FROM ref r JOIN old o ON r.key = o.key AND r.ref_ts = o.ts),
t AS (SELECT cur.key, cur.score, ref_ts, ref_score, epoch_ms(TIMESTAMP '2024-01-31') - epoch_ms(ref_ts) AS age,
             CASE WHEN ref_score = 0 THEN 0.0 ELSE floor((cur.score - ref_score) / ref_score * 100.0 * 10.0 + 0.5) / 10.0 END AS change FROM cur LEFT JOIN refs ON cur.key = refs.key),
trended AS (SELECT key, score, CASE WHEN ref_ts IS NULL OR age < 86400000 THEN 'insufficient' WHEN change >= 5 THEN 'rising' WHEN change <= -5 THEN 'falling' ELSE 'flat' END AS direction,
                   CASE WHEN age >= 86400000 THEN change END AS change_pct, CASE WHEN age >= 86400000 THEN floor(age / 86400000.0 + 0.5)::INT END AS window_days FROM t)
"""
GATE = """
WITH RECURSIVE g AS (
  SELECT event_type AS key, min(ts) AS ts FROM events GROUP BY 1
  UNION ALL
  SELECT key, ts FROM (SELECT g.key, min(e.ts) AS ts FROM g JOIN events e ON e.event_type = g.key AND e.ts >= g.ts + INTERVAL 12 HOURS GROUP BY g.key))
SELECT g.key, g.ts, e.value AS score FROM g JOIN events e ON e.event_type = g.key AND e.ts = g.ts
"""
MARKER = """
WITH RECURSIVE g AS (
  SELECT min(ts) AS ts FROM events
  UNION ALL
  SELECT ts FROM (SELECT min(e.ts) AS ts FROM g JOIN events e ON e.ts >= g.ts + INTERVAL 12 HOURS) WHERE ts IS NOT NULL)
SELECT user_id AS key, e.ts, value AS score FROM g JOIN events e ON e.ts = g.ts
"""
TUMBLING = "SELECT event_type, date_trunc('day', ts)::TIMESTAMP AS window_start, count(*) AS n, floor(sum(value) * 100.0 + 0.5) / 100.0 AS total FROM events GROUP BY 1, 2"
SESSIONS = """
WITH x AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 2 HOURS THEN 0 ELSE 1 END AS new FROM events),
y AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM x)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 2 HOURS AS session_end, count(*) AS n FROM y GROUP BY user_id, s
"""
GLOBAL = """
gm AS (SELECT year, month, floor(sum(avg_score::DECIMAL(24, 4))::DOUBLE * 10.0 + 0.5) / 10.0 AS total_score, count(*) AS key_count, false AS is_current FROM monthly GROUP BY 1, 2
       UNION ALL SELECT year, month, floor(sum(avg_score::DECIMAL(24, 4))::DOUBLE * 10.0 + 0.5) / 10.0, count(*), true FROM current GROUP BY 1, 2)
"""
PAIR = """
pr AS (SELECT *, row_number() OVER (PARTITION BY key, month ORDER BY year DESC) AS rn FROM arrivals),
pm AS (SELECT key, month, count(*) AS years, min(year) AS fy, max(year) FILTER (WHERE rn = 2) AS before_year, max(year) FILTER (WHERE rn = 1) AS after_year,
              max(value) FILTER (WHERE rn = 2) AS before_value, max(value) FILTER (WHERE rn = 1) AS after_value FROM pr GROUP BY 1, 2 HAVING count(*) >= 2),
pair AS (SELECT key, month, before_year, after_year, before_value, after_value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY years DESC, fy, month) AS r FROM pm) WHERE r = 1)
"""
TOP = """
rt AS (SELECT country AS label, floor(score * 10.0 + 0.5) / 10.0 AS value FROM totals),
tk AS (SELECT row_number() OVER (ORDER BY value DESC, label)::INT AS rank, label, value FROM rt QUALIFY rank <= 5),
top5 AS (SELECT * FROM tk UNION ALL SELECT 6, 'others', greatest(0.0, floor(((SELECT floor(sum(score::DECIMAL(24, 4))::DOUBLE * 10.0 + 0.5) / 10.0 FROM totals) - (SELECT sum(value::DECIMAL(24, 4))::DOUBLE FROM tk)) * 10.0 + 0.5) / 10.0))
"""

ORACLES = {
    "trend_reference": sql("SELECT * FROM refs", TREND),
    "trend_direction": sql("SELECT * FROM trended", TREND),
    "trend_single_series": """
WITH d AS (SELECT date_trunc('day', ts)::TIMESTAMP AS ts, floor(sum(value::DECIMAL(24, 4))::DOUBLE / count(*) * 10.0 + 0.5) / 10.0 AS score FROM events GROUP BY 1),
x AS (SELECT (SELECT score FROM d ORDER BY ts DESC LIMIT 1) AS score, ts AS ref_ts, d.score AS ref_score FROM d WHERE ts <= TIMESTAMP '2024-01-24' ORDER BY ts DESC LIMIT 1),
y AS (SELECT *, floor((score - ref_score) / ref_score * 100.0 * 10.0 + 0.5) / 10.0 AS c FROM x)
SELECT 'global' AS key, score, CASE WHEN c >= 1 THEN 'rising' WHEN c <= -1 THEN 'falling' ELSE 'flat' END AS direction, c AS change_pct,
       floor((epoch_ms(TIMESTAMP '2024-01-31') - epoch_ms(ref_ts)) / 86400000.0 + 0.5)::INT AS window_days FROM y
""",
    "trend_counts": sql("SELECT count(*) FILTER (WHERE direction = 'rising') AS rising, count(*) FILTER (WHERE direction = 'falling') AS falling, count(*) AS total, coalesce(bool_or(direction <> 'insufficient'), false) AS enough_history FROM trended", TREND),
    "last_n_snapshots": sql("SELECT key, ts, score, event_id FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts DESC, event_id DESC) AS r FROM h) WHERE r <= 60", TREND),
    "sparkline": sql(
        "SELECT key, position, floor((score - lo) / coalesce(nullif(hi - lo, 0), 1.0) * 1000000.0 + 0.5) / 1000000.0 AS t, l >= f AS rising FROM "
        "(SELECT key, score, row_number() OVER w AS position, min(score) OVER p AS lo, max(score) OVER p AS hi, count(*) OVER p AS n, first_value(score) OVER w AS f, "
        "last_value(score) OVER (PARTITION BY key ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS l FROM k WINDOW w AS (PARTITION BY key ORDER BY ts, event_id), p AS (PARTITION BY key)) WHERE n >= 2",
        TREND + ", k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts DESC, event_id DESC) AS r FROM h) WHERE r <= 20)",
    ),
    "monthly_rollup": sql("SELECT * FROM monthly"),
    "monthly_rollup_new": sql("SELECT * FROM monthly WHERE year >= 2001"),
    "current_month": sql("SELECT * FROM current"),
    "yearly_rollup": sql("SELECT key, year, floor(sum(avg_score::DECIMAL(24, 4))::DOUBLE / count(*) * 10.0 + 0.5) / 10.0 AS avg_score, count(*) AS months_covered, count(*) < 12 AS is_partial FROM monthly GROUP BY 1, 2"),
    "global_monthly": sql("SELECT * FROM gm", GLOBAL),
    "global_yearly": sql("SELECT year, floor(sum(total_score::DECIMAL(24, 4))::DOUBLE / count(*) * 10.0 + 0.5) / 10.0 AS avg_score, count(*) AS months_covered, count(*) < 12 AS is_partial FROM gm GROUP BY 1", GLOBAL),
    "monthly_periods": sql("SELECT key, printf('%04d-%02d', year, month) AS period, avg_score, sample_count, c AS is_current FROM (SELECT *, false AS c FROM monthly UNION ALL SELECT *, true FROM current)"),
    "arrivals_pair": sql("SELECT * FROM pair", PAIR),
    "latest_arrivals": sql("SELECT *, CASE WHEN before_value = 0 THEN NULL ELSE floor((after_value - before_value) / before_value * 100.0 * 10.0 + 0.5) / 10.0 END AS change_pct FROM pair", PAIR),
    "period_line": sql("SELECT key, floor((row_number() OVER (PARTITION BY key ORDER BY year, month) - 1) / greatest(count(*) OVER (PARTITION BY key) - 1, 1) * 1000000.0 + 0.5) / 1000000.0 AS x, avg_score AS value FROM monthly"),
    "axis_domain": sql("SELECT floor((lo - (hi - lo) * 0.12) * 100.0 + 0.5) / 100.0 AS low, floor((hi + (hi - lo) * 0.12) * 100.0 + 0.5) / 100.0 AS high FROM (SELECT least(0.0, min(avg_score)) AS lo, max(avg_score) AS hi FROM monthly)"),
    "topk_with_remainder": sql("SELECT * FROM top5", TOP),
    "rising_topk": sql("SELECT key, score, change_pct, window_days FROM trended WHERE direction = 'rising' ORDER BY change_pct DESC, key LIMIT 5", TREND),
    "rising_tracked": sql("SELECT key, score, change_pct, window_days FROM trended WHERE direction = 'rising' AND key IN (SELECT key FROM arrivals) ORDER BY change_pct DESC, key LIMIT 15", TREND),
    "donut_angles": sql(
        "SELECT label, floor((u - value) / t * 2 * pi() * 1000000.0 + 0.5) / 1000000.0 AS start, floor(u / t * 2 * pi() * 1000000.0 + 0.5) / 1000000.0 AS \"end\", floor(((u - value) / t * 2 * pi() + u / t * 2 * pi()) / 2 * 1000000.0 + 0.5) / 1000000.0 AS mid "
        "FROM (SELECT label, value, sum(value) OVER (ORDER BY value DESC, label ROWS UNBOUNDED PRECEDING) AS u, sum(value) OVER () AS t FROM top5)",
        TOP,
    ),
    "rank_bars": sql("SELECT continent, row_number() OVER (PARTITION BY continent ORDER BY score DESC, country) AS rank, country AS label, score AS value, floor(score / greatest(max(score) OVER (PARTITION BY continent), 1.0) * 100.0 * 10.0 + 0.5) / 10.0 AS width FROM totals JOIN membership USING (country)"),
    "share_pct": sql("SELECT country, score, floor(score / (SELECT sum(score::DECIMAL(24, 4))::DOUBLE FROM totals) * 100.0 * 10.0 + 0.5) / 10.0 AS share_pct FROM totals"),
    "continent_rollup": sql(
        "SELECT g.continent, coalesce(n, 0) AS country_count, coalesce(total, 0.0) AS total, coalesce(floor(total / n * 10.0 + 0.5) / 10.0, 0.0) AS average, top_country, coalesce(top_countries, '') AS top_countries "
        "FROM (SELECT r_name AS continent FROM region UNION ALL SELECT 'ANTARCTICA') g LEFT JOIN (SELECT continent, count(*) AS n, sum(score::DECIMAL(24, 4))::DOUBLE AS total, max(country) FILTER (WHERE r = 1) AS top_country, "
        "string_agg(country, ',' ORDER BY r) FILTER (WHERE r <= 5) AS top_countries FROM x GROUP BY 1) s ON g.continent = s.continent",
        "x AS (SELECT continent, country, score, row_number() OVER (PARTITION BY continent ORDER BY score DESC, country) AS r FROM totals JOIN membership USING (country))",
    ),
    "continent_top_title": sql(
        "SELECT continent, id, score, country_count FROM (SELECT *, row_number() OVER (PARTITION BY continent ORDER BY score DESC, id) AS r FROM "
        "(SELECT continent, id, sum(popularity::DECIMAL(24, 4))::DOUBLE AS score, count(*) AS country_count FROM facts JOIN membership USING (country) GROUP BY 1, 2)) WHERE r = 1"
    ),
    "continent_spread": sql(
        "SELECT continent, floor(lat * 10000.0 + 0.5) / 10000.0 AS lat, floor(lng * 10000.0 + 0.5) / 10000.0 AS lng, s AS spread, floor(greatest(0.5, least(2.5, s * 0.02)) * 10000.0 + 0.5) / 10000.0 AS altitude FROM "
        "(SELECT c.continent, c.lat, c.lng, floor(max(sqrt((p.lat - c.lat) * (p.lat - c.lat) + (p.lng - c.lng) * (p.lng - c.lng))) * 10000.0 + 0.5) / 10000.0 AS s FROM pl p JOIN "
        "(SELECT continent, sum(lat) / count(*) AS lat, sum(lng) / count(*) AS lng FROM pl GROUP BY 1) c ON p.continent = c.continent GROUP BY 1, 2, 3)",
        "pl AS (SELECT continent, lat, lng FROM places JOIN membership USING (country) WHERE lat IS NOT NULL)",
    ),
    "stream_snapshot_gate": GATE,
    "snapshot_gate": GATE,
    "one_marker_gate": MARKER,
    "stream_one_marker_gate": MARKER,
    "stream_retries_due": """
WITH a AS (SELECT user_id AS key, epoch_us(ts) // 1000 AS ms, ts, event_id, event_type <> 'error' AS ok FROM events),
r AS (SELECT *, sum(ok::INT) OVER w AS run, lead(ms) OVER w AS later FROM a WINDOW w AS (PARTITION BY key ORDER BY ts, event_id)),
c AS (SELECT *, row_number() OVER (PARTITION BY key, run ORDER BY ts, event_id) AS n FROM r WHERE NOT ok),
d AS (SELECT key, n AS failure_count, ms + least(21600000, 300000 * 2 ** least(n - 1, 40))::BIGINT AS due_ms, later FROM c)
SELECT key, failure_count, due_ms FROM d WHERE later IS NULL OR later >= due_ms
""",
    "stream_expiries": """
WITH a AS (SELECT user_id AS key, epoch_us(ts) // 1000 AS ms, lead(epoch_us(ts) // 1000) OVER (PARTITION BY user_id ORDER BY ts) AS later FROM events)
SELECT key, ms + 86400000 AS expired_ms FROM a WHERE later IS NULL OR later > ms + 86400000
""",
    "stream_tumbling": TUMBLING,
    "stream_session": SESSIONS,
    "tumbling": TUMBLING,
    "sessions": SESSIONS,
}
