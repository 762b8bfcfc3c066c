"""The test tables read as titles, availability, snapshots and panels, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlight.operators import visibility as vis
from spanlight.sources.tables import read_table


def titles(spark: SparkSession, d: str) -> DataFrame:
    p = read_table(spark, d, "part")
    return p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_retailprice").alias("popularity"), F.col("p_partkey").alias("ordinal"))


def theme_store(spark: SparkSession, d: str) -> DataFrame:
    """Parts of size 50 are not classified; one brand has its theme set by hand."""
    p = read_table(spark, d, "part").where("p_size < 50")
    human = F.when(F.col("p_brand") == "Brand#7", F.lit("PROMO"))
    return p.select(F.col("p_partkey").alias("id"), F.col("p_type").alias("model_theme"), (F.col("p_size") * 2).alias("model_confidence"), human.alias("override_theme"))


def tag_store(spark: SparkSession, d: str) -> DataFrame:
    """Words of the name are detected tags; two brands have tags set by hand, one of them to none."""
    p = read_table(spark, d, "part")
    human = F.when(F.col("p_brand") == "Brand#3", F.array().cast("array<string>")).when(F.col("p_brand") == "Brand#4", F.array(F.lit("curated")))
    return p.select(F.col("p_partkey").alias("id"), F.split("p_name", " ").alias("auto_tags"), human.alias("human_tags"))


def sales(spark: SparkSession, d: str) -> DataFrame:
    """(id, country, access), a row for each sale of a part; return flags stand for access types."""
    lines = read_table(spark, d, "lineitem").select("l_orderkey", F.col("l_partkey").alias("id"), "l_returnflag")
    orders = read_table(spark, d, "orders").select("o_orderkey", "o_custkey")
    customers = read_table(spark, d, "customer").select("c_custkey", "c_nationkey")
    nations = read_table(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("country"))
    where = customers.join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    placed = orders.join(where, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "country")
    access = F.when(F.col("l_returnflag") == "A", "flatrate").when(F.col("l_returnflag") == "R", "free").otherwise("rent")
    return lines.join(placed, F.col("l_orderkey") == F.col("o_orderkey")).select("id", "country", access.alias("access"))


def availability(spark: SparkSession, d: str) -> DataFrame:
    return sales(spark, d).distinct()


def reach(spark: SparkSession, d: str) -> DataFrame:
    return vis.streamable(sales(spark, d))


def themed(spark: SparkSession, d: str) -> DataFrame:
    return vis.with_themes(titles(spark, d), theme_store(spark, d))


def tagged(spark: SparkSession, d: str) -> DataFrame:
    return vis.with_tags(titles(spark, d), tag_store(spark, d))


def facts(spark: SparkSession, d: str) -> DataFrame:
    return reach(spark, d).join(themed(spark, d), "id")


def totals(spark: SparkSession, d: str) -> DataFrame:
    return vis.visibility(facts(spark, d))


def credits(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "lineitem").select(F.col("l_suppkey").alias("person"), F.col("l_partkey").alias("id")).distinct()


def membership(spark: SparkSession, d: str) -> DataFrame:
    n, r = read_table(spark, d, "nation"), read_table(spark, d, "region")
    return n.join(r, n["n_regionkey"] == r["r_regionkey"]).select(F.col("n_name").alias("country"), F.col("r_name").alias("continent"))


def places(spark: SparkSession, d: str) -> DataFrame:
    """Coordinates made from nation keys; the last nation has none."""
    n = read_table(spark, d, "nation")
    key = F.col("n_nationkey")
    return n.select(F.col("n_name").alias("country"), F.when(key < 24, (key * 7 % 50).cast("double")).alias("lat"), (key * 11 % 90 - 45).cast("double").alias("lng"))


def history(spark: SparkSession, d: str, key: str = "user_id") -> DataFrame:
    e = read_table(spark, d, "events")
    return e.select(F.col(key).alias("key"), "ts", F.col("value").alias("score"), "event_id")


def arrivals(spark: SparkSession, d: str) -> DataFrame:
    """(key, year, month, value): orders per nation and month."""
    o, c = read_table(spark, d, "orders"), read_table(spark, d, "customer")
    joined = o.join(c, o["o_custkey"] == c["c_custkey"])
    return joined.groupBy(F.col("c_nationkey").alias("key"), F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month")).agg(F.count("*").alias("value"))


def order_samples(spark: SparkSession, d: str) -> DataFrame:
    o, c = read_table(spark, d, "orders"), read_table(spark, d, "customer")
    return o.join(c, o["o_custkey"] == c["c_custkey"]).select(F.col("c_nationkey").alias("key"), F.col("o_orderdate").alias("ts"), F.col("o_totalprice").alias("score"))


#: The moment at which the queries look back.
NOW = "TIMESTAMP_NTZ '2024-01-31 00:00:00'"
NOW_ORDERS = "TIMESTAMP_NTZ '2001-08-02 00:00:00'"

SQL = """
avail AS (SELECT DISTINCT l_partkey AS id, n_name AS country, l_returnflag AS flag
          FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
reach AS (SELECT DISTINCT id, country FROM avail WHERE flag IN ('A', 'R')),
themed AS (SELECT p_partkey AS id, p_name AS name, p_retailprice AS popularity, p_partkey AS ordinal,
                  CASE WHEN p_size < 50 AND p_brand = 'Brand#7' THEN 'PROMO' WHEN p_size < 50 THEN p_type ELSE 'other' END AS theme,
                  (CASE WHEN p_size < 50 AND p_brand = 'Brand#7' THEN 100 WHEN p_size < 50 THEN p_size * 2 ELSE 0 END)::INT AS confidence,
                  (p_size < 50 AND p_brand = 'Brand#7') AS is_human
           FROM part),
tagged AS (SELECT p_partkey AS id, p_retailprice AS popularity,
                  CASE WHEN p_brand = 'Brand#3' THEN []::VARCHAR[] WHEN p_brand = 'Brand#4' THEN ['curated'] ELSE string_split(p_name, ' ') END AS tags FROM part),
facts AS (SELECT country, t.* FROM reach JOIN themed t USING (id)),
by_theme AS (SELECT country, theme, sum(popularity::DECIMAL(24, 4)) AS score, count(*) AS titles, max(confidence) AS confidence, min(ordinal) AS first FROM facts GROUP BY 1, 2),
best_theme AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY country ORDER BY score DESC, first) AS r FROM by_theme) WHERE r = 1),
best_title AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY country ORDER BY popularity DESC, ordinal) AS r FROM facts) WHERE r = 1),
totals AS (SELECT f.country, f.score, f.title_count, t.id AS top_id, t.name AS top_name, b.theme AS dominant_theme, b.confidence AS theme_confidence, b.confidence < 70 AS theme_uncertain
           FROM (SELECT country, sum(popularity::DECIMAL(24, 4))::DOUBLE AS score, count(*) AS title_count FROM facts GROUP BY 1) f
           JOIN best_title t ON f.country = t.country JOIN best_theme b ON f.country = b.country),
credits AS (SELECT DISTINCT l_suppkey AS person, l_partkey AS id FROM lineitem),
membership AS (SELECT n_name AS country, r_name AS continent FROM nation JOIN region ON n_regionkey = r_regionkey),
places AS (SELECT n_name AS country, CASE WHEN n_nationkey < 24 THEN (n_nationkey * 7 % 50)::DOUBLE END AS lat, (n_nationkey * 11 % 90 - 45)::DOUBLE AS lng FROM nation),
arrivals AS (SELECT c_nationkey AS key, year(o_orderdate)::INT AS year, month(o_orderdate)::INT AS month, count(*) AS value FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3),
samples AS (SELECT c_nationkey AS key, o_orderdate AS ts, o_totalprice AS score FROM orders JOIN customer ON o_custkey = c_custkey),
month_avg AS (SELECT key, year(ts)::INT AS year, month(ts)::INT AS month, floor(sum(score::DECIMAL(24, 4))::DOUBLE / count(*) * 10.0 + 0.5) / 10.0 AS avg_score, count(*) AS sample_count FROM samples GROUP BY 1, 2, 3),
monthly AS (SELECT * FROM month_avg WHERE year * 12 + month < 2001 * 12 + 8),
current AS (SELECT * FROM month_avg WHERE year = 2001 AND month = 8)
"""


def sql(tail: str, more: str = "") -> str:
    return f"WITH {SQL}{', ' + more if more else ''} {tail}"
