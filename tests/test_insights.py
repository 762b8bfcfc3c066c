"""Texts on distributions, remembered by fingerprint."""

import datetime

from pyspark.sql import functions as F

from spanlight.operators import text, visibility

CACHE = "fingerprint string, insight string, generated_at timestamp_ntz, expires_at timestamp_ntz"
NOW = datetime.datetime(2024, 1, 31)
SECOND = datetime.timedelta(seconds=1)


def told(spark, cache, narrate):
    rows = [("a", "x", 1), ("a", "y", 2), ("b", "y", 2), ("b", "x", 1), ("c", "x", 9), ("d", None, None)]
    shares = spark.createDataFrame(rows, "g string, label string, n long")
    return text.insights(shares, ["g"], "label", ["n"], spark.createDataFrame(cache, CACHE), F.lit(NOW), narrate)


def by_group(df):
    return {r["g"]: (r["insight"], r["from_cache"], r["generated_at"]) for r in df.collect()}


def test_failures_leave_numbers(spark):
    for narrate in (None, lambda lines: [None] * len(lines)):
        out = told(spark, [], narrate)
        assert by_group(out) == dict.fromkeys("abcd", (None, False, NOW))
        assert {r["g"]: r["lines"] for r in out.collect()} == {"a": ["x:1", "y:2"], "b": ["x:1", "y:2"], "c": ["x:9"], "d": [""]}
        assert text.remember_insights(spark.createDataFrame([], CACHE), out).collect() == []


def test_entries_count_until_they_are_past(spark):
    prints = {r["g"]: r["fingerprint"] for r in told(spark, [], None).collect()}
    assert prints["a"] == prints["b"] and len(set(prints.values())) == 3
    day = datetime.timedelta(days=1)
    cache = [(prints["a"], "old", NOW - day, NOW), (prints["c"], "past", NOW - day, NOW - SECOND), ("other", "stays", NOW, NOW)]
    out = told(spark, cache, lambda lines: ["+".join(x) for x in lines])
    assert by_group(out) == {"a": ("old", True, NOW - day), "b": ("old", True, NOW - day), "c": ("x:9", False, NOW), "d": ("", False, NOW)}
    after = text.remember_insights(spark.createDataFrame(cache, CACHE), out).collect()
    assert {tuple(r) for r in after} == {cache[0], cache[2], (prints["c"], "x:9", NOW, NOW + day), (prints["d"], "", NOW, NOW + day)}


def test_equal_distributions_are_asked_once(spark):
    out = told(spark, [], lambda lines: [f"{len(lines)}"] * len(lines))
    asked = out.where("g in ('a', 'b')").select("fingerprint", "insight").distinct()
    assert asked.count() == 1
    assert text.remember_insights(spark.createDataFrame([], CACHE), out).count() == 3


def test_nothing_told_of_nothing(spark):
    empty = spark.createDataFrame([], "g string, label string, n long")
    assert text.insights(empty, ["g"], "label", ["n"], spark.createDataFrame([], CACHE), F.lit(NOW)).collect() == []


def test_origins_from_one_reading(spark):
    rows = [("o", 1, "x", 2.0), ("o", 1, "y", 2.0), ("o", 2, "x", 3.5), ("p", 1, None, 2.0), (None, 7, "x", 1.0)]
    facts = spark.createDataFrame(rows, "origin string, id long, country string, popularity double")
    out = visibility.origin_metrics(facts)
    assert out._jdf.queryExecution().executedPlan().toString().count("Scan") == 1
    assert {tuple(r) for r in out.collect()} == {("o", 2, 5.5, 2), ("p", 1, 2.0, 0)}
