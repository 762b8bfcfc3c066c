"""Pinned behaviour of scalar functions, statistics and labels."""

import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spanlight.functions import scalars as sc
from spanlight.operators import matching, stats
from spanlight.operators import text as tx


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("x,places,want", [(-2.5, 0, -2.0), (2.5, 0, 3.0), (0.25, 1, 0.3), (-0.25, 1, -0.2), (1.005, 2, 1.0), (None, 1, None)])
def test_half_up(spark, x, places, want):
    assert value(spark, sc.half_up(F.lit(x).cast("double"), places)) == want


@pytest.mark.parametrize("now,before,zero,want", [(110.0, 100.0, None, 10.0), (90.0, 100.0, None, -10.0), (50.0, 0.0, 0.0, 0.0), (50.0, 0.0, None, None), (None, 5.0, 0.0, None)])
def test_pct_change(spark, now, before, zero, want):
    assert value(spark, sc.pct_change(F.lit(now).cast("double"), F.lit(before), zero)) == want


@pytest.mark.parametrize("text,want", [("İSTANBUL", "istanbul"), ("ISPARTA", "ısparta"), ("Ankara", "ankara"), (None, None)])
def test_turkish_lower(spark, text, want):
    assert value(spark, sc.turkish_lower(F.lit(text).cast("string"))) == want


@pytest.mark.parametrize(
    "column,want",
    [
        (lambda: sc.braces(F.lit('say {"a": {"b": 1}} and more')), '{"a": {"b": 1}}'),
        (lambda: sc.braces(F.lit("none")), None),
        (lambda: sc.parse_votes(F.lit("1,234,567")), 1234567),
        (lambda: sc.parse_votes(F.lit("N/A")), None),
        (lambda: sc.parse_rating(F.lit("Infinity")), None),
        (lambda: sc.parse_rating(F.lit("7.5")), 7.5),
        (lambda: sc.split_names(F.lit(" a b ,, c ,")), ["a b", "c"]),
        (lambda: sc.confidence(F.lit("170")), 100),
        (lambda: sc.confidence(F.lit("high")), None),
        (lambda: sc.backoff_ms(F.lit(1)), 300_000),
        (lambda: sc.backoff_ms(F.lit(40)), 21_600_000),
        (lambda: sc.compact_number(F.lit(999)), "999"),
        (lambda: sc.compact_number(F.lit(1500)), "1.5k"),
        (lambda: sc.compact_number(F.lit(2000)), "2k"),
        (lambda: sc.cache_key(F.lit(" İnci "), F.lit("tr")), "inci::TR"),
        (lambda: sc.truthy_or(F.lit(""), F.lit("b")), "b"),
        (lambda: sc.iso_date(F.lit("soon")), None),
        (lambda: sc.clamp(F.lit(None).cast("double"), 0, 1), None),
        (lambda: sc.hex_channels(F.lit("#ff8000")), [255, 128, 0]),
        (lambda: sc.toggled(F.array(F.lit("a"), F.lit("b")), F.lit("a")), ["b"]),
        (lambda: sc.toggled(F.array(F.lit("a")), F.lit("b")), ["a", "b"]),
        (lambda: F.size(sc.effective(F.array().cast("array<string>"), F.array(F.lit("x")))), 0),
        (lambda: sc.log_distance_score(F.lit(10.0), F.lit(-1.0)), None),
        (lambda: sc.log_distance_score(F.lit(10.0), F.lit(10.0)), 2.0),
        (lambda: sc.share_pct(F.lit(1.0), F.lit(0.0)), 0.0),
    ],
)
def test_values(spark, column, want):
    assert value(spark, column()) == want


@pytest.mark.parametrize(
    "direction,change,days,want",
    [("insufficient", None, None, "not enough data"), (None, None, None, "not enough data"), ("rising", 12.3, 7, "up +12.3% / 7 d"), ("falling", -8.5, 5, "down -8.5% / 5 d"), ("flat", 1.2, 7, "flat +1.2% / 7 d")],
)
def test_trend_label(spark, direction, change, days, want):
    assert value(spark, sc.trend_label(F.lit(direction).cast("string"), F.lit(change).cast("double"), F.lit(days).cast("int"))) == want


def correlation(spark, xs, ys):
    return spark.createDataFrame(list(zip(xs, ys, strict=True)), "x double, y double").agg(stats.pearson("x", "y").alias("r")).first()["r"]


def test_pearson(spark):
    assert correlation(spark, [1.0, 2.0, 3.0, 4.0], [2.0, 4.0, 6.0, 8.0]) == pytest.approx(1)
    assert correlation(spark, [1.0, 2.0, 3.0, 4.0], [8.0, 6.0, 4.0, 2.0]) == pytest.approx(-1)
    assert correlation(spark, [1.0, 2.0, 3.0], [5.0, 5.0, 5.0]) == 0
    assert correlation(spark, [0.1] * 7, [1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0]) == 0


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.floats(-1e6, 1e6), st.floats(-1e6, 1e6)), min_size=2, max_size=20))
def test_pearson_is_bounded_and_symmetric(spark, pairs):
    xs, ys = zip(*pairs, strict=True)
    r = correlation(spark, xs, ys)
    assert -1 <= r <= 1 and r == pytest.approx(correlation(spark, ys, xs), abs=1e-6)


def interval(spark, r, n):
    low, high = stats.fisher_interval(F.lit(r), F.lit(n))
    return value(spark, low), value(spark, high)


def test_fisher_interval(spark):
    assert interval(spark, 0.8, 3) == (None, None)
    low, high = interval(spark, 0.6, 30)
    assert low < 0.6 < high
    wide, narrow = interval(spark, 0.6, 10), interval(spark, 0.6, 200)
    assert narrow[1] - narrow[0] < wide[1] - wide[0]
    assert interval(spark, 1.0, 50)[1] <= 1


def test_difference_in_differences(spark):
    d = value(spark, stats.difference_in_differences(*map(F.lit, (100.0, 120.0, 100.0, 110.0))))
    assert (d["did"], d["treated_pct"], d["control_pct"]) == (10.0, 20.0, 10.0)
    assert value(spark, stats.difference_in_differences(*map(F.lit, (0.0, 5.0, 1.0, 1.0))))["treated_pct"] is None


def test_too_few_pairs_are_pending(spark):
    row = stats.correlation_report(spark.createDataFrame([(1.0, 2.0), (2.0, None)], "x double, y double"), "x", "y").first()
    assert (row["status"], row["pairs"], row["r"], row["low"]) == ("pending", 1, None, None)


PLACES = [("kapadokya", "kapadokya"), ("kapadokya", "göreme"), ("istanbul", "istanbul"), ("van", "van")]


@pytest.mark.parametrize(
    "overview,name,want",
    [
        ("Kapadokya ve Göreme, sonra İSTANBUL", "", ["kapadokya", "istanbul"]),
        ("nothing here", "", []),
        (None, None, []),
        ("", "Van gecesi", ["van"]),
        ("a savant", "", ["van"]),
    ],
)
def test_keyword_tags(spark, overview, name, want):
    docs = spark.createDataFrame([(1, overview, name)], "id long, overview string, name string")
    text = F.concat_ws(" ", "overview", "name")
    found = tx.tag_lists(tx.keyword_tags(docs, PLACES, text), ["kapadokya", "istanbul", "van"]).collect()
    assert (found[0]["tags"] if found else []) == want


def test_labels(spark):
    places = spark.createDataFrame([("TR", "Türkiye"), ("IT", "İtalya"), ("DE", "Almanya")], "code string, name string")
    aliases = spark.createDataFrame([("turkey", "TR")], "alias string, code string")
    rows = spark.createDataFrame([("tr",), ("TÜRKİYE",), (" italya ",), ("Turkey",), ("Nowhere",), (None,)], "label string")
    got = {r["label"]: r["code"] for r in matching.resolve_labels(rows, "label", places, aliases).collect()}
    assert got == {"tr": "TR", "TÜRKİYE": "TR", " italya ": "IT", "Turkey": "TR", "Nowhere": None, None: None}


def test_controls(spark):
    rows = [(1, 7, "high", 100.0), (2, 7, "low", 1000.0), (3, 8, "high", 110.0), (4, None, "mid", None), (5, None, None, 5.0), (6, 9, "none", 5.5)]
    cands = spark.createDataFrame(rows, "key int, region int, income string, gdp double")
    targets = spark.createDataFrame([(1,), (4,), (6,)], "key int")
    none = spark.createDataFrame([], "key int")
    got = {r["key"]: (r["control"], r["reasons"]) for r in matching.suggest_controls(targets, cands, none).collect()}
    assert got[1] == (3, "same income group, similar gdp")
    assert got[4] == (5, "same region")
    assert got[6] == (5, "similar gdp")
    brute = []
    for k, region, income, gdp in rows:
        for c, r2, i2, g2 in rows:
            if k in (1, 4, 6) and c != k:
                g = max(0.0, 2 - abs(math.log(gdp) - math.log(g2))) if gdp and g2 else None
                if region == r2 or (income and income == i2) or (g or 0) > 1:
                    brute.append((k, -(2.0 * (region == r2) + 2.0 * (bool(income) and income == i2) + (0 if g is None else g + 0.01)), c))
    assert {k: c for k, _, c in reversed(sorted(brute))} == {k: c for k, (c, _) in got.items()}


def test_classifier_falls_back(spark):
    docs = spark.createDataFrame([(1, "red ring ring"), (2, "zzz"), (3, None)], "id long, text string")
    told = tx.classify(docs, tx.keyword_classifier({"colour": ["red"], "part": ["ring", "bolt"]}), ["colour"])
    fallback = spark.createDataFrame([(2, "other", 0)], "id long, label string, confidence int")
    got = {r["id"]: (r["label"], r["method"], r["pending"]) for r in tx.with_fallback(told, fallback).collect()}
    assert got == {1: ("colour", "model", False), 2: ("other", "keyword", True), 3: (None, "keyword", True)}
