"""Operators on history, reach, changes, readers and streams, with small tables."""

import datetime as dt
import gzip
import json

import pytest
from pyspark.sql import functions as F

from spanlight.operators import ledger, ranking, temporal, upsert, visibility
from spanlight.sources import tables as src
from spanlight.sources import versions
from spanlight.streaming import gates
from spanlight.streaming.run import drain

NOW = dt.datetime(2024, 3, 20, 12)
DAY = dt.timedelta(days=1)


def lit_now():
    return F.lit(NOW)


@pytest.mark.parametrize(
    "snaps,score,want",
    [
        ([], 100.0, ("insufficient", None, None)),
        ([(0.5, 100.0)], 110.0, ("insufficient", None, None)),
        ([(8, 100.0)], 110.0, ("rising", 10.0, 8)),
        ([(8, 100.0)], 90.0, ("falling", -10.0, 8)),
        ([(8, 100.0)], 102.0, ("flat", 2.0, 8)),
        ([(8, 0.0)], 50.0, ("flat", 0.0, 8)),
        ([(2, 100.0)], 120.0, ("rising", 20.0, 2)),
        ([(20, 50.0), (7, 100.0), (1, 150.0)], 110.0, ("rising", 10.0, 7)),
        ([(8, 100.0)], 105.0, ("rising", 5.0, 8)),
        ([(8, 100.0)], 95.0, ("falling", -5.0, 8)),
        ([(1, 100.0)], 100.0, ("flat", 0.0, 1)),
    ],
)
def test_trend(spark, snaps, score, want):
    history = spark.createDataFrame([("TR", NOW - d * DAY, s) for d, s in snaps], "key string, ts timestamp, score double")
    current = spark.createDataFrame([("TR", score)], "key string, score double")
    r = temporal.trends(current, history, lit_now()).first()
    assert (r["direction"], r["change_pct"], r["window_days"]) == want


def test_rolled_months_stay(spark):
    rows = [("a", dt.datetime(2024, m, 5), float(v)) for m, v in ((1, 1), (1, 2), (2, 5), (3, 9))]
    samples = spark.createDataFrame(rows, "key string, ts timestamp, score double")
    rolled = spark.createDataFrame([("a", 2024, 1)], "key string, year int, month int")
    got = temporal.monthly_rollup(samples, lit_now(), rolled=rolled).collect()
    assert [(r["month"], r["avg_score"], r["sample_count"]) for r in got] == [(2, 5.0, 1)]
    assert temporal.monthly_rollup(samples, lit_now()).count() == 2
    assert temporal.current_month(samples, lit_now()).first()["avg_score"] == 9.0


def test_pair_of_the_best_month(spark):
    rows = [("a", y, m, v) for y, m, v in ((2019, 1, 10), (2021, 1, 30), (2023, 1, 0), (2020, 2, 5), (2021, 2, 6), (2022, 2, 0))] + [("b", 2020, 1, 7)]
    panel = spark.createDataFrame(rows, "key string, year int, month int, value long")
    got = temporal.latest_arrivals(panel).collect()
    assert [(r["key"], r["month"], r["before_year"], r["after_year"], r["change_pct"]) for r in got] == [("a", 1, 2021, 2023, -100.0)]


def test_scaling(spark):
    df = spark.createDataFrame([("a", 1.0, True), ("b", 3.0, True), ("c", 7.0, False)], "k string, v double, real boolean")
    assert {r["k"]: r["t"] for r in temporal.min_max(df, "v", F.col("real")).collect()} == {"a": 0.0, "b": 1.0, "c": 3.0}
    assert temporal.min_max(df.where("k = 'a'"), "v").first()["t"] == 0.0


def test_shares_and_remainder(spark):
    df = spark.createDataFrame([(c, float(v)) for c, v in zip("abcdefg", (50, 20, 10, 9, 5, 4, 2), strict=True)], "k string, v double")
    assert sum(r["share_pct"] for r in ranking.shares(df, "v").collect()) == pytest.approx(100)
    top = ranking.top_with_remainder(df, 3, "v", "k").orderBy("rank").collect()
    assert [(r["label"], r["value"]) for r in top] == [("a", 50.0), ("b", 20.0), ("c", 10.0), ("others", 20.0)]
    assert ranking.shares(df.withColumn("v", F.lit(0.0)), "v").first()["share_pct"] == 0.0
    assert ranking.top_with_remainder(df.limit(0), 3, "v", "k").count() == 0


def test_visibility_ties_and_offers(spark):
    offers = {1: {"TR": {"flatrate": ["n"], "buy": ["x"]}, "DE": {"rent": ["y"]}}, 2: {"TR": {"free": ["z"], "flatrate": []}}, 3: {"TR": {"ads": ["q"]}}, 4: {"TR": {"flatrate": ["n"]}}}
    nested = spark.createDataFrame(list(offers.items()), "id long, offers map<string,map<string,array<string>>>")
    titles = spark.createDataFrame([(1, "a", 5.0, 1), (2, "b", 5.0, 2), (3, "c", 9.0, 3), (4, "d", 1.0, 4)], "id long, name string, popularity double, ordinal long")
    store = spark.createDataFrame([(1, "x", 90, None), (2, "y", 60, None), (4, "x", 10, "y")], "id long, model_theme string, model_confidence int, override_theme string")
    reach = visibility.streamable(visibility.explode_offers(nested))
    facts = reach.join(visibility.with_themes(titles, store), "id")
    r = visibility.visibility(facts).collect()
    assert len(r) == 1
    assert (r[0]["country"], r[0]["score"], r[0]["title_count"], r[0]["top_id"], r[0]["dominant_theme"], r[0]["theme_confidence"], r[0]["theme_uncertain"]) == ("TR", 11.0, 3, 1, "y", 100, False)


def test_tags_keep_an_empty_override(spark):
    titles = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    store = spark.createDataFrame([(1, ["a"], []), (2, ["a"], None)], "id long, auto_tags array<string>, human_tags array<string>")
    assert {r["id"]: r["tags"] for r in visibility.with_tags(titles, store).collect()} == {1: [], 2: ["a"], 3: []}


def test_proxies_never_meet_measured_countries(spark):
    real = spark.createDataFrame([("TR", 5.0)], "country string, score double")
    fallback = spark.createDataFrame([("TR", "t", 1), ("DE", "late", 3), ("DE", "early", 2), (None, "?", 4)], "country string, label string, ordinal int")
    got = visibility.proxy_union(real, fallback).collect()
    assert {(r["country"], r["data_source"]) for r in got} == {("DE", "proxy"), ("TR", "real")}
    assert {r["label"] for r in got} == {None, "early"}


def test_changes(spark):
    base = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "id int, x string, y int")
    new = spark.createDataFrame([(2, None, 9), (3, "c", 3)], "id int, x string, y int")
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert sorted(map(repr, rows(upsert.upsert(base, new, ["id"])))) == sorted(map(repr, [(1, "a", 1), (2, None, 9), (3, "c", 3)]))
    assert rows(upsert.upsert_columns(base, new, ["id"], ["y"])) == [(1, "a", 1), (2, "b", 9), (3, None, 3)]
    assert rows(upsert.insert_missing(base, new, ["id"])) == [(1, "a", 1), (2, "b", 2), (3, "c", 3)]
    assert rows(upsert.overlay(base, new, ["id"], ["x", "y"])) == [(1, "a", 1), (2, "b", 9)]
    assert rows(upsert.delete_keys(base, new, ["id"])) == [(1, "a", 1)]
    assert upsert.migrate(base, {"z": F.lit(0), "x": F.lit("no")}, ("y",)).columns == ["id", "x", "z"]


def test_retention(spark):
    rows = [(k, NOW + n * DAY, n) for k in "ab" for n in range(70)]
    kept = temporal.keep_last(spark.createDataFrame(rows, "key string, ts timestamp, n int"), 60)
    assert {r["key"]: (r["c"], r["m"]) for r in kept.groupBy("key").agg(F.count("*").alias("c"), F.min("n").alias("m")).collect()} == {"a": (60, 10), "b": (60, 10)}


def test_versions(spark, tmp_path):
    path = f"{tmp_path}/t"
    assert versions.read_latest(spark, path, "id int").count() == 0
    assert versions.write_next(spark.createDataFrame([(1,)], "id int"), path) == 1
    assert versions.write_next(spark.createDataFrame([(1,), (2,)], "id int"), path) == 2
    (tmp_path / "t" / "v=3").mkdir()  # was not completed
    assert versions.read_latest(spark, path, "id int").count() == 2
    versions.export_json(spark.createDataFrame([("ğ", None)], "a string, b string"), f"{tmp_path}/j")
    assert json.loads("".join(p.read_text() for p in (tmp_path / "j").glob("*.json"))) == {"a": "ğ", "b": None}


def test_tsv_and_titles(spark, tmp_path):
    body = "titleId\tordinal\ttitle\tregion\nt1\t1\tA \"q\tNA\nt1\t2\tA \"q\tNA\nt1\t3\tB\t\\N\n"
    with gzip.open(tmp_path / "akas.tsv.gz", "wt") as f:
        f.write(body)
    akas = src.read_tsv(spark, f"{tmp_path}/akas.tsv.gz", "titleId string, ordinal int, title string, region string")
    assert [tuple(r) for r in src.localized_titles(akas).collect()] == [("t1", "NA", 'A "q', 1)]


def test_linked_data(spark):
    good = '<script type="application/ld+json">{"@type":"TVSeries","name":"N","aggregateRating":{"ratingValue":7.5,"ratingCount":10},"containsSeason":[{"numberOfEpisodes":3},{"numberOfEpisodes":4}]}</script>'
    bad = '<script type="application/ld+json">{oops</script>'
    other = '<script type="application/ld+json">{"@type":"Movie","name":"M"}</script>'
    pages = spark.createDataFrame([(1, bad + other + good), (2, other)], "page_id long, html string")
    assert [tuple(r) for r in src.linked_data(pages).collect()] == [(1, "N", 7.5, 10, 7)]


def test_first_bulletin(spark):
    html = '<a href="x.html">About</a><a class="k" href="/a.xls">News <b>BULLETIN</b> March 2024</a><a href="/b.xls">Bulletin May 2024</a>'
    links = src.anchors(spark.createDataFrame([(1, html)], "page_id long, html string"))
    r = src.first_bulletin(links, "bulletin", {"march": 3, "may": 5}).first()
    assert (r["href"], r["month"], r["year"]) == ("/a.xls", 3, 2024)


@pytest.mark.parametrize("href,want", [("http://o.org/z", "http://o.org/z"), ("/r/s", "http://h.org/r/s"), ("t.xls", "http://h.org/a/t.xls")])
def test_absolute_url(spark, href, want):
    assert spark.range(1).select(src.absolute_url(F.lit("http://h.org/a/b?q=/x"), F.lit(href))).first()[0] == want


def test_nested_sources(spark, tmp_path):
    pages = spark.createDataFrame([(2, [(1, "late", 1.0, None, None, None), (3, "c", 1.0, None, None, None)]), (1, [(1, "a", 9.0, None, None, None), (2, "b", 5.0, None, None, None)])], src.PAGE)
    top = src.ranked_list(pages, 3).orderBy("ordinal").collect()
    assert [(r["id"], r["name"], r["ordinal"]) for r in top] == [(1, "a", 1), (2, "b", 2), (3, "c", 3)]
    credits = spark.createDataFrame([(1, [(9, "z", "r", None, 2), (8, "y", "r", None, 1)]), (2, None)], src.CREDITS)
    assert {r["id"]: [c["name"] for c in r["cast"]] for r in src.leading_credits(credits, 1).collect()} == {1: ["y"], 2: []}
    offers = spark.createDataFrame([(1, {"TR": {"free": ["n"]}})], "id long, offers map<string,map<string,array<string>>>")
    whole = src.assemble(src.ranked_list(pages, 3), offers, src.leading_credits(credits)).collect()
    assert {r["id"]: (len(r["offers"]), len(r["cast"])) for r in whole} == {1: (1, 2), 2: (0, 0), 3: (0, 0)}
    (tmp_path / "g.json").write_text(json.dumps({"features": [{"properties": {"ISO_A2": "TR"}, "geometry": {"type": "Point"}}]}))
    assert src.boundaries(spark, f"{tmp_path}/g.json").first()["code"] == "TR"
    (tmp_path / "r.json").write_text('{"a": 1}\n{broken\n')
    assert [r["_corrupt"] for r in src.read_json(spark, f"{tmp_path}/r.json", "a int").orderBy("a").collect()] == ["{broken", None]


def test_panels_and_courses(spark):
    rows = spark.createDataFrame([("a", '{"ratings":[{"source":"s","rating":"7"}]}'), ("b", '{"ratings":[]}')], "key string, payload string")
    assert {r["key"]: r["ratings"] is not None for r in src.knowledge_panel(rows).collect()} == {"a": True, "b": False}
    videos = spark.createDataFrame([("a", '{"videos":[{"title":"t","channel":""}]}'), ("b", '{"videos":[]}')], "key string, payload string")
    assert {r["key"]: (r["title"], r["channel"], r["verified"]) for r in src.first_video(videos).collect()} == {"a": ("t", None, False), "b": (None, None, False)}
    courses = spark.createDataFrame([("tr", 5), ("tr", None), ("de", 9)], "learning_language string, learners long")
    assert tuple(src.course_totals(courses, "tr").first()) == (5, 2)
    attrs = spark.createDataFrame([("NA", "XX"), ("EU", None), (None, "TR")], "region_id string, iso2 string")
    assert [r["iso2"] for r in src.country_attributes(attrs).collect()] == ["TR"]


def test_ledger_counts_from_the_last_success(spark):
    rows = [("a", NOW, False), ("a", NOW + DAY, True), ("a", NOW + 2 * DAY, False), ("a", NOW + 3 * DAY, False), ("b", NOW, True)]
    got = ledger.failure_ledger(spark.createDataFrame(rows, "key string, ts timestamp, ok boolean")).collect()
    assert [(r["key"], r["failure_count"]) for r in got] == [("a", 2)]
    assert got[0]["next_retry_ms"] - int((NOW + 3 * DAY).replace(tzinfo=dt.timezone.utc).timestamp() * 1000) == 600_000


def test_expiry_is_strict(spark):
    rows = spark.createDataFrame([("a", NOW), ("b", NOW - DAY)], "key string, expires_at timestamp")
    assert [r["key"] for r in ledger.expired(rows, lit_now()).collect()] == ["b"]


def test_stream_equals_batch(spark, tmp_path):
    rows = [(k, NOW + dt.timedelta(hours=5 * n), float(n), k % 2 == 0) for n, k in enumerate([1, 2, 1, 1, 2, 2, 1, 2, 1, 1, 1, 2])]
    events = spark.createDataFrame(rows, "user int, ts timestamp, score double, ok boolean")
    events.repartition(1).write.parquet(f"{tmp_path}/events.parquet")
    streamed = drain(spark, str(tmp_path), "events", lambda s: gates.snapshot_gate(s, F.lit("all"), "ts", "score"))
    batch = gates.batch_gate(events, F.lit("all"), "ts", "score")
    assert sorted(map(tuple, streamed.collect())) == sorted(map(tuple, batch.collect()))
    assert [r["score"] for r in batch.orderBy("ts").collect()] == [0.0, 3.0, 6.0, 9.0]


def test_retry_stream(spark, tmp_path):
    rows = [("a", NOW, False), ("a", NOW + DAY, False), ("b", NOW, False), ("b", NOW + DAY, True)]
    spark.createDataFrame(rows, "key string, ts timestamp, ok boolean").repartition(1).write.parquet(f"{tmp_path}/tries")
    stream = spark.readStream.schema("key string, ts timestamp, ok boolean").parquet(f"{tmp_path}/tries")
    query = gates.retry_ledger(stream, "key", "ts", F.col("ok")).writeStream.format("memory").queryName("retries").outputMode("update").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    got = {r["key"]: (r["failure_count"], r["next_retry_ms"] - r["last_failed_ms"]) for r in spark.table("retries").collect()}
    assert got == {"a": (2, 600_000), "b": (0, 0)}


def test_places_over_ranges(spark):
    import random

    from spanlight.operators import ranking

    rng = random.Random(3)
    rows = [(k, rng.randrange(5)) for k in range(500)] + [(500, None)]
    got = ranking.placed(spark.createDataFrame(rows, "id long, v int").repartition(7), F.col("v").desc(), "id").collect()
    want = sorted(rows, key=lambda r: (-r[1] if r[1] is not None else 9, r[0]))
    assert [(r["id"], r["v"]) for r in sorted(got, key=lambda r: r["rank"])] == want and sorted(r["rank"] for r in got) == list(range(1, 502))
    assert ranking.placed(spark.createDataFrame([], "id long"), "id").collect() == []


def test_scratch_scope_drops_tables(spark):
    import os

    from spanlight.scratch import scratch_scope, stash

    with scratch_scope(spark):
        held = stash(spark.range(3).toDF("id"), "held")
        path = held.inputFiles()[0].removeprefix("file://")
        assert os.path.exists(path)
    assert not os.path.exists(path)


def test_scopes_of_threads_keep_apart(spark):
    """A scope that ends in one thread leaves the tables of another thread's scope."""
    import os
    import threading

    from spanlight.scratch import scratch_scope, stash

    begun, ended, seen = threading.Event(), threading.Event(), []

    def other():
        with scratch_scope(spark):
            path = stash(spark.range(2).toDF("id"), "other").inputFiles()[0].removeprefix("file://")
            begun.set()
            ended.wait(60)
            seen.append(os.path.exists(path))
        seen.append(os.path.exists(path))

    with scratch_scope(spark):
        job = threading.Thread(target=other)
        job.start()
        begun.wait(60)
        mine = stash(spark.range(3).toDF("id"), "mine").inputFiles()[0].removeprefix("file://")
    ended.set()
    job.join(60)
    assert not os.path.exists(mine) and seen == [True, False]
