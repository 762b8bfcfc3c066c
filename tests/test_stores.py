"""Title layout, TSV ranges, controls by neighbours, timers, reports, and changes that fail."""

import gzip
import json
import math
import random
import threading
from datetime import datetime, timedelta, timezone

import pandas as pd
import pytest
from pyspark.sql import functions as F

from spanlight.functions import scalars as sc
from spanlight.operators import matching, report
from spanlight.operators import temporal as tm
from spanlight.operators import text as tx
from spanlight.operators import upsert as change
from spanlight.sources import tables as src
from spanlight.sources import titles, tsv, versions
from spanlight.streaming import timers
from spanlight.streaming.run import ROCKS, STORE, drain


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def layout(spark):
    basics = [(f"tt{k}", "tvSeries" if k % 3 else "movie", f"Title {k}", "\\N" if k % 2 else f"Başlık {k}", "1999", "\\N") for k in range(200)]
    basics += [("tt900", "tvSeries", "Die Straße", "x", "soon", "2001"), ("tt901", "tvMiniSeries", "y", "DIE STRASSE ", "\\N", ""), ("tt902", "short", "die strasse", "z", "1", "2")]
    ratings = [(f"tt{k}", f"{k / 10}", str(k)) for k in range(0, 200, 2)]
    akas = [("tt4", 3, "B", "NA", "0"), ("tt4", 1, "A", "TR", "1"), ("tt4", 2, "A", "TR", "0"), ("tt4", 4, "C", "\\N", "1"), ("tt5", 1, "D", None, "1")]
    made = titles.write_layout(
        spark.createDataFrame(basics, "tconst string, titleType string, primaryTitle string, originalTitle string, startYear string, endYear string"),
        spark.createDataFrame(ratings, "tconst string, averageRating string, numVotes string"),
        spark.createDataFrame(akas, "titleId string, ordinal int, title string, region string, isOriginalTitle string"),
        buckets=8,
    )
    yield made
    titles.drop_layout(spark, made)


def test_titles_meet_without_a_shuffle(spark, layout):
    rows = titles.title_rows(spark, layout)
    assert "Exchange" not in plan(rows)
    got = {r["tconst"]: r for r in rows.collect()}
    assert len(got) == 203
    assert [tuple(n) for n in got["tt4"]["names"]] == [(1, "TR", "A", True), (3, "NA", "B", False)]
    assert got["tt5"]["names"] == [] and got["tt5"]["rating"] is None and got["tt4"]["rating"] == 0.4 and got["tt4"]["votes"] == 4
    assert (got["tt900"]["start_year"], got["tt900"]["end_year"], got["tt1"]["original_title"]) == (None, 2001, None)


def test_title_lookup(spark, layout):
    one = titles.title_rows(spark, layout, "tt42")
    assert plan(one).count("SelectedBucketsCount: 1 out of 8") == 3 and "Exchange" not in plan(one)
    assert [r["tconst"] for r in one.collect()] == ["tt42"]
    found = lambda name: sorted(r["tconst"] for r in titles.title_rows(spark, layout, name).collect())
    assert found("tt42") == ["tt42"] and found("tT42") == [] and found("tt3") == ["tt3"]  # a movie too
    assert found("  die STRASSE ") == ["tt900"]  # of titles only what is asked for is trimmed, and a short film is no series
    assert found("Title") == [] and found("TITLE 4") == ["tt4"] and found("title 3") == []
    assert [r["tconst"] for r in titles.first_match(spark, layout, "başlık 4").collect()] == ["tt4"]


@pytest.mark.parametrize("a,b", [("Straße", "STRASSE"), ("ΣΑΣ", "σας"), ("İz", "i̇z"), ("ı", "i"), ("ａ", "a"), ("É", "é"), ("e", "é"), ("ﬁ", "fi"), ("ſ", "S"), ("x", "y"), ("", " ")])
def test_case_folding(spark, a, b):
    got = spark.createDataFrame([(a, b)], "a string, b string").select(titles.folded(F.col("a")) == titles.folded(F.col("b"))).first()[0]
    assert got == (a.casefold() == b.casefold())


def test_tsv_ranges(spark, tmp_path):
    rng = random.Random(2)
    rows = [(f"t{rng.randrange(5)}", k, rng.choice(["NA", None, "", '"q', "x" * rng.randrange(40)])) for k in range(300)]
    text = "id\tn\tregion\n" + "".join(f"{i}\t{n}\t{'\\N' if r is None else r}\n" for i, n, r in rows)
    (tmp_path / "a.tsv").write_text(text)
    with gzip.open(tmp_path / "a.tsv.gz", "wt") as f:
        f.write(text)
    (tmp_path / "end.tsv").write_text(text.rstrip("\n"))
    for name in ("a.tsv", "end.tsv", "a.tsv.gz"):
        for size in (1, 7, 100, 1 << 20):
            for block in (3, 50, 1 << 20):
                if size * block < 20 and name != "a.tsv":
                    continue
                reader = tsv._source()(options={"path": f"{tmp_path}/{name}", "range_bytes": str(size)}).reader(spark.createDataFrame([], "id string, n long, region string").schema)
                reader.block = block
                parts = reader.partitions() if size > 1 else [p for p in reader.partitions() if p.begin < 400]
                got = [tuple(r.values()) for p in parts for b in reader.read(p) for r in b.to_pylist()]
                assert got == rows[: len(got)] and (len(got) == 300 or size == 1)
    df = tsv.scan_tsv(spark, f"{tmp_path}/a.tsv", "region string, id string, n long", range_bytes=500)
    one = df.where((F.col("id") == "t3") & (F.col("n") > 20))
    assert "> 20" in plan(one) and "= t3" not in plan(one)  # the equality is left to the source
    assert sorted((r["region"] or "\0", r["n"]) for r in one.collect()) == sorted((r or "\0", n) for i, n, r in rows if i == "t3" and n > 20)
    assert "FilterExec" not in plan(df.where("id = 't3'")) and df.where("id = 't3' and id = 't4'").count() == 0


def brute_controls(rows, targets, excluded):
    best = {}
    for k, region, income, gdp in rows:
        for c, r2, i2, g2 in rows:
            if k in targets and c != k and c not in excluded:
                known = gdp and g2 and gdp > 0 and g2 > 0
                g = max(0.0, 2 - abs(math.log(gdp) - math.log(g2))) if known else None
                if region == r2 or (income is not None and income == i2) or (g or 0) > 1:
                    score = 2.0 * (region == r2) + 2.0 * (income is not None and income == i2) + (0 if g is None else g + 0.01)
                    best[k] = min(best.get(k, (9, 0)), (-math.floor(score * 10_000 + 0.5) / 10_000, c))
    return {k: c for k, (_, c) in best.items()}


@pytest.mark.parametrize("seed", range(4))
def test_controls_meet_a_handful(spark, seed):
    rng = random.Random(seed)
    gdps = [None, 0.0, -3.0, *(round(math.exp(rng.uniform(0, 9)), 2) for _ in range(25))]
    rows = [(k, rng.choice([None, 1, 1, 1, 2]), rng.choice([None, "low", "high"]) if seed else rng.choice(["low", "l:ow"]), rng.choice(gdps)) for k in range(300)]
    targets, excluded = set(range(0, 300, 2 + seed)), set(range(0, 300, 3))
    keys = lambda s: spark.createDataFrame([(k,) for k in s], "key int")
    got = matching.suggest_controls(keys(targets), spark.createDataFrame(rows, "key int, region int, income string, gdp double"), keys(excluded))
    assert {r["key"]: r["control"] for r in got.collect()} == brute_controls(rows, targets, excluded)


def test_neighbours_are_few(spark):
    rows = spark.range(3000).select(F.col("id").alias("key"), F.ln(F.col("id") + 1.0).alias("x"), F.lit(True).alias("cand"), (F.col("id") % 10 == 0).alias("want"), F.lit("g").alias("g"))
    near = matching._neighbours(rows, "key").join(rows.where("want").select("g", "x", "key"), ["g", "x"])
    got = {r["key"]: set(r["controls"]) for r in near.collect()}
    assert all({k - 1, k + 1} - {-1} <= c and len(c) <= 4 for k, c in got.items())


def test_multi_labels(spark):
    docs = spark.createDataFrame([(1, "IŞIK ve ızgara"), (2, "nothing"), (3, None), (4, "ask later"), (5, "abc bcd")], "id long, text string")
    default = tx.keyword_multi_classifier({"light": ["ışık"], "grill": ["IZGARA", ""], "inner": ["bc"], "outer": ["abc"], "none": []})

    def told(texts):
        return [None if t == "ask later" else ["invented", *found, *found[:1]] for t, found in zip(texts, default(texts), strict=True)]

    got = {r["id"]: r["labels"] for r in tx.classify_many(docs, told, ["grill", "light", "outer", "inner"]).collect()}
    assert got == {1: ["light", "grill"], 2: [], 3: [], 4: None, 5: ["inner", "outer"]}
    assert tx.classify_many(docs, tx.keyword_multi_classifier({}), []).where("size(labels) = 0").count() == 5


def test_insert_once_and_second_writer(spark, tmp_path):
    path = f"{tmp_path}/t"
    df = lambda *ids: spark.createDataFrame([(i, "x") for i in ids], "id int, v string")
    assert versions.insert_rows_once(df(1, 2), path, ["id"]) == 1
    for bad in (df(3, 3), df(4, 2), df(None, None)):
        with pytest.raises(change.DuplicateKeyError):
            versions.insert_rows_once(bad, path, ["id"])
    assert versions.read_latest(spark, path, "id int, v string").count() == 2
    assert versions.write_next(df(1, 2, 3), path, base=1) == 2
    with pytest.raises(versions.VersionConflictError):
        versions.write_next(df(9), path, base=1)  # read before the other wrote
    assert sorted(r["id"] for r in versions.read_latest(spark, path, "id int, v string").collect()) == [1, 2, 3]
    out = []

    def write(k):
        try:
            out.append(versions.write_next(df(k), path, base=2))
        except versions.VersionConflictError:
            out.append(None)

    racers = [threading.Thread(target=write, args=(k,)) for k in range(4)]
    [t.start() for t in racers]
    [t.join() for t in racers]
    assert sorted(out, key=str) == [3, None, None, None] and versions.read_latest(spark, path, "id int, v string").count() == 1
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
        versions.write_next(df(1).select(F.expr("id / (id - 1)").alias("id")), path)
    assert versions.write_next(df(7), path) == 4  # a failed write gives its number back
    with pytest.raises(versions.VersionConflictError):
        versions.abandon(spark, path, 4)


def test_clearing(spark):
    base = spark.createDataFrame([(1, "a", "x"), (2, "b", "y"), (3, "c", None)], "id int, v string, w string")
    u = spark.createDataFrame([(1, None, True, "n", None), (2, "B", False, "Y", True), (9, "z", True, "z", True)], "id int, v string, v_set boolean, w string, w_set boolean")
    assert sorted(map(tuple, change.set_columns(base, u, ["id"], ["v", "w"]).collect())) == [(1, None, "x"), (2, "b", "Y"), (3, "c", None)]
    assert sorted(map(tuple, change.clear_columns(base, u.union(u), ["id"], ["w"]).collect())) == [(1, "a", None), (2, "b", None), (3, "c", None)]


def test_trend_rows(spark):
    at = datetime(2024, 1, 31)
    history = [(k, at - timedelta(days=d, hours=1), float(100 + d)) for k in (1, 2) for d in range(40)]
    history = spark.createDataFrame(history, "key int, ts timestamp_ntz, score double")
    current = spark.createDataFrame([(1, 200.0, False), (2, 200.0, True), (3, 5.0, False)], "key int, score double, made_up boolean")
    rows = tm.trend_rows(current, history, F.lit(at), n=3, proxy=F.col("made_up"))
    got = {r["key"]: (r["direction"], r["change_pct"], [p["score"] for p in r["points"]]) for r in rows.collect()}
    assert got == {1: ("rising", 86.9, [102.0, 101.0, 100.0]), 2: ("insufficient", None, []), 3: ("insufficient", None, [])}
    steps = plan(tm.newest_points(history, 3))
    assert steps.index("WindowGroupLimit [key") < steps.rindex("WindowGroupLimit [key") and steps.index("Exchange") < steps.rindex("WindowGroupLimit [key")


def test_report(spark):
    facts = [("TR", "sea", 10.4), ("TR", "city", 5.0), ("DE", "sea", 7.0), ("FR", None, 1.0), (None, "sea", 2.0)]
    facts = spark.createDataFrame(facts, "country string, place string, score double")
    trend = spark.createDataFrame([("TR", "falling", -9.0), ("DE", "rising", 6.0), ("XX", "rising", 99.0)], "key string, direction string, change_pct double")
    told = spark.createDataFrame([('{"r":1}',)], "analysis string")
    got = json.loads(report.impact_report(facts, trend, "country", "place", "score", told, n=1).first()["report"])
    assert got == {
        "total_countries": 3, "rising_count": 1, "falling_count": 1, "top_countries": [{"name": "TR", "score": 15}], "other_countries_score": 8, "rising_countries": [{"name": "DE", "score": 7}],
        "has_enough_history": True, "top_places": [{"name": "sea", "score": 19}], "other_places_score": 5, "analysis": '{"r":1}',
    }
    none = json.loads(report.impact_report(facts.limit(0), trend, "country", "place", "score").first()["report"])
    assert none["total_countries"] == 0 and none["top_places"] == [] and none["has_enough_history"] is False and none["analysis"] == "pending"


def test_bulletins(spark):
    rows = [
        (1, '<a href="/p.html">HABER BÜLTENİ OCAK 2024</a><a href="/e.xls"></a><a href="/h.xls">Haziran 2023 HABER  BÜLTENİ</a>'),
        (2, '<a href="/x.xls">HABER BÜLTENİ 2024</a><a href="/y.XLS?v=1">haber\nbülteni KASIM 1999</a>'),
        (3, '<a href="/z.xls">BÜLTEN OCAK 2024</a>'),
    ]
    links = src.anchors(spark.createDataFrame(rows, "page_id long, html string"))
    got = src.first_bulletin(links, "HABER BÜLTEN", {"ocak": 1, "haziran": 6, "kasım": 11})
    assert sorted((r["id"], r["href"], r["month"], r["year"]) for r in got.collect()) == [(1, "/h.xls", 6, 2023), (2, "/y.XLS?v=1", 11, 1999)]


def test_cookies(spark):
    cases = {None: {}, "": {}, "a=1": {"a": "1"}, " a = 1 ;b;=x; a=2=3;c=": {"a": "2=3", "c": ""}, "u=%C3%BC+": {"u": "ü+"}, "bad=%zz": {"bad": None}}
    df = spark.createDataFrame([(k,) for k in cases], "h string")
    assert [r[0] for r in df.select(sc.cookie_map("h")).collect()] == list(cases.values())


def events(spark, folder, rows):
    """Rows (seconds, key, ok) as a table of several files, in any order."""
    zero = datetime(2024, 1, 1, tzinfo=timezone.utc)
    table = [(k, zero + timedelta(seconds=s), key, ok) for k, (s, key, ok) in enumerate(rows)]
    random.Random(1).shuffle(table)
    spark.createDataFrame(table, "event_id long, ts timestamp, key string, ok boolean").repartition(2).write.mode("overwrite").parquet(f"{folder}/t.parquet")
    return zero


def test_one_marker(spark, tmp_path):
    """Two keys at one moment are both taken; another key inside the gap is not; the very end of the gap is."""
    hour = 3600
    zero = events(spark, tmp_path, [(0, "a", True), (0, "b", True), (hour, "c", True), (12 * hour - 1, "a", True), (12 * hour, "a", True), (12 * hour, None, True), (30 * hour, "b", True), (41 * hour, "a", True)])
    table = spark.read.parquet(f"{tmp_path}/t.parquet")
    for moments in (timers.one_marker_batch(table, "ts"), drain(spark, str(tmp_path), "t", lambda e: timers.one_marker(e, "ts"), ts="ts")):
        got = timers.rows_at(table, "ts", moments).select("event_id").collect()
        assert sorted(r[0] for r in got) == [0, 1, 4, 5, 6]
    assert timers.one_marker_batch(table.limit(0), "ts").count() == 0
    assert zero.year == 2024


def test_retries_and_expiry_by_timer(spark, tmp_path):
    zero = events(spark, tmp_path, [(0, "a", False), (100, "a", False), (100, None, False), (5000, "b", False), (5010, "b", True), (6000, "c", False), (6300, "c", False), (400_000, "a", True)])
    start = int(zero.timestamp() * 1000)
    due = drain(spark, str(tmp_path), "t", lambda e: timers.retries_due(e, "key", "ts", F.col("ok"), F.col("event_id")), ts="ts")
    # a: the second failure comes before the first retry; c: the retry falls due at the moment of the next failure
    assert sorted((r["key"], r["failure_count"], (r["due_ms"] - start) // 1000) for r in due.collect()) == [("a", 2, 700), ("c", 1, 6300), ("c", 2, 6900)]
    gone = drain(spark, str(tmp_path), "t", lambda e: timers.expiries(e, "key", "ts", 300_000), ts="ts")
    assert sorted((r["key"], (r["expired_ms"] - start) // 1000) for r in gone.collect()) == [("a", 400), ("a", 400_300), ("b", 5310), ("c", 6600)]


def test_a_life_ends_behind_its_last_good_moment(spark, tmp_path):
    """A put at the last good moment renews, one a millisecond later does not; what is below a millisecond does not count."""
    zero = datetime(2024, 1, 1, tzinfo=timezone.utc)
    puts = [("a", 0), ("a", 300_000_999), ("b", 0), ("b", 300_001_000), ("c", 999), ("c", 300_001_000), (None, 0)]
    spark.createDataFrame([(zero + timedelta(microseconds=u), k) for k, u in puts], "ts timestamp, key string").write.parquet(f"{tmp_path}/t.parquet")
    gone = drain(spark, str(tmp_path), "t", lambda e: timers.expiries(e, "key", "ts", 300_000), ts="ts")
    start = int(zero.timestamp() * 1000)
    assert sorted((r["key"], r["expired_ms"] - start) for r in gone.collect()) == [("a", 600_000), ("b", 300_000), ("b", 600_001), ("c", 300_000), ("c", 600_001)]
    stream = spark.readStream.schema("ts timestamp, key string").parquet(f"{tmp_path}/t.parquet")
    assert "TransformWithState" not in timers.expiries(stream, "key", "ts", 300_000)._jdf.queryExecution().logical().toString()


def test_marker_meets_spans_of_time(spark, tmp_path):
    """Moments far closer than the spans, some in a gap over many spans: the stream equals the batch form, and its task gets a row for each span."""
    zero = datetime(2024, 1, 1, tzinfo=timezone.utc)
    rng = random.Random(5)
    rows = [(zero + timedelta(microseconds=rng.randrange(7_200_000_000) // 10 * 10 + 36_000_000_000 * (k % 3)),) for k in range(3000)]
    spark.createDataFrame([*rows, *rows[:50], (None,)], "ts timestamp").repartition(3).write.parquet(f"{tmp_path}/t.parquet")
    table = spark.read.parquet(f"{tmp_path}/t.parquet")
    for hours in (1 / 3600, 0.5, 11.0):  # gaps shorter and longer than a span
        want = sorted(r[0] for r in timers.one_marker_batch(table, "ts", hours).collect())
        got = drain(spark, str(tmp_path), "t", lambda e: timers.one_marker(e, "ts", hours), ts="ts")  # noqa: B023
        assert sorted(r[0] for r in got.collect()) == want
    stream = spark.readStream.schema("ts timestamp").parquet(f"{tmp_path}/t.parquet")
    assert "collect_set" in timers.one_marker(stream, "ts")._jdf.queryExecution().logical().toString()


@pytest.mark.parametrize("most", [5, 100_000])
def test_retries_over_triggers(spark, tmp_path, most):
    """A file for each trigger, rows out of order in it and across two files: as in one walk over sorted rows; timers go by keys, not by rows."""
    zero, rng = datetime(2024, 1, 1, tzinfo=timezone.utc), random.Random(3)
    rows = [(n, rng.randrange(3 * 86_400_000) // 60_000 * 60_000, rng.choice("aaaaab") if n % 9 else f"k{n}", rng.random() < 0.2) for n in range(260)]
    for at in range(4):  # half a day of disorder, less than the lateness
        part = [(n, zero + timedelta(milliseconds=ms), k, ok) for n, ms, k, ok in rows if min((ms + n % 2 * 43_200_000) // 86_400_000, 3) == at]
        rng.shuffle(part)
        spark.createDataFrame(part, "event_id long, ts timestamp, key string, ok boolean").coalesce(1).write.mode("append").parquet(f"{tmp_path}/t")
    for _ in range(2):
        spark.createDataFrame([(None, zero + timedelta(days=4000), None, None)], "event_id long, ts timestamp, key string, ok boolean").coalesce(1).write.mode("append").parquet(f"{tmp_path}/t")
    stream = spark.readStream.schema("event_id long, ts timestamp, key string, ok boolean").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/t")
    due = timers.retries_due(stream, "key", "ts", F.col("ok"), F.col("event_id"), most=most)
    before = spark.conf.get(STORE)
    spark.conf.set(STORE, ROCKS)
    try:
        query = due.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start(f"{tmp_path}/out")
        query.awaitTermination()
    finally:
        spark.conf.set(STORE, before)
    start, want = int(zero.timestamp() * 1000), []
    for key in {k for _, _, k, _ in rows}:
        mine, count = sorted((ms, n, ok) for n, ms, k, ok in rows if k == key), 0
        for i, (ms, _, ok) in enumerate(mine):
            count = 0 if ok else count + 1
            then = ms + min(21_600_000, 300_000 * 2 ** (count - 1)) if count else 0
            if count and (i + 1 == len(mine) or mine[i + 1][0] >= then):
                want.append((key, count, start + then))
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").collect())) == sorted(want)
    if most > 5:
        assert sum(p["stateOperators"][0]["customMetrics"]["numRegisteredTimers"] for p in query.recentProgress) < 160


def test_classifiers_get_bounded_runs(spark):
    """However long the texts of a batch are, a classifier gets about a megabyte of them at a time; a longer text may be one of them."""
    docs = spark.range(0, 401, 1, 1).select(F.col("id").alias("id"), F.when(F.col("id") == 7, F.lit(None)).when(F.col("id") == 9, F.repeat(F.lit("y"), F.lit(3_000_000))).otherwise(F.repeat(F.lit("x"), F.lit(20_000))).alias("text"))

    def size(texts):
        return "large" if sum(len(t or "") for t in texts if len(t or "") < 3_000_000) > 1_100_000 else "small"

    many = tx.classify_many(docs, lambda texts: [[size(texts)]] * len(texts), ["large", "small"]).groupBy(F.col("labels")[0]).count().collect()
    one = tx.classify(docs, lambda texts: pd.DataFrame({"label": [size(texts)] * len(texts), "confidence": [50.0] * len(texts)}), ["large", "small"]).groupBy("label").count().collect()
    assert [tuple(r) for r in many] == [tuple(r) for r in one] == [("small", 401)]
