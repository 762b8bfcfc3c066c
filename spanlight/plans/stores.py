"""Queries on title stores, scans of files, changes that may fail, multi-label tags, and reports."""

from __future__ import annotations


from pyspark.sql import functions as F

from spanlight.functions import scalars as sc
from spanlight.operators import ledger
from spanlight.operators import temporal as tm
from spanlight.operators import text as tx
from spanlight.operators import upsert as change
from spanlight.operators.report import impact_report
from spanlight.plans import bindings as b
from spanlight.plans.bindings import sql
from spanlight.plans.history import TREND, current_scores, now, older, trended
from spanlight.plans.misc import base, parts
from spanlight.scratch import scratch_path
from spanlight.sources import tables as src
from spanlight.sources import titles, tsv, versions
from spanlight.sources.tables import read_table

#: Month names in Turkish, in the order in which they are looked for.
MONTHS = {"ocak": 1, "şubat": 2, "mart": 3, "nisan": 4, "mayıs": 5, "haziran": 6, "temmuz": 7, "ağustos": 8, "eylül": 9, "ekim": 10, "kasım": 11, "aralık": 12}
TAGS = {"connective": ["the ", " AND"], "german": ["und", "der"], "french": ["que"], "license": ["license", "rights"]}
VALID = ["french", "license", "connective"]


def key_text(prefix, column):
    return F.concat(F.lit(prefix), F.col(column).cast("string"))


def layout(spark, d):
    """Parts as titles, every third without a rating, names by nation: repeated, without a region, and with the region NA."""
    p, c = parts(spark, d), read_table(spark, d, "customer")
    tconst, k = key_text("tt", "p_partkey"), F.col("p_partkey")
    kind = F.when(k % 4 == 0, "movie").when(k % 4 == 1, "tvMiniSeries").otherwise("tvSeries")
    basics = p.select(
        tconst.alias("tconst"), kind.alias("titleType"), F.upper("p_name").alias("primaryTitle"), F.when(k % 5 == 0, F.lit("\\N")).otherwise(F.col("p_type")).alias("originalTitle"),
        (F.col("p_size") + 1970).cast("string").alias("startYear"), F.lit("\\N").alias("endYear"),
    )
    ratings = p.where("p_partkey % 3 <> 0").select(tconst.alias("tconst"), (F.col("p_size") / 10.0).cast("string").alias("averageRating"), k.cast("string").alias("numVotes"))
    n = F.col("c_nationkey")
    region = F.when(n == 0, "NA").when(n % 5 == 1, F.lit("\\N")).otherwise(key_text("R", "c_nationkey"))
    akas = c.select(F.concat(F.lit("tt"), (F.col("c_custkey") % 50).cast("string")).alias("titleId"), F.col("c_custkey").alias("ordinal"), F.col("c_mktsegment").alias("title"), region.alias("region"), (F.col("c_custkey") % 2).cast("string").alias("isOriginalTitle"))
    return titles.write_layout(basics, ratings, akas, buckets=8)


def spelt(rows):
    """Names as one text, for comparison."""
    one = lambda x: F.concat_ws(":", x["ordinal"].cast("string"), x["region"], x["title"], x["is_original"].cast("string"))
    return rows.withColumn("names", F.array_join(F.transform("names", one), "|")).drop("end_year")


def scanned(spark, d):
    """Customers as a file of local names, of which one title is asked for; the file is read in small ranges."""
    c = read_table(spark, d, "customer")
    n = F.col("c_nationkey")
    line = F.concat_ws("\t", key_text("tt", "c_nationkey"), F.col("c_custkey").cast("string"), F.when(n % 5 == 1, F.lit("\\N")).when(n % 5 == 2, "NA").otherwise(F.col("c_mktsegment")), F.concat(F.lit('"'), F.col("c_name")))
    path = scratch_path(spark, "names-tsv")
    head = spark.createDataFrame([(0, 0, "titleId\tordinal\tregion\ttitle")], "o int, k long, value string")
    lines = head.unionByName(c.select(F.lit(1).alias("o"), F.col("c_custkey").alias("k"), line.alias("value")))
    # One part, as the file has one header; the table of customers stands for a file that exists already.
    lines.orderBy("o", "k").coalesce(1).select("value").write.text(path)
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(folder)
    return next(f.getPath().toString() for f in files if f.getPath().getName().startswith("part-"))


def one_title(spark, d):
    rows = tsv.scan_tsv(spark, scanned(spark, d), "titleId string, ordinal long, region string, title string", range_bytes=4096)
    return rows.where(F.col("titleId") == "tt7")


def all_lines(spark, d):
    return src.read_tsv(spark, scanned(spark, d), "titleId string, ordinal long, region string, title string")


def many_tags(spark, d):
    """A classifier that also invents a label, and has no answer for texts of some documents."""
    default = tx.keyword_multi_classifier(TAGS)

    def told(texts):
        return [None if t.startswith("The") else ["invented", *found] for t, found in zip(texts, default(texts), strict=True)]

    return tx.classify_many(read_table(spark, d, "documents"), told, VALID, "text", "doc_id").select("id", F.array_join("labels", ",").alias("labels"))


def point_text(rows):
    return rows.select("key", "score", "direction", "change_pct", "window_days", F.size("points").alias("n_points"), F.array_join(F.transform("points", lambda x: x["event_id"].cast("string")), ",").alias("events"))


def country_rows(spark, d):
    """Users as countries; every seventh has a made-up score."""
    return point_text(tm.trend_rows(current_scores(spark, d), older(spark, d), now(), order=["ts", "event_id"], proxy=F.col("key") % 7 == 0))


def origin_rows(spark, d):
    """Event types as origins."""
    h = b.history(spark, d, "event_type")
    newest = tm.keep_last(h, 1, order=["ts", "event_id"]).select("key", "score")
    return point_text(tm.trend_rows(newest, h.where("ts < TIMESTAMP_NTZ '2024-01-30 00:00:00'"), now(), order=["ts", "event_id"]))


def report(spark, d):
    """Users' trends stand for those of the nation with the same key."""
    n = read_table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("key"), F.col("n_name").alias("country"))
    trend = trended(spark, d).join(n, "key").select("country", "direction", "change_pct")
    return impact_report(b.facts(spark, d), trend, "country", "theme", "popularity", key="country")


def inserted(spark, d):
    """Parts whose key 3 divides, then all others, each once."""
    path = scratch_path(spark, "insert-once")
    p = parts(spark, d).select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    versions.insert_rows_once(p.where("id % 3 = 0"), path, ["id"])
    versions.insert_rows_once(p.where("id % 3 <> 0"), path, ["id"])
    return versions.read_latest(spark, path, "id bigint, name string")


def cleared(spark, d):
    """Of even keys the theme is set, to null for every fourth, and the name is left; then the theme of a few is taken back."""
    p = parts(spark, d).where("p_partkey % 2 = 0")
    k = F.col("p_partkey")
    u = p.select(k.alias("id"), F.lit("unused").alias("name"), (k % 10 == 0).alias("name_set"), F.when(k % 4 != 0, F.col("p_brand")).alias("theme"), F.lit(True).alias("theme_set"))
    done = change.set_columns(base(spark, d), u, ["id"], ["name", "theme"])
    return change.clear_columns(done, p.where("p_partkey % 7 = 0").select(k.alias("id")), ["id"], ["theme"])


def bulletins(spark, d):
    """A page for each part: a link that is no sheet, one without text, then the bulletin of a month."""
    k = F.col("p_partkey")
    listed = F.array(*[F.lit(m) for m in ("Ocak", "ŞUBAT", "Haziran", "MAYIS", "KASIM", "Nothing")])
    month = F.get(listed, (k % 6).cast("int"))
    html = F.concat(
        F.lit('<a href="/page.html">HABER BÜLTENİ MART 2020</a><a href="old.xls"></a><a class="x" href="/b'), k.cast("string"), F.lit('.xlsx">'), month, F.lit(" "), (k % 9 + 2015).cast("string"),
        F.when(k % 2 == 0, F.lit(" HABER  BÜLTENİ</a>")).otherwise(F.lit(" haberbülteni</a>")),
    )
    links = src.anchors(parts(spark, d).select(k.alias("page_id"), html.alias("html")))
    return src.first_bulletin(links, "HABER BÜLTEN", MONTHS)


def records(spark, d):
    k = F.col("p_partkey")
    good = F.concat(
        F.lit('{"Response":"True","imdbRating":"'), F.when(k % 5 == 0, "N/A").otherwise((k % 90 / 10.0).cast("string")), F.lit('","imdbVotes":"'), (k % 9 + 1).cast("string"), F.lit(',0'), (k % 90 + 10).cast("string"),
        F.lit('","Actors":"'), F.when(k % 4 == 0, "N/A").otherwise(F.replace("p_name", F.lit(" "), F.lit(" , "))), F.lit('"}'),
    )
    payload = F.when(k % 3 == 0, '{"Response":"False","Error":"none"}').when(k % 11 == 0, "oops").otherwise(good)
    told = src.rating_records(parts(spark, d).select(k.alias("key"), payload.alias("payload")))
    return told.withColumn("top_cast", F.array_join("top_cast", "|"))


def indicators(spark, d):
    e = read_table(spark, d, "events")
    code = F.when(F.col("user_id") % 27 == 26, F.lit("")).when(F.col("user_id") % 27 < 25, F.concat(F.lit("N"), (F.col("user_id") % 27).cast("string")))
    return src.latest_indicator(e.select(code.alias("code"), F.when(F.col("event_id") % 5 != 0, F.col("value")).alias("value"), F.col("event_id").alias("ordinal")))


def cookies(spark, d):
    k = F.col("p_partkey")
    header = F.concat(F.lit(" session = a%20b+"), k.cast("string"), F.lit("; broken; =x; theme=dark; theme = "), F.when(k % 2 == 0, "light%3D").otherwise("%C3%BC=1"))
    held = sc.cookie_map(F.when(k % 9 != 0, header))
    return parts(spark, d).select(k.alias("id"), F.size(held).alias("n"), held["session"].alias("session"), held["theme"].alias("theme"))


def boundary_codes(spark, d):
    """Nations as one file of features; those whose code is a known key."""
    n = read_table(spark, d, "nation")
    feature = F.struct(F.struct(F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("ISO_A2")).alias("properties"), F.struct(F.lit("Point").alias("type"), F.array(F.col("n_nationkey"), F.col("n_regionkey")).alias("coordinates")).alias("geometry"))
    path = scratch_path(spark, "boundaries")
    n.agg(F.to_json(F.struct(F.collect_list(feature).alias("features"))).alias("value")).coalesce(1).write.text(path)
    return src.boundaries(spark, path).where(F.col("code") != "N3")


def exported(spark, d):
    path = scratch_path(spark, "export")
    o = read_table(spark, d, "orders").select("o_orderkey", "o_orderdate", F.when(F.col("o_orderkey") % 3 != 0, F.concat(F.lit("ğ "), F.col("o_orderkey").cast("string"))).alias("note"))
    versions.export_json(o, path)
    back = spark.read.text(path).select(F.get_json_object("value", "$.o_orderkey").cast("long").alias("o_orderkey"), F.left(F.get_json_object("value", "$.o_orderdate"), F.lit(10)).alias("day"), F.get_json_object("value", "$.note").alias("note"), F.contains("value", F.lit('"note":null')).alias("null_written"))
    return back


QUERIES = {
    "title_rows": lambda s, d: spelt(titles.title_rows(s, layout(s, d))),
    "title_by_name": lambda s, d: spelt(titles.title_rows(s, layout(s, d), "  red WIDGET ")),
    "title_by_id": lambda s, d: spelt(titles.first_match(s, layout(s, d), "tt42")),
    "tsv_pushed_filter": one_title,
    "tsv_rows": all_lines,
    "multi_label_tags": many_tags,
    "country_rows": country_rows,
    "origin_rows": origin_rows,
    "impact_report": report,
    "insert_once": inserted,
    "override_clearing": cleared,
    "bulletin_link": bulletins,
    "rating_records": records,
    "latest_indicator": indicators,
    "truncated_texts": lambda s, d: read_table(s, d, "documents").select("doc_id", sc.truncated("text", 90).alias("text")),
    "existing_count": lambda s, d: ledger.existing(read_table(s, d, "customer"), F.col("c_mktsegment") == "BUILDING"),
    "cookie_values": cookies,
    "boundary_codes": boundary_codes,
    "json_export": exported,
}

NAMES = """
a AS (SELECT 'tt' || (c_custkey % 50) AS tconst, c_custkey AS ordinal, c_mktsegment AS title, CASE WHEN c_nationkey = 0 THEN 'NA' WHEN c_nationkey % 5 <> 1 THEN 'R' || c_nationkey END AS region, c_custkey % 2 = 1 AS orig FROM customer),
one AS (SELECT tconst, region, title, min(ordinal) AS ordinal FROM a WHERE region IS NOT NULL GROUP BY 1, 2, 3),
listed AS (SELECT o.tconst, string_agg(concat_ws(':', o.ordinal, o.region, o.title, a.orig), '|' ORDER BY o.ordinal) AS names FROM one o JOIN a USING (ordinal) GROUP BY 1),
t AS (SELECT 'tt' || p_partkey AS tconst, CASE p_partkey % 4 WHEN 0 THEN 'movie' WHEN 1 THEN 'tvMiniSeries' ELSE 'tvSeries' END AS title_type, upper(p_name) AS primary_title,
             CASE WHEN p_partkey % 5 <> 0 THEN p_type END AS original_title, (p_size + 1970)::INT AS start_year, CASE WHEN p_partkey % 3 <> 0 THEN p_size / 10.0::DOUBLE END AS rating,
             CASE WHEN p_partkey % 3 <> 0 THEN p_partkey END AS votes, coalesce(names, '') AS names FROM part LEFT JOIN listed ON listed.tconst = 'tt' || p_partkey)
"""
POINTS = """
pt AS (SELECT key, count(*)::INT AS n_points, string_agg(event_id::VARCHAR, ',' ORDER BY ts, event_id) AS events
       FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts DESC, event_id DESC) AS r FROM old) WHERE r <= 20 GROUP BY key)
"""
LINES = "l AS (SELECT 'tt' || c_nationkey AS \"titleId\", c_custkey AS ordinal, CASE c_nationkey % 5 WHEN 1 THEN NULL WHEN 2 THEN 'NA' ELSE c_mktsegment END AS region, '\"' || c_name AS title FROM customer)"
ROWS = "SELECT t.key, t.score, {d} AS direction, {c} AS change_pct, {w} AS window_days, {n} AS n_points, {e} AS events FROM trended t LEFT JOIN pt ON t.key = pt.key"
REPORT = """
tr AS (SELECT n_name AS label, direction, change_pct FROM trended JOIN nation ON key = n_nationkey),
cs AS (SELECT country AS label, sum(popularity::DECIMAL(24, 4))::DOUBLE AS score FROM facts GROUP BY 1),
ps AS (SELECT theme AS label, sum(popularity::DECIMAL(24, 4))::DOUBLE AS score FROM facts GROUP BY 1),
ct AS (SELECT cs.label, score, coalesce(direction, 'insufficient') AS direction, change_pct FROM cs LEFT JOIN tr ON cs.label = tr.label),
c5 AS (SELECT * FROM ct ORDER BY score DESC, label LIMIT 5), p5 AS (SELECT * FROM ps ORDER BY score DESC, label LIMIT 5), u5 AS (SELECT * FROM ct WHERE direction = 'rising' ORDER BY change_pct DESC, label LIMIT 5)
"""
ENTRY = "coalesce((SELECT list({{'name': label, 'score': floor(score + 0.5)::BIGINT}} ORDER BY {o}) FROM {t}), [])"

ORACLES = {
    "title_rows": f"WITH {NAMES} SELECT * FROM t",
    "title_by_name": f"WITH {NAMES} SELECT * FROM t WHERE title_type IN ('tvSeries', 'tvMiniSeries') AND (lower(primary_title) = 'red widget' OR lower(original_title) = 'red widget')",
    "title_by_id": f"WITH {NAMES} SELECT * FROM t WHERE tconst = 'tt42'",
    "tsv_pushed_filter": f"WITH {LINES} SELECT * FROM l WHERE \"titleId\" = 'tt7'",
    "tsv_rows": f"WITH {LINES} SELECT * FROM l",
    "multi_label_tags": """
WITH x AS (SELECT doc_id, coalesce(text, '') AS text, lower(replace(replace(coalesce(text, ''), 'İ', 'i'), 'I', 'ı')) AS low FROM documents)
SELECT doc_id AS id, CASE WHEN NOT starts_with(text, 'The') THEN concat_ws(',', CASE WHEN contains(low, 'the ') OR contains(low, ' and') THEN 'connective' END,
       CASE WHEN contains(low, 'que') THEN 'french' END, CASE WHEN contains(low, 'license') OR contains(low, 'rights') THEN 'license' END) END AS labels FROM x
""",
    "country_rows": sql(
        ROWS.format(d="CASE WHEN t.key % 7 = 0 THEN 'insufficient' ELSE direction END", c="CASE WHEN t.key % 7 <> 0 THEN change_pct END", w="CASE WHEN t.key % 7 <> 0 THEN window_days END", n="CASE WHEN t.key % 7 = 0 THEN 0 ELSE coalesce(n_points, 0) END", e="CASE WHEN t.key % 7 = 0 THEN '' ELSE coalesce(events, '') END"),
        TREND + "," + POINTS,
    ),
    "origin_rows": sql(ROWS.format(d="direction", c="change_pct", w="window_days", n="coalesce(n_points, 0)", e="coalesce(events, '')"), TREND.replace("user_id AS key", "event_type AS key") + "," + POINTS),
    "impact_report": sql(
        "SELECT to_json({'total_countries': count(*), 'rising_count': count(*) FILTER (WHERE direction = 'rising'), 'falling_count': count(*) FILTER (WHERE direction = 'falling'), 'top_countries': " + ENTRY.format(o="score DESC, label", t="c5")
        + ", 'other_countries_score': floor(greatest(coalesce(sum(score::DECIMAL(24, 4))::DOUBLE, 0) - coalesce((SELECT sum(score::DECIMAL(24, 4))::DOUBLE FROM c5), 0), 0) + 0.5)::BIGINT, 'rising_countries': " + ENTRY.format(o="change_pct DESC, label", t="u5")
        + ", 'has_enough_history': coalesce(bool_or(direction <> 'insufficient'), false), 'top_places': " + ENTRY.format(o="score DESC, label", t="p5")
        + ", 'other_places_score': (SELECT floor(greatest(coalesce(sum(score::DECIMAL(24, 4))::DOUBLE, 0) - coalesce((SELECT sum(score::DECIMAL(24, 4))::DOUBLE FROM p5), 0), 0) + 0.5)::BIGINT FROM ps), 'analysis': 'pending'})::VARCHAR AS report FROM ct",
        TREND + "," + REPORT,
    ),
    "insert_once": "SELECT p_partkey AS id, p_name AS name FROM part",
    "override_clearing": """
SELECT p_partkey AS id, CASE WHEN p_partkey % 10 = 0 THEN 'unused' ELSE p_name END AS name, p_size AS n,
       CASE WHEN p_partkey % 14 = 0 THEN NULL WHEN p_partkey % 4 = 0 THEN NULL WHEN p_partkey % 2 = 0 THEN p_brand ELSE p_type END AS theme FROM part WHERE p_partkey % 3 <> 0
""",
    "bulletin_link": """
WITH m AS (SELECT p_partkey AS id, CASE p_partkey % 6 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 6 WHEN 3 THEN 5 WHEN 4 THEN 11 END AS month, (p_partkey % 9 + 2015)::INT AS year FROM part)
SELECT id, '/b' || id || '.xlsx' AS href, month::INT AS month, year, ['Ocak', 'ŞUBAT', 'Haziran', 'MAYIS', 'KASIM'][id % 6 + 1] || ' ' || year || CASE WHEN id % 2 = 0 THEN ' HABER  BÜLTENİ' ELSE ' haberbülteni' END AS title FROM m WHERE month IS NOT NULL
""",
    "rating_records": """
SELECT p_partkey AS key, p_partkey % 3 <> 0 AND p_partkey % 11 <> 0 AS found, CASE WHEN found AND p_partkey % 5 <> 0 THEN p_partkey % 90 / 10.0::DOUBLE END AS rating,
       CASE WHEN found THEN ((p_partkey % 9 + 1) || '0' || (p_partkey % 90 + 10))::BIGINT END AS votes, CASE WHEN found THEN CASE WHEN p_partkey % 4 = 0 THEN '' ELSE replace(p_name, ' ', '|') END END AS top_cast FROM part
""",
    "latest_indicator": "SELECT 'N' || (user_id % 27) AS code, arg_max(value, event_id) AS value FROM events WHERE event_id % 5 <> 0 AND user_id % 27 < 25 GROUP BY 1",
    "truncated_texts": "SELECT doc_id, left(text, 90) AS text FROM documents",
    "existing_count": "SELECT count(*) AS count, count(*) > 0 AS exists FROM customer WHERE c_mktsegment = 'BUILDING'",
    "cookie_values": "SELECT p_partkey AS id, CASE WHEN p_partkey % 9 <> 0 THEN 2 ELSE 0 END AS n, CASE WHEN p_partkey % 9 <> 0 THEN 'a b+' || p_partkey END AS session, CASE WHEN p_partkey % 9 = 0 THEN NULL WHEN p_partkey % 2 = 0 THEN 'light=' ELSE 'ü=1' END AS theme FROM part",
    "boundary_codes": "SELECT 'N' || n_nationkey AS code, '{\"type\":\"Point\",\"coordinates\":[' || n_nationkey || ',' || n_regionkey || ']}' AS geometry FROM nation WHERE n_nationkey <> 3",
    "json_export": "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, CASE WHEN o_orderkey % 3 <> 0 THEN 'ğ ' || o_orderkey END AS note, o_orderkey % 3 = 0 AS null_written FROM orders",
}
