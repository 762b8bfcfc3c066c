"""Queries on scalar functions, text, changes of tables, ledgers and readers."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanlight.functions import scalars as sc
from spanlight.operators import ledger
from spanlight.operators import ranking as rank
from spanlight.operators import temporal as tm
from spanlight.operators import text as tx
from spanlight.operators import upsert as change
from spanlight.operators import visibility as vis
from spanlight.plans import bindings as b
from spanlight.plans.bindings import sql
from spanlight.sources import tables as src
from spanlight.sources.tables import read_table

KEYWORDS = [("connective", "the"), ("connective", "and"), ("german", "und"), ("german", "der"), ("french", "que"), ("license", "license"), ("license", "rights")]
LABELS = {"small": ["small", "tiny"], "colour": ["red", "blue", "green"], "part": ["ring", "bolt", "widget"]}
STOPS = [(0.0, (20, 30, 80)), (0.5, (240, 200, 40)), (1.0, (200, 20, 20))]


def parts(spark, d):
    return read_table(spark, d, "part")


def tagged_docs(spark, d):
    return tx.keyword_tags(read_table(spark, d, "documents"), KEYWORDS, F.col("text"), "doc_id")


def tag_lists(spark, d):
    order = list(dict.fromkeys(t for t, _ in KEYWORDS))
    return tx.tag_lists(tagged_docs(spark, d), order).select("id", F.array_join("tags", ",").alias("tags"))


def brace_json(spark, d):
    e = read_table(spark, d, "events").select("event_id", F.concat(F.lit("text "), "props", F.lit(" tail")).alias("s"))
    return tx.json_part(e, "s", "k int").select("event_id", F.col("parsed.k").alias("k"))


def parsed(spark, d):
    """Numbers written with commas, missing marks and junk."""
    p = parts(spark, d)
    key = F.col("p_partkey")
    votes = F.when(key % 7 == 0, "N/A").otherwise(F.concat((key % 9 + 1).cast("string"), F.lit(","), F.lpad((key % 1000).cast("string"), 3, "0")))
    rating = F.when(key % 5 == 0, "N/A").when(key % 11 == 0, "NaN").otherwise((key % 100 / 10.0).cast("string"))
    names = F.concat(F.lit(" "), F.replace("p_name", F.lit(" "), F.lit(" ,, ")), F.lit(", "))
    date = F.when(key % 4 == 0, "soon").otherwise(F.concat(F.lit("2024-0"), (key % 9 + 1).cast("string"), F.lit("-15T10:00")))
    return p.select(
        F.col("p_partkey").alias("id"),
        sc.parse_votes(votes).alias("votes"),
        sc.parse_rating(rating).alias("rating"),
        F.array_join(sc.split_names(names), "|").alias("names"),
        sc.iso_date(date).alias("date"),
        sc.null_if_na(F.when(key % 3 == 0, F.lit("\\N")).when(key % 3 == 1, F.lit("")).otherwise("x")).alias("cleaned"),
        sc.confidence(F.when(key % 6 == 0, "high").otherwise((key % 300 - 100.5).cast("string"))).alias("confidence"),
    )


def formatted(spark, d):
    p = parts(spark, d)
    key, t = F.col("p_partkey"), F.col("p_size") / 50.0
    return p.select(
        F.col("p_partkey").alias("id"),
        sc.compact_number(key * 7).alias("compact"),
        sc.clamp(t * 3 - 1, 0.0, 1.0).alias("clamped"),
        sc.half_up(sc.lerp(t, 10.0, 20.0), 4).alias("lerped"),
        sc.half_up(key.cast("double") / 4 - 100, 0).alias("rounded"),
        sc.backoff_ms((key % 12 + 1).cast("int")).alias("backoff"),
        sc.cache_key(F.concat(F.lit("  "), "p_name", F.lit(" ")), F.substring("p_brand", 1, 2)).alias("cache_key"),
        sc.trend_label(F.when(key % 4 == 0, "insufficient").when(key % 4 == 1, "rising").when(key % 4 == 2, "falling").otherwise("flat"), (key % 21 - 10).cast("int"), F.lit(7)).alias("label"),
        sc.colour_scale(t, STOPS).alias("colour"),
        F.array_join(F.transform(sc.hex_channels(F.lit("#0aff20")), lambda x: x.cast("string")), ",").alias("channels"),
    )


def hashes(spark, d):
    return tx.distribution_fingerprint(vis.global_themes(b.themed(spark, d), b.reach(spark, d)), "theme", "title_count", "countries_reached")


def shape(lines):
    """A narrator that names the first label; it fails where the number of labels and titles there is odd."""
    told = []
    for of_group in lines:
        label, titles, _ = of_group[0].split(":")
        told.append(f"{label}: {titles} of {len(of_group)} labels" if (int(titles) + len(of_group)) % 2 == 0 else None)
    return told


def country_themes(spark, d):
    return vis.theme_scores(b.facts(spark, d)).select("country", "theme", "titles", "confidence")


def insight_cache(spark, d):
    """Texts for two thirds of the nations' distributions; half of them are a second too old."""
    now = F.expr(b.NOW)
    n = read_table(spark, d, "nation").where("n_nationkey % 3 < 2").select(F.col("n_name").alias("country"), "n_nationkey")
    empty = spark.createDataFrame([], "fingerprint string, insight string, generated_at timestamp_ntz, expires_at timestamp_ntz")
    printed = tx.insights(country_themes(spark, d), ["country"], "theme", ["titles", "confidence"], empty, now).join(n, "country")
    expires = F.when(F.col("n_nationkey") % 3 == 0, now).otherwise(now - F.expr("INTERVAL 1 SECOND"))
    held = printed.groupBy("fingerprint").agg(F.max(expires).alias("expires_at"))
    day = F.expr("INTERVAL 1 DAY")
    return held.select("fingerprint", F.concat(F.lit("kept "), "fingerprint").alias("insight"), (F.col("expires_at") - day).alias("generated_at"), "expires_at")


def country_insights(spark, d):
    return tx.insights(country_themes(spark, d), ["country"], "theme", ["titles", "confidence"], insight_cache(spark, d), F.expr(b.NOW), shape)


def classified(spark, d):
    """The keyword scorer as a model, with names as texts; what it cannot tell falls back to the type."""
    p = parts(spark, d)
    told = tx.classify(p, tx.keyword_classifier(LABELS), list(LABELS), "p_name", "p_partkey")
    fallback = p.select(F.col("p_partkey").alias("id"), F.lower("p_type").alias("label"), F.lit(0).alias("confidence"))
    return tx.with_fallback(told, fallback)


def base(spark, d):
    return parts(spark, d).where("p_partkey % 3 <> 0").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("theme"), F.col("p_size").alias("n"))


def updates(spark, d):
    return parts(spark, d).where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("id"), F.upper("p_name").alias("name"), F.when(F.col("p_partkey") % 4 == 0, F.col("p_brand")).alias("theme"), (F.col("p_size") + 1000).alias("n"))


def children(spark, d):
    l = read_table(spark, d, "lineitem").select(F.col("l_orderkey").alias("parent"), "l_linenumber", "l_quantity").distinct()
    fresh = l.where("parent % 10 = 0").select("parent", F.lit(1).alias("l_linenumber"), F.lit(0.0).alias("l_quantity")).distinct()
    return change.replace_children(l, fresh, "parent")


def caches(spark, d):
    e = tm.keep_last(read_table(spark, d, "events"), 1, key="user_id", order=["ts", "event_id"])
    return e.select(F.col("user_id").alias("key"), F.col("ts").alias("updated_at"), (F.col("ts") + F.expr("INTERVAL 24 HOURS")).alias("expires_at"))


def failures(spark, d):
    e = read_table(spark, d, "events")
    return ledger.failure_ledger(e.select(F.col("user_id").alias("key"), "ts", (F.col("event_type") != "error").alias("ok")))


def retry_table(spark, d):
    f = failures(spark, d)
    return f.select(F.col("key").alias("id"), F.timestamp_millis("next_retry_ms").cast("timestamp_ntz").alias("next_retry_at"), "last_failed_at")


def users(spark, d):
    return read_table(spark, d, "events").select(F.col("user_id").alias("id")).distinct()


def settled(spark, d):
    e = read_table(spark, d, "events").where("event_type = 'signup' and value > 60")
    return e.groupBy(F.col("user_id").alias("id")).agg(F.max("value").alias("v")).select("id", F.when(F.col("v") > 80, "model").otherwise("keyword").alias("method"))


def now():
    return F.expr("TIMESTAMP_NTZ '2024-01-30 12:00:00'")


def grid(spark, d):
    """A sheet: a title, a header with three years, a row for each nation, and subtotals."""
    n = read_table(spark, d, "nation")
    wide = b.arrivals(spark, d).groupBy("key").pivot("year", [1998, 1999, 2000]).agg(F.sum("value"))
    joined = n.join(wide, F.col("n_nationkey") == F.col("key"), "left")
    cell = lambda y: F.when(F.col("n_nationkey") == 3, F.lit("-")).otherwise(F.concat(F.col(y).cast("string"), F.lit(".5")))
    body = joined.select((F.col("n_nationkey") + 10).cast("int").alias("row_idx"), F.array(F.col("n_name"), cell("1998"), cell("1999"), cell("2000")).alias("cells"))
    head = spark.createDataFrame([(1, ["Report"]), (2, ["NATIONALITY", "1998", "1999", "2000"]), (90, ["TOTAL Europe", "1", "2", "3"]), (91, ["", "4", "5", "6"])], "row_idx int, cells array<string>")
    return src.grid_years(body.unionByName(head), "NATIONALITY", "^TOTAL")


def links(spark, d):
    return src.anchors(read_table(spark, d, "pages"))


def urls(spark, d):
    p = read_table(spark, d, "pages")
    return links(spark, d).join(p.select(F.col("page_id").alias("id"), "url"), "id").select("id", "pos", src.absolute_url(F.col("url"), F.col("href")).alias("url"))


def akas(spark, d):
    """Names by nation: repeated, without a region, and with the region NA."""
    c = read_table(spark, d, "customer")
    key = F.col("c_nationkey")
    region = F.when(key == 0, "NA").when(key % 5 == 1, F.lit("\\N")).otherwise(F.concat(F.lit("R"), key.cast("string")))
    return src.localized_titles(c.select((F.col("c_custkey") % 50).alias("titleId"), F.col("c_custkey").alias("ordinal"), region.alias("region"), F.col("c_mktsegment").alias("title")))


def pages_dedup(spark, d):
    """Pages of twenty, where each page repeats some of the titles before it."""
    p = parts(spark, d)
    placed = p.select(F.explode(F.array(F.floor(F.col("p_partkey") / 20), F.floor(F.col("p_partkey") / 20) + F.col("p_partkey") % 2)).alias("page"), "*").distinct()
    title = F.struct(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_retailprice").alias("popularity"))
    pages = placed.groupBy(F.col("page").cast("int").alias("page")).agg(F.sort_array(F.collect_list(title)).alias("results"))
    return src.ranked_list(pages, 200).select("id", "name", "popularity", F.col("ordinal").cast("long").alias("ordinal"))


def matched(spark, d):
    p = parts(spark, d).select(F.concat(F.lit("tt"), "p_partkey").alias("tconst"), F.upper("p_name").alias("primaryTitle"), F.col("p_type").alias("originalTitle"))
    return src.title_match(p, "Red Widget")


def users_sorted(spark, d):
    """All users, those who wait first."""
    c = read_table(spark, d, "customer")
    listed = c.select(F.col("c_custkey").alias("id"), (F.col("c_mktsegment") == "BUILDING").alias("pending"), "c_acctbal")
    return rank.placed(listed, F.col("pending").desc(), F.col("c_acctbal").desc(), "id")


QUERIES = {
    "keyword_tags": tagged_docs,
    "keyword_tag_lists": tag_lists,
    "json_brace_extract": brace_json,
    "parsed_values": parsed,
    "formatted_values": formatted,
    "fingerprint": hashes,
    "cached_insights": lambda s, d: country_insights(s, d).withColumn("lines", F.array_join("lines", "|")),
    "remembered_insights": lambda s, d: tx.remember_insights(insight_cache(s, d), country_insights(s, d)),
    "classify_with_fallback": classified,
    "text_search": lambda s, d: tx.search(read_table(s, d, "documents"), "License", "text").select("doc_id"),
    "toggle_membership": lambda s, d: b.tag_store(s, d).select("id", F.array_join(sc.toggled("auto_tags", F.lit("red")), ",").alias("tags")),
    "upsert_full": lambda s, d: change.upsert(base(s, d), updates(s, d), ["id"]),
    "upsert_partial": lambda s, d: change.upsert_columns(base(s, d), updates(s, d), ["id"], ["theme"]),
    "insert_if_absent": lambda s, d: change.insert_missing(base(s, d), updates(s, d), ["id"]),
    "replace_children": children,
    "delete_keys": lambda s, d: change.delete_keys(base(s, d), updates(s, d).select("id"), ["id"]),
    "overlay_override": lambda s, d: change.overlay(base(s, d), updates(s, d), ["id"], ["theme", "name"]),
    "keep_last_n": lambda s, d: tm.keep_last(read_table(s, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), 3, key="o_custkey", order=["o_orderdate", "o_orderkey"]),
    "failure_ledger": failures,
    "pending_filter": lambda s, d: ledger.pending(users(s, d), settled(s, d), retry_table(s, d), now()),
    "pending_with_retry": lambda s, d: ledger.pending(users(s, d), settled(s, d), retry_table(s, d), now(), settled=F.col("method") == "model"),
    "class_health": lambda s, d: ledger.health(users(s, d), settled(s, d), retry_table(s, d), now()),
    "ttl_expired": lambda s, d: ledger.expired(caches(s, d), now()).select("key"),
    "cache_info": lambda s, d: ledger.cache_info(caches(s, d), now()),
    "rate_limit": lambda s, d: ledger.over_limit(read_table(s, d, "events"), 4, 60, "event_type", "ts"),
    "grid_unpivot": grid,
    "html_anchors": links,
    "html_absolute_urls": urls,
    "title_match": matched,
    "akas_dedup": akas,
    "ranked_pages_dedup": pages_dedup,
    "users_sorted": users_sorted,
}

BASE = """
base AS (SELECT p_partkey AS id, p_name AS name, p_type AS theme, p_size AS n FROM part WHERE p_partkey % 3 <> 0),
upd AS (SELECT p_partkey AS id, upper(p_name) AS name, CASE WHEN p_partkey % 4 = 0 THEN p_brand END AS theme, (p_size + 1000)::INT AS n FROM part WHERE p_partkey % 2 = 0)
"""
LEDGER = """
lo AS (SELECT user_id AS key, max(ts) FILTER (WHERE event_type <> 'error') AS last_ok FROM events GROUP BY 1),
led AS (SELECT key, count(*) AS failure_count, max(ts) AS last_failed_at FROM events JOIN lo ON user_id = key WHERE event_type = 'error' AND (last_ok IS NULL OR ts > last_ok) GROUP BY 1),
ledger AS (SELECT *, epoch_us(last_failed_at) // 1000 + least(21600000, 300000 * pow(2, failure_count - 1))::BIGINT AS next_retry_ms FROM led),
retry AS (SELECT key AS id, make_timestamp(next_retry_ms * 1000) AS next_retry_at, last_failed_at FROM ledger),
users AS (SELECT DISTINCT user_id AS id FROM events),
settled AS (SELECT user_id AS id, CASE WHEN max(value) > 80 THEN 'model' ELSE 'keyword' END AS method FROM events WHERE event_type = 'signup' AND value > 60 GROUP BY 1),
cache AS (SELECT user_id AS key, ts AS updated_at, ts + INTERVAL 24 HOURS AS expires_at FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1)
"""
AT = "TIMESTAMP '2024-01-30 12:00:00'"
TURK = "lower(translate({}, 'İI', 'iı'))"
TAGS = "kt AS (SELECT doc_id AS id, tag, sum(contains(" + TURK.format("coalesce(text, '')") + ", " + TURK.format("kw") + ")::INT)::BIGINT AS hits FROM documents, (VALUES " + ", ".join(f"('{t}', '{k}')" for t, k in KEYWORDS) + ") v(tag, kw) GROUP BY 1, 2 HAVING hits > 0)"
ANCHOR = "(?is)<a\\s[^>]*?href=\"([^\"]*)\"[^>]*>(.*?)</a>"
LINKS = f"lk AS (SELECT page_id AS id, (unnest(range(len(h))))::BIGINT AS pos, unnest(h) AS href, trim(regexp_replace(unnest(t), '<[^>]*>', '', 'g')) AS text FROM (SELECT page_id, regexp_extract_all(html, '{ANCHOR}', 1) AS h, regexp_extract_all(html, '{ANCHOR}', 2) AS t FROM pages))"

INSIGHTS = (
    "dist AS (SELECT country, string_agg(theme || ':' || titles || ':' || confidence, '|' ORDER BY theme) AS lines, count(*) AS labels, arg_min(theme, theme) AS first_theme, arg_min(titles, theme) AS first_titles FROM by_theme GROUP BY 1), "
    "printed AS (SELECT *, left(sha1(lines), 16) AS fingerprint FROM dist), "
    "cache AS (SELECT fingerprint, 'kept ' || fingerprint AS insight, expires_at - INTERVAL 1 DAY AS generated_at, expires_at FROM "
    "(SELECT fingerprint, max(TIMESTAMP '2024-01-31' - CASE WHEN n_nationkey % 3 = 0 THEN INTERVAL 0 SECOND ELSE INTERVAL 1 SECOND END) AS expires_at FROM printed JOIN nation ON country = n_name WHERE n_nationkey % 3 < 2 GROUP BY 1)), "
    "told AS (SELECT country, lines, p.fingerprint, CASE WHEN c.fingerprint IS NOT NULL THEN c.insight WHEN (first_titles + labels) % 2 = 0 THEN first_theme || ': ' || first_titles || ' of ' || labels || ' labels' END AS insight, "
    "coalesce(c.generated_at, TIMESTAMP '2024-01-31') AS generated_at, c.fingerprint IS NOT NULL AS from_cache FROM printed p LEFT JOIN cache c ON p.fingerprint = c.fingerprint AND c.expires_at >= TIMESTAMP '2024-01-31')"
)

ORACLES = {
    "keyword_tags": f"WITH {TAGS} SELECT id, tag, hits FROM kt",
    "keyword_tag_lists": f"WITH {TAGS} SELECT id, string_agg(tag, ',' ORDER BY hits DESC, list_position(['connective', 'german', 'french', 'license'], tag)) AS tags FROM kt GROUP BY id",
    "json_brace_extract": "SELECT event_id, (props->>'k')::INT AS k FROM events",
    "parsed_values": """
SELECT p_partkey AS id, CASE WHEN p_partkey % 7 <> 0 THEN ((p_partkey % 9 + 1) * 1000 + p_partkey % 1000)::BIGINT END AS votes,
       CASE WHEN p_partkey % 5 <> 0 AND p_partkey % 11 <> 0 THEN (p_partkey % 100) / 10.0 END::DOUBLE AS rating, replace(p_name, ' ', '|') AS names,
       CASE WHEN p_partkey % 4 <> 0 THEN make_date(2024, (p_partkey % 9 + 1)::INT, 15) END AS date, CASE WHEN p_partkey % 3 = 2 THEN 'x' END AS cleaned,
       CASE WHEN p_partkey % 6 <> 0 THEN greatest(0, least(100, floor(p_partkey % 300 - 100.5 + 0.5)))::INT END AS confidence
FROM part
""",
    "formatted_values": """
SELECT p_partkey AS id, CASE WHEN p_partkey * 7 < 1000 THEN (p_partkey * 7)::VARCHAR WHEN k = floor(k) THEN floor(k)::BIGINT::VARCHAR || 'k' ELSE k::VARCHAR || 'k' END AS compact,
       greatest(0.0, least(1.0, t * 3 - 1))::DOUBLE AS clamped, floor((10.0 + 10.0 * t) * 10000.0 + 0.5) / 10000.0 AS lerped, floor(p_partkey::DOUBLE / 4 - 100 + 0.5)::DOUBLE AS rounded,
       least(21600000, 300000 * pow(2, p_partkey % 12))::BIGINT AS backoff, lower(translate(trim(p_name), 'I', 'ı')) || '::' || upper(substr(p_brand, 1, 2)) AS cache_key,
       CASE p_partkey % 4 WHEN 0 THEN 'not enough data' ELSE CASE p_partkey % 4 WHEN 1 THEN 'up ' WHEN 2 THEN 'down ' ELSE 'flat ' END || CASE WHEN p_partkey % 21 > 10 THEN '+' ELSE '' END || (p_partkey % 21 - 10) || '% / 7 d' END AS label,
       CASE WHEN t <= 0.5 THEN 'rgb(' || floor(20 + 220 * (t / 0.5) + 0.5)::INT || ',' || floor(30 + 170 * (t / 0.5) + 0.5)::INT || ',' || floor(80 - 40 * (t / 0.5) + 0.5)::INT || ')'
            ELSE 'rgb(' || floor(240 - 40 * ((t - 0.5) / 0.5) + 0.5)::INT || ',' || floor(200 - 180 * ((t - 0.5) / 0.5) + 0.5)::INT || ',' || floor(40 - 20 * ((t - 0.5) / 0.5) + 0.5)::INT || ')' END AS colour,
       '10,255,32' AS channels
FROM (SELECT *, (p_size / 50.0)::DOUBLE AS t, floor(p_partkey * 7 / 1000.0 * 10.0 + 0.5) / 10.0 AS k FROM part)
""",
    "cached_insights": sql("SELECT country, lines, fingerprint, insight, generated_at, from_cache FROM told", INSIGHTS),
    "remembered_insights": sql(
        "SELECT fingerprint, insight, generated_at, expires_at FROM cache WHERE fingerprint NOT IN (SELECT fingerprint FROM told WHERE NOT from_cache AND insight IS NOT NULL) "
        "UNION ALL SELECT DISTINCT fingerprint, insight, generated_at, generated_at + INTERVAL 24 HOURS FROM told WHERE NOT from_cache AND insight IS NOT NULL",
        INSIGHTS,
    ),
    "fingerprint": sql(
        "SELECT left(sha1(string_agg(theme || ':' || title_count || ':' || reached, '|' ORDER BY theme)), 16) AS fingerprint FROM (SELECT theme, count(*) AS title_count, sum(n)::BIGINT AS reached FROM themed JOIN (SELECT id, count(*) AS n FROM reach GROUP BY id) USING (id) GROUP BY 1)"
    ),
    "classify_with_fallback": """
WITH s AS (SELECT p_partkey AS id, lower(p_type) AS ty, contains(p_name, 'small')::INT + contains(p_name, 'tiny')::INT AS s,
                  contains(p_name, 'red')::INT + contains(p_name, 'blue')::INT + contains(p_name, 'green')::INT AS c, contains(p_name, 'ring')::INT + contains(p_name, 'bolt')::INT + contains(p_name, 'widget')::INT AS p FROM part),
b AS (SELECT *, greatest(s, c, p) AS top, list_sort([s, c, p], 'DESC')[2] AS second FROM s)
SELECT id, CASE WHEN top = 0 THEN ty WHEN s = top THEN 'small' WHEN c = top THEN 'colour' ELSE 'part' END AS label,
       CASE WHEN top = 0 THEN 0 ELSE floor(50.0 + 50.0 * (top - second) / top + 0.5) END::INT AS confidence, CASE WHEN top = 0 THEN 'keyword' ELSE 'model' END AS method, top = 0 AS pending FROM b
""",
    "text_search": "SELECT doc_id FROM documents WHERE contains(lower(text), 'license')",
    "toggle_membership": "SELECT p_partkey AS id, array_to_string(CASE WHEN list_contains(string_split(p_name, ' '), 'red') THEN list_filter(string_split(p_name, ' '), lambda x: x <> 'red') ELSE list_append(string_split(p_name, ' '), 'red') END, ',') AS tags FROM part",
    "upsert_full": f"WITH {BASE} SELECT * FROM base WHERE id NOT IN (SELECT id FROM upd) UNION ALL SELECT * FROM upd",
    "upsert_partial": f"WITH {BASE} SELECT coalesce(b.id, u.id) AS id, b.name, CASE WHEN u.id IS NOT NULL THEN u.theme ELSE b.theme END AS theme, b.n FROM base b FULL JOIN upd u ON b.id = u.id",
    "insert_if_absent": f"WITH {BASE} SELECT * FROM base UNION ALL SELECT * FROM upd WHERE id NOT IN (SELECT id FROM base)",
    "replace_children": "SELECT DISTINCT l_orderkey AS parent, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey % 10 <> 0 UNION ALL SELECT DISTINCT l_orderkey, 1, 0.0 FROM lineitem WHERE l_orderkey % 10 = 0",
    "delete_keys": f"WITH {BASE} SELECT * FROM base WHERE id NOT IN (SELECT id FROM upd)",
    "overlay_override": f"WITH {BASE} SELECT b.id, coalesce(u.name, b.name) AS name, coalesce(u.theme, b.theme) AS theme, b.n FROM base b LEFT JOIN upd u ON b.id = u.id",
    "keep_last_n": "SELECT o_custkey, o_orderkey, o_orderdate FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r <= 3",
    "failure_ledger": f"WITH {LEDGER} SELECT * FROM ledger",
    "pending_filter": f"WITH {LEDGER} SELECT users.id FROM users LEFT JOIN retry ON users.id = retry.id WHERE users.id NOT IN (SELECT id FROM settled) AND (next_retry_at IS NULL OR next_retry_at <= {AT})",
    "pending_with_retry": f"WITH {LEDGER} SELECT users.id FROM users LEFT JOIN retry ON users.id = retry.id WHERE users.id NOT IN (SELECT id FROM settled WHERE method = 'model') AND (next_retry_at IS NULL OR next_retry_at <= {AT})",
    "class_health": f"WITH {LEDGER} SELECT u AS total, s AS classified, greatest(0, u - s) AS pending, d AS delayed_retries, r AS retry_ready, m AS last_failed_at FROM (SELECT count(*) AS u FROM users), (SELECT count(*) AS s FROM settled), "
    f"(SELECT count(*) FILTER (WHERE next_retry_at > {AT}) AS d, count(*) FILTER (WHERE next_retry_at <= {AT}) AS r, max(last_failed_at) AS m FROM retry)",
    "ttl_expired": f"WITH {LEDGER} SELECT key FROM cache WHERE {AT} > expires_at",
    "cache_info": f"WITH {LEDGER} SELECT key, updated_at, expires_at, {AT} <= expires_at AS is_fresh FROM cache",
    "rate_limit": "SELECT event_type, date_trunc('hour', ts)::TIMESTAMP AS window_start, count(*) AS attempts FROM events GROUP BY 1, 2 HAVING count(*) > 4",
    "grid_unpivot": sql(
        "SELECT (key + 10)::INT AS row_idx, n_name AS label, year, floor(sum(value) + 0.5 + 0.5)::BIGINT AS value FROM arrivals JOIN nation ON key = n_nationkey WHERE year IN (1998, 1999, 2000) AND key <> 3 GROUP BY key, n_name, year"
    ),
    "html_anchors": f"WITH {LINKS} SELECT * FROM lk",
    "html_absolute_urls": f"WITH {LINKS} SELECT id, pos, CASE WHEN regexp_matches(href, '^\\w+://') THEN href WHEN href LIKE '/%' THEN regexp_extract(url, '^(\\w+://[^/]+)', 1) || href "
    "ELSE regexp_replace(regexp_replace(url, '[?#].*$', ''), '(\\w+://[^/]+(?:/.*)?)/[^/]*$', '\\1') || '/' || href END AS url FROM lk JOIN pages ON id = page_id",
    "title_match": "SELECT 'tt' || p_partkey AS tconst, upper(p_name) AS primaryTitle, p_type AS originalTitle FROM part WHERE lower(p_name) = 'red widget' OR lower(p_type) = 'red widget'",
    "akas_dedup": "SELECT c_custkey % 50 AS titleId, CASE WHEN c_nationkey = 0 THEN 'NA' ELSE 'R' || c_nationkey END AS region, c_mktsegment AS title, min(c_custkey) AS ordinal FROM customer WHERE c_nationkey % 5 <> 1 OR c_nationkey = 0 GROUP BY 1, 2, 3",
    "ranked_pages_dedup": "SELECT p_partkey AS id, p_name AS name, p_retailprice AS popularity, (row_number() OVER (ORDER BY p_partkey)) AS ordinal FROM part ORDER BY p_partkey LIMIT 200",
    "users_sorted": "SELECT c_custkey AS id, c_mktsegment = 'BUILDING' AS pending, c_acctbal, row_number() OVER (ORDER BY c_mktsegment = 'BUILDING' DESC, c_acctbal DESC, c_custkey) AS rank FROM customer",
}
