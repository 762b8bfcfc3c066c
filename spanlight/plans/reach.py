"""Queries on reach: visibility, themes, tags, proxies, origins, people, search."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanlight.functions.scalars import half_up
from spanlight.operators import ranking as rank
from spanlight.operators import search as find
from spanlight.operators import upsert as change
from spanlight.operators import visibility as vis
from spanlight.operators.temporal import min_max
from spanlight.plans import bindings as b
from spanlight.plans.bindings import sql
from spanlight.scratch import stash
from spanlight.sources.tables import read_table


def effective_tags(spark, d):
    return b.tagged(spark, d).select("id", F.array_join("tags", ",").alias("tags"), F.size("tags").cast("long").alias("tag_count"))


def tag_facts(spark, d):
    return b.reach(spark, d).join(b.tagged(spark, d).select("id", "popularity", "tags"), "id")


def proxy_fallback(spark, d):
    """Countries of even key are measured; a fallback list names each country twice, with two labels."""
    n = read_table(spark, d, "nation")
    measured = b.totals(spark, d).select("country", "score").join(n.where("n_nationkey % 2 = 0").select(F.col("n_name").alias("country")), "country")
    twice = n.select(F.col("n_name").alias("country"), F.explode(F.array(F.lit(2), F.lit(1))).alias("k"), (F.col("n_nationkey") * 1.5).cast("double").alias("interest"), "n_nationkey")
    fallback = twice.select("country", F.concat("country", F.lit("/"), F.col("k").cast("string")).alias("label"), "interest", (F.col("n_nationkey") * 2 + F.col("k")).alias("ordinal"))
    return vis.proxy_union(measured, fallback).select("country", "score", "label", "interest", "data_source")


def origin_facts(spark, d):
    """Market segments stand for origins."""
    lines = read_table(spark, d, "lineitem").where("l_returnflag in ('A', 'R')").select("l_orderkey", F.col("l_partkey").alias("id"))
    o = read_table(spark, d, "orders").select("o_orderkey", "o_custkey")
    c = read_table(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("origin"), F.col("c_nationkey").alias("country"))
    placed = o.join(c, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "origin", "country")
    sold = lines.join(placed, F.col("l_orderkey") == F.col("o_orderkey")).select("origin", "country", "id").distinct()
    return sold.join(b.titles(spark, d).select("id", "popularity"), "id")


def benchmark(spark, d):
    """Origins with their share of the (already rounded) scores."""
    return rank.shares(vis.origin_metrics(origin_facts(spark, d)), "score")


def title_ranks(spark, d):
    """The ten best titles of each country."""
    top = vis.title_list(b.facts(spark, d), limit=10)
    listed = top.select("country", F.posexplode("titles").alias("pos", "t"))
    return listed.select("country", (F.col("pos") + 1).cast("long").alias("rank"), F.col("t.id").alias("id"), F.col("t.popularity").alias("popularity"))


def untagged_first(spark, d):
    """All titles, those without tags first."""
    listed = b.tagged(spark, d).select("id", (F.size("tags") == 0).alias("untagged"))
    return rank.boolean_first(listed, F.col("untagged"), "id")


def needs_review(spark, d):
    t = b.themed(spark, d)
    return t.where((F.col("confidence") < 70) & ~F.col("is_human")).select("id", "theme", "confidence")


def index(spark, d):
    return find.search_index(b.titles(spark, d), b.credits(spark, d), read_table(spark, d, "nation").select(F.col("n_name").alias("country")))


def migrated(spark, d):
    """A store without two newer columns: one is added and filled, one column goes."""
    s = b.theme_store(spark, d)
    return change.migrate(s, {"method": F.when(F.col("override_theme").isNull(), "model").otherwise("human"), "model_theme": F.lit("never")}, drop=("override_theme",))


def impact(spark, d):
    """The facts are written once: the totals of the countries come from all of them before any title is scored."""
    facts = stash(b.facts(spark, d).select("id", "country", "name", "popularity", "theme", "confidence", "ordinal"), "person-facts")
    return vis.person_impact(facts, b.credits(spark, d), vis.visibility(facts))


def scaled(spark, d):
    """The range comes from all countries but one, which stands for a proxy."""
    rows = min_max(b.totals(spark, d).select("country", "score"), "score", real=F.col("country") != "NATION_0")
    return rows.select("country", half_up("t", 6).alias("t"))


QUERIES = {
    "visibility_by_country": b.totals,
    "theme_scores": lambda s, d: vis.theme_scores(b.facts(s, d)),
    "theme_distribution_global": lambda s, d: vis.global_themes(b.themed(s, d), b.reach(s, d)),
    "destination_scores": lambda s, d: vis.tag_scores(tag_facts(s, d)),
    "destination_ranking": lambda s, d: vis.tag_ranking(b.tagged(s, d), vis.tag_scores(tag_facts(s, d))),
    "effective_theme": lambda s, d: b.themed(s, d).select("id", "theme", "confidence", "is_human"),
    "effective_tags": effective_tags,
    "needs_review": needs_review,
    "proxy_fallback_union": proxy_fallback,
    "benchmark_share": benchmark,
    "title_list_top10": title_ranks,
    "untagged_first": untagged_first,
    "person_impact": impact,
    "actor_network": lambda s, d: vis.person_network(b.facts(s, d), b.credits(s, d), b.places(s, d)),
    "series_countries": lambda s, d: vis.title_countries(b.facts(s, d), b.totals(s, d)),
    "search_index": index,
    "search_prefix": lambda s, d: find.find(index(s, d), "re"),
    "filter_optional": lambda s, d: find.filtered(b.tagged(s, d).join(b.themed(s, d).select("id", "theme"), "id"), text="ring", equals={"theme": "SMALL", "id": None}, contains={"tags": "small"}).select("id", "name", "theme"),
    "schema_migration": migrated,
    "invalid_choices": lambda s, d: change.invalid_choices(b.tagged(s, d), "tags", ["curated", "red", "blue", "ring", "small"]).select("id"),
    "popularity_scaled": scaled,
}


INDEX_SQL = (
    "x AS (SELECT 'title' AS kind, p_partkey::VARCHAR AS key, p_name AS label, '' AS related FROM part "
    "UNION ALL SELECT DISTINCT 'person', person::VARCHAR, person::VARCHAR, p_name FROM credits JOIN part ON id = p_partkey "
    "UNION ALL SELECT 'country', n_name, n_name, '' FROM nation)"
)

ORACLES = {
    "visibility_by_country": sql("SELECT * FROM totals"),
    "theme_scores": sql("SELECT country, theme, score::DOUBLE AS score, confidence, titles FROM by_theme"),
    "theme_distribution_global": sql(
        "SELECT theme, count(*) AS title_count, floor(sum(popularity::DECIMAL(24, 4))::DOUBLE * 10.0 + 0.5) / 10.0 AS score, sum(n)::BIGINT AS countries_reached "
        "FROM themed JOIN (SELECT id, count(*) AS n FROM reach GROUP BY id) USING (id) GROUP BY theme"
    ),
    "destination_scores": sql(
        "SELECT country, tag, count(*) AS title_count, sum(popularity::DECIMAL(24, 4))::DOUBLE AS score FROM (SELECT country, popularity, unnest(tags) AS tag FROM reach JOIN tagged USING (id)) GROUP BY 1, 2"
    ),
    "destination_ranking": sql(
        "SELECT c.tag, c.n AS title_count, coalesce(s.n, 0) AS country_count, coalesce(s.score, 0.0) AS total_score FROM (SELECT tag, count(*) AS n FROM (SELECT unnest(tags) AS tag FROM tagged) GROUP BY 1) c "
        "LEFT JOIN (SELECT tag, count(*) AS n, sum(score)::DOUBLE AS score FROM sc GROUP BY 1) s ON c.tag = s.tag",
        "sc AS (SELECT country, tag, sum(popularity::DECIMAL(24, 4)) AS score FROM (SELECT country, popularity, unnest(tags) AS tag FROM reach JOIN tagged USING (id)) GROUP BY 1, 2)",
    ),
    "effective_theme": sql("SELECT id, theme, confidence, is_human FROM themed"),
    "effective_tags": sql("SELECT id, array_to_string(tags, ',') AS tags, len(tags)::BIGINT AS tag_count FROM tagged"),
    "needs_review": sql("SELECT id, theme, confidence FROM themed WHERE confidence < 70 AND NOT is_human"),
    "proxy_fallback_union": sql(
        "SELECT country, score, NULL::VARCHAR AS label, NULL::DOUBLE AS interest, 'real' AS data_source FROM totals JOIN nation ON country = n_name WHERE n_nationkey % 2 = 0 "
        "UNION ALL SELECT n_name, NULL, n_name || '/1', n_nationkey * 1.5, 'proxy' FROM nation WHERE n_name NOT IN (SELECT country FROM totals JOIN nation ON country = n_name WHERE n_nationkey % 2 = 0)"
    ),
    "benchmark_share": sql(
        "SELECT origin, title_count, score, countries_reached, CASE WHEN t > 0 THEN floor(score / t * 100.0 * 10.0 + 0.5) / 10.0 ELSE 0.0 END AS share_pct FROM m, (SELECT sum(score::DECIMAL(24, 4))::DOUBLE AS t FROM m)",
        "o AS (SELECT DISTINCT c_mktsegment AS origin, c_nationkey AS country, l_partkey AS id FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE l_returnflag IN ('A', 'R')), "
        "m AS (SELECT x.origin, title_count, score, countries_reached FROM (SELECT origin, count(*) AS title_count, floor(sum(p_retailprice::DECIMAL(24, 4))::DOUBLE * 10.0 + 0.5) / 10.0 AS score "
        "FROM (SELECT DISTINCT origin, id FROM o) JOIN part ON id = p_partkey GROUP BY 1) x JOIN (SELECT origin, count(DISTINCT country) AS countries_reached FROM o GROUP BY 1) y ON x.origin = y.origin)",
    ),
    "title_list_top10": sql("SELECT country, rank, id, popularity FROM (SELECT country, id, popularity, row_number() OVER (PARTITION BY country ORDER BY popularity DESC, ordinal) AS rank FROM facts) WHERE rank <= 10"),
    "untagged_first": sql("SELECT id, len(tags) = 0 AS untagged, row_number() OVER (ORDER BY len(tags) = 0 DESC, id) AS rank FROM tagged"),
    "person_impact": sql(
        "SELECT person, id, country_count, impact FROM credits JOIN (SELECT id, count(*) AS country_count, floor(sum((floor(t.score * 10.0 + 0.5) / 10.0)::DECIMAL(24, 4))::DOUBLE * 10.0 + 0.5) / 10.0 AS impact "
        "FROM reach JOIN totals t USING (country) GROUP BY id) USING (id)"
    ),
    "actor_network": sql(
        "SELECT person, country, score, title_count, lat, lng FROM (SELECT person, country, sum(popularity::DECIMAL(24, 4))::DOUBLE AS score, count(*) AS title_count FROM credits JOIN facts USING (id) GROUP BY 1, 2) "
        "JOIN places USING (country) WHERE lat IS NOT NULL AND lng IS NOT NULL"
    ),
    "series_countries": sql("SELECT f.id, f.country, t.score AS country_score, floor(f.popularity / t.score * 100.0 * 100.0 + 0.5) / 100.0 AS share FROM facts f JOIN totals t ON f.country = t.country"),
    "search_index": sql("SELECT * FROM x", INDEX_SQL),
    "search_prefix": sql(
        "SELECT r.kind, r.key, r.label, r.rank, string_agg(DISTINCT related, '|' ORDER BY related) AS related FROM r JOIN x USING (kind, key, label) GROUP BY ALL",
        INDEX_SQL + ", r AS (SELECT * FROM (SELECT kind, key, label, (row_number() OVER (PARTITION BY kind ORDER BY label, key))::INT AS rank "
        "FROM (SELECT DISTINCT kind, key, label FROM x WHERE contains(lower(label), 're'))) WHERE rank <= 6)",
    ),
    "filter_optional": sql("SELECT id, name, theme FROM themed JOIN tagged USING (id) WHERE contains(name, 'ring') AND theme = 'SMALL' AND list_contains(tags, 'small')"),
    "schema_migration": sql(
        "SELECT p_partkey AS id, p_type AS model_theme, (p_size * 2)::INT AS model_confidence, CASE WHEN p_brand = 'Brand#7' THEN 'human' ELSE 'model' END AS method FROM part WHERE p_size < 50"
    ),
    "invalid_choices": sql("SELECT id FROM tagged WHERE len(list_filter(tags, lambda t: t NOT IN ('curated', 'red', 'blue', 'ring', 'small'))) > 0"),
    "popularity_scaled": sql(
        "SELECT country, floor((score - lo) / coalesce(nullif(hi - lo, 0), 1) * 1000000.0 + 0.5) / 1000000.0 AS t FROM totals, (SELECT min(score) AS lo, max(score) AS hi FROM totals WHERE country <> 'NATION_0')"
    ),
}
