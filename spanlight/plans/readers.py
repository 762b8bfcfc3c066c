"""Queries on nested and textual sources: credits, offers, panels, linked data, ratings over external ids."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanlight.functions import scalars as sc
from spanlight.operators import matching as mt
from spanlight.operators import ranking as rank
from spanlight.operators import visibility as vis
from spanlight.plans import bindings as b
from spanlight.plans.bindings import sql
from spanlight.sources import tables as src
from spanlight.sources.tables import read_table


def cast_lists(spark, d):
    """Suppliers as the cast of a part, billed from the largest key down."""
    text = F.lit(None).cast("string")
    member = F.struct(F.col("person").alias("id"), text.alias("name"), text.alias("character"), text.alias("profile_path"), (-F.col("person")).cast("int").alias("ord"))
    return b.credits(spark, d).groupBy("id").agg(F.collect_list(member).alias("cast"))


def leading(spark, d):
    listed = src.leading_credits(cast_lists(spark, d), 5).select("id", F.posexplode("cast").alias("pos", "c"))
    return listed.select("id", "pos", F.col("c.id").alias("person"))


def offers(spark, d):
    """Nested offers (country -> access -> providers) of all titles that have any."""
    each = F.map_from_entries(F.collect_list(F.struct("access", F.array(F.lit("p")))))
    kinds = b.availability(spark, d).groupBy("id", "country").agg(each.alias("kinds"))
    return kinds.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("country", "kinds"))).alias("offers"))


def nested_reach(spark, d):
    return vis.streamable(vis.explode_offers(offers(spark, d)))


def assembled(spark, d):
    whole = src.assemble(b.titles(spark, d), offers(spark, d), src.leading_credits(cast_lists(spark, d), 5))
    return whole.select("id", F.size("offers").alias("countries"), F.size("cast").alias("people"))


def attributes(spark, d):
    n = read_table(spark, d, "nation")
    region = F.when(F.col("n_regionkey") == 0, "NA").when(F.col("n_regionkey") > 1, F.concat(F.lit("R"), F.col("n_regionkey").cast("string")))
    iso2 = F.when(F.col("n_nationkey") % 7 != 3, F.substring("n_name", 1, 2))
    return src.country_attributes(n.select(iso2.alias("iso2"), "n_name", region.alias("region_id")))


def courses(spark, d):
    p = read_table(spark, d, "part")
    return src.course_totals(p.select(F.col("p_type").alias("learning_language"), F.when(F.col("p_size") % 5 != 0, F.col("p_size")).alias("learners")), "PROMO")


def panels(spark, d):
    key = F.col("event_id")
    rated = F.concat(F.lit('{"ratings":[{"source":"a","rating":"'), key.cast("string"), F.lit('/10"}]}'))
    payload = F.when(key % 3 == 0, '{"ratings":[]}').when(key % 3 == 1, rated).otherwise("{}")
    told = src.knowledge_panel(read_table(spark, d, "events").select(key.alias("key"), payload.alias("payload")))
    return told.select("key", F.get("ratings", F.lit(0))["rating"].alias("rating"))


def videos(spark, d):
    key = F.col("event_id")
    one = F.concat(F.lit('{"videos":[{"title":"v'), key.cast("string"), F.lit('","channel":"","views":'), (key * 3).cast("string"), F.lit('},{"title":"later"}]}'))
    payload = F.when(key % 4 == 0, '{"videos":[]}').otherwise(one)
    return src.first_video(read_table(spark, d, "events").select(key.alias("key"), payload.alias("payload")))


def linked(spark, d):
    """Pages made from parts: a block that does not parse, one of another type, then the one that counts."""
    head, tail = '<script type="application/ld+json">', "</script>"
    body = F.concat(
        F.lit('{"@type":"TVSeries","name":"'), F.col("p_name"), F.lit('","aggregateRating":{"ratingValue":'), (F.col("p_size") / 10.0).cast("string"),
        F.lit(',"ratingCount":'), F.col("p_partkey").cast("string"), F.lit('},"containsSeason":[{"numberOfEpisodes":'), (F.col("p_size") % 3).cast("string"), F.lit("}]}"),
    )
    html = F.concat(F.lit(f'{head}{{oops{tail}{head}{{"@type":"Movie","name":"m"}}{tail}'), F.lit(head), body, F.lit(tail))
    return src.linked_data(read_table(spark, d, "part").select(F.col("p_partkey").alias("page_id"), html.alias("html")))


def ratings(spark, d):
    p = read_table(spark, d, "part")
    external = F.concat(F.lit("tt"), F.col("p_partkey").cast("string")).alias("external_id")
    ids = p.where("p_partkey % 4 <> 0").select(F.col("p_partkey").alias("id"), external)
    rated = p.where("p_size % 2 = 0").select(external, (F.col("p_size") / 10.0).alias("rating"), F.col("p_partkey").alias("votes"))
    return mt.rating_chain(b.titles(spark, d), ids, rated)


def public_users(spark, d):
    c = read_table(spark, d, "customer")
    email = F.concat(F.lit("  "), F.upper("c_name"), F.lit("@X.ORG "))
    return vis.without(c.select(F.col("c_custkey").alias("id"), sc.email_key(email).alias("email"), F.col("c_acctbal").alias("password_hash")), "password_hash")


def presented(spark, d):
    o = read_table(spark, d, "orders")
    return o.select("o_orderkey", sc.turkish_number(F.col("o_orderkey") * 977).alias("views"), sc.year_of(F.col("o_orderdate").cast("string")).alias("year"))


def collated(spark, d):
    """All titles by name in Turkish order."""
    return rank.placed(b.titles(spark, d).select("id", "name"), F.collate("name", "tr"), "id")


QUERIES = {
    "leading_credits": leading,
    "nested_offers_reach": nested_reach,
    "assembled_titles": assembled,
    "country_attributes": attributes,
    "course_totals": courses,
    "knowledge_panel": panels,
    "first_video": videos,
    "linked_data": linked,
    "rating_chain": ratings,
    "public_users": public_users,
    "presented_values": presented,
    "names_collated": collated,
}

ORACLES = {
    "leading_credits": "SELECT id, (r - 1)::INT AS pos, person FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY person DESC) AS r FROM (SELECT DISTINCT l_partkey AS id, l_suppkey AS person FROM lineitem)) WHERE r <= 5",
    "nested_offers_reach": sql("SELECT id, country FROM reach"),
    "assembled_titles": sql(
        "SELECT t.id, coalesce(c, 0)::INT AS countries, coalesce(n, 0)::INT AS people FROM themed t LEFT JOIN (SELECT id, count(DISTINCT country) AS c FROM avail GROUP BY id) a ON t.id = a.id "
        "LEFT JOIN (SELECT id, least(5, count(*)) AS n FROM credits GROUP BY id) p ON t.id = p.id"
    ),
    "country_attributes": "SELECT left(n_name, 2) AS iso2, n_name, CASE WHEN n_regionkey > 1 THEN 'R' || n_regionkey END AS region_id FROM nation WHERE n_regionkey <> 0 AND n_nationkey % 7 <> 3",
    "course_totals": "SELECT coalesce(sum(CASE WHEN p_size % 5 <> 0 THEN p_size ELSE 0 END), 0)::BIGINT AS learners, count(*) AS courses FROM part WHERE p_type = 'PROMO'",
    "knowledge_panel": "SELECT event_id AS key, CASE WHEN event_id % 3 = 1 THEN event_id || '/10' END AS rating FROM events",
    "first_video": "SELECT event_id AS key, CASE WHEN event_id % 4 <> 0 THEN 'v' || event_id END AS title, NULL::VARCHAR AS channel, false AS verified, CASE WHEN event_id % 4 <> 0 THEN event_id * 3 END AS views FROM events",
    "linked_data": "SELECT p_partkey AS id, p_name AS name, p_size / 10.0::DOUBLE AS rating, p_partkey AS votes, nullif(p_size % 3, 0)::INT AS episodes FROM part",
    "rating_chain": "SELECT p_partkey AS id, CASE WHEN p_partkey % 4 <> 0 THEN 'tt' || p_partkey END AS external_id, CASE WHEN p_partkey % 4 <> 0 AND p_size % 2 = 0 THEN p_size / 10.0::DOUBLE END AS rating, "
    "CASE WHEN p_partkey % 4 <> 0 AND p_size % 2 = 0 THEN p_partkey END AS votes FROM part",
    "public_users": "SELECT c_custkey AS id, lower(c_name) || '@x.org' AS email FROM customer",
    "presented_values": "SELECT o_orderkey, replace(format('{:,}', o_orderkey * 977), ',', '.') AS views, year(o_orderdate)::INT AS year FROM orders",
    "names_collated": "SELECT p_partkey AS id, p_name AS name, row_number() OVER (ORDER BY p_name, p_partkey) AS rank FROM part",
}
