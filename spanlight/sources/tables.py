"""Readers: paged lists, nested offers and credits, grids, HTML anchors, TSV files, keyed stores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from spanlight.functions.scalars import half_up, null_if_na, parse_rating, parse_votes, split_names, truthy_or, turkish_lower

PAGE = "page int, results array<struct<id:bigint,name:string,popularity:double,poster_path:string,first_air_date:string,overview:string>>"
CREDITS = "id bigint, cast array<struct<id:bigint,name:string,character:string,profile_path:string,ord:int>>"


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records that do not parse come as nulls with the text in ``_corrupt``."""
    return spark.read.schema(f"{schema}, _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").json(path)


def ranked_list(pages: DataFrame, n: int = 200) -> DataFrame:
    """Titles of paged results: by page and place, the first of equal ids, the first ``n``, with an ordinal from 1.

    Only the first ``n`` places can matter once each id has its best place, so a limit keeps ``n`` rows per task.
    """
    placed = pages.select("page", F.posexplode("results").alias("pos", "r")).select("page", "pos", "r.*")
    rest = [c for c in placed.columns if c not in ("page", "pos", "id")]
    first = placed.groupBy("id").agg(F.min_by(F.struct("page", "pos", *rest), F.struct("page", "pos")).alias("b")).select("id", "b.*")
    top = first.orderBy("page", "pos").limit(n)
    return top.withColumn("ordinal", F.row_number().over(W.partitionBy(F.lit(0)).orderBy("page", "pos"))).drop("page", "pos")


def leading_credits(credits: DataFrame, n: int = 5) -> DataFrame:
    """(id, cast) with the first ``n`` by billing order; a missing list is empty."""
    listed = F.coalesce("cast", F.array().cast(T.ArrayType(credits.schema["cast"].dataType.elementType)))
    ordered = F.array_sort(listed, lambda a, b: F.when(a["ord"] < b["ord"], -1).when(a["ord"] > b["ord"], 1).otherwise(0))
    return credits.select("id", F.slice(ordered, 1, n).alias("cast"))


def assemble(titles: DataFrame, offers: DataFrame, credits: DataFrame) -> DataFrame:
    """Titles with their nested offers and cast; a title without either has it empty."""
    joined = titles.join(offers, "id", "left").join(credits, "id", "left")
    return joined.withColumn("offers", F.coalesce("offers", F.create_map().cast(offers.schema["offers"].dataType))).withColumn(
        "cast", F.coalesce("cast", F.array().cast(credits.schema["cast"].dataType))
    )


def interest_rows(rows: DataFrame, prefer: str = "location", numeric: bool = False) -> DataFrame:
    """(term, label, value, ordinal): label and value with their second choice; rows without a label or value go.

    ``prefer`` is the column that gives the label unless it is null or empty (``location`` or ``geo``).
    """
    other = "geo" if prefer == "location" else "location"
    value = F.coalesce(F.col("extracted_value"), F.col("value").try_cast("double"))
    kept = value.isNotNull() if numeric else (F.col("extracted_value").isNotNull() | F.col("value").isNotNull())
    label = truthy_or(prefer, other)
    return rows.select("term", label.alias("label"), value.alias("value"), "ordinal", kept.alias("_k")).where(F.col("_k") & F.col("label").isNotNull()).drop("_k")


def grid_years(grid: DataFrame, header: str, subtotal: str, columns: int = 3) -> DataFrame:
    """(row_idx, label, year, value) of a grid (row_idx, cells): the header row is the first whose first cell contains ``header``.

    Years are the numbers in the next ``columns`` cells of the header. Rows above it, subtotal rows and cells that are no
    number are left out; values are rounded, halves up.
    """
    first = F.trim(F.get("cells", F.lit(0)))
    head = grid.where(F.contains(first, F.lit(header))).agg(F.min_by("cells", "row_idx").alias("_head"), F.min("row_idx").alias("_at"))
    body = grid.join(F.broadcast(head)).where((F.col("row_idx") > F.col("_at")) & first.isNotNull() & (first != "") & ~first.rlike(subtotal))
    cell = F.explode(F.sequence(F.lit(1), F.lit(columns))).alias("k")
    long = body.select("row_idx", first.alias("label"), "cells", "_head", cell)
    number = lambda c: F.get(F.col(c), F.col("k")).try_cast("double")
    return long.select("row_idx", "label", number("_head").cast("int").alias("year"), half_up(number("cells")).cast("long").alias("value")).where(
        "year is not null and value is not null"
    )


def anchors(pages: DataFrame, html: str = "html", id_col: str = "page_id") -> DataFrame:
    """(id, pos, href, text) of all links in document order; tags inside the text of a link are removed."""
    pattern = r'(?is)<a\s[^>]*?href="([^"]*)"[^>]*>(.*?)</a>'
    both = F.arrays_zip(
        F.regexp_extract_all(html, F.lit(pattern), F.lit(1)).alias("href"), F.regexp_extract_all(html, F.lit(pattern), F.lit(2)).alias("text")
    )
    found = pages.select(F.col(id_col).alias("id"), F.posexplode(both).alias("pos", "x"))
    return found.select("id", F.col("pos").cast("long").alias("pos"), F.col("x.href").alias("href"), F.trim(F.regexp_replace("x.text", r"<[^>]*>", "")).alias("text"))


def absolute_url(base: Column, href: Column) -> Column:
    """A link made absolute against its page: full, from the host, or beside the page."""
    host = F.regexp_extract(base, r"^(\w+://[^/]+)", 1)
    folder = F.regexp_replace(F.regexp_replace(base, r"[?#].*$", ""), r"(\w+://[^/]+(?:/.*)?)/[^/]*$", "$1")
    return F.when(href.rlike(r"^\w+://"), href).when(href.startswith("/"), F.concat(host, href)).otherwise(F.concat(folder, F.lit("/"), href))


def month_number(text: Column, months: dict[str, int]) -> Column:
    """The number of the first of ``months`` whose name is in the text, both in Turkish lower case; null if none is."""
    low, found = turkish_lower(text), F.lit(None).cast("int")
    for name, number in reversed(list(months.items())):
        found = F.when(F.contains(low, turkish_lower(F.lit(name))), number).otherwise(found)
    return found


def first_bulletin(links: DataFrame, phrase: str, months: dict[str, int], suffix: str = ".xls") -> DataFrame:
    """(id, href, month, year, title): of each page the first link to a sheet whose text has the phrase, a month's name and a year.

    The link must contain ``suffix``; words of the phrase may stand apart by any white space or none, in any case.
    """
    pattern = "(?iu)" + r"\s*".join("".join(c if c.isalnum() else f"\\{c}" for c in w) for w in phrase.split())
    year = F.nullif(F.regexp_extract("text", r"(\d{4})", 1), F.lit("")).cast("int")
    sheets = links.where(F.contains(F.lower("href"), F.lit(suffix)) & F.col("text").rlike(pattern))
    found = sheets.select("id", "pos", "href", month_number(F.col("text"), months).alias("month"), year.alias("year"), F.trim("text").alias("title")).where("month is not null and year is not null")
    return found.groupBy("id").agg(F.min_by(F.struct("href", "month", "year", "title"), "pos").alias("b")).select("id", "b.*")


def rating_records(rows: DataFrame, payload: str = "payload") -> DataFrame:
    """(key, found, rating, votes, top_cast) of JSON answers; one that says ``Response: False``, or does not parse, is not found and has nulls.

    ``N/A`` is null, and an empty list for the cast.
    """
    a = F.from_json(payload, "Response string, imdbRating string, imdbVotes string, Actors string")
    found = a["Response"].isNotNull() & (a["Response"] != "False")
    cast = F.when(a["Actors"].isNull() | (a["Actors"] == "N/A"), F.array().cast("array<string>")).otherwise(split_names(a["Actors"]))
    return rows.select(
        "key", F.coalesce(found, F.lit(False)).alias("found"), F.when(found, parse_rating(a["imdbRating"])).alias("rating"),
        F.when(found, parse_votes(a["imdbVotes"])).alias("votes"), F.when(found, cast).alias("top_cast"),
    )


def latest_indicator(rows: DataFrame, code: str = "code", value: str = "value", ordinal: str = "ordinal") -> DataFrame:
    """(code, value): the last value of each country; rows without a value or a code (null or empty) go first."""
    usable = rows.where(F.col(value).isNotNull() & (F.coalesce(code, F.lit("")) != ""))
    return usable.groupBy(code).agg(F.max_by(value, ordinal).alias(value))


def linked_data(pages: DataFrame, kind: str = "TVSeries", html: str = "html", id_col: str = "page_id") -> DataFrame:
    """(id, name, rating, votes, episodes) from the first JSON-LD block of a type; blocks that do not parse are skipped."""
    blocks = F.regexp_extract_all(html, F.lit(r'(?is)<script[^>]*type="application/ld\+json"[^>]*>(.*?)</script>'), F.lit(1))
    parsed = pages.select(F.col(id_col).alias("id"), F.posexplode(F.transform(blocks, F.try_parse_json)).alias("pos", "v")).where("v is not null")
    get = lambda path, kind: F.try_variant_get("v", path, kind)
    named = parsed.where(get("$['@type']", "string") == kind)
    first = named.groupBy("id").agg(F.min_by(F.struct("pos", F.to_json("v").alias("j")), "pos").alias("b")).select("id", F.parse_json("b.j").alias("v"))
    seasons = F.coalesce(get("$.containsSeason", "array<struct<numberOfEpisodes:int>>"), F.array())
    episodes = F.nullif(F.aggregate(seasons, F.lit(0), lambda a, x: a + F.coalesce(x["numberOfEpisodes"], F.lit(0))), F.lit(0))
    return first.select("id", get("$.name", "string").alias("name"), get("$.aggregateRating.ratingValue", "double").alias("rating"), get("$.aggregateRating.ratingCount", "bigint").alias("votes"), episodes.alias("episodes"))


def read_tsv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    r"""Tab-separated file with a header, without quoting, ``\N`` as null. A gzip file is one split: spread it after reading."""
    df = spark.read.schema(schema).csv(path, sep="\t", header=True, quote="", nullValue="\\N", emptyValue="")
    return df.repartition(spark.sparkContext.defaultParallelism) if path.endswith(".gz") else df


def title_match(basics: DataFrame, name_or_id: str) -> DataFrame:
    """Rows for an id (``tt…`` in any case, then compared exactly) or for a title in either column, without case."""
    if name_or_id.lower().startswith("tt") and name_or_id[2:].isdigit():
        return basics.where(F.col("tconst") == name_or_id)
    wanted = name_or_id.lower()
    return basics.where((F.lower("primaryTitle") == wanted) | (F.lower("originalTitle") == wanted))


def localized_titles(akas: DataFrame) -> DataFrame:
    """(titleId, region, title): the first of equal (region, title) by ordinal; rows without a region go, the region NA stays."""
    clean = akas.select("titleId", "ordinal", null_if_na("region").alias("region"), "title").where("region is not null")
    return clean.groupBy("titleId", "region", "title").agg(F.min("ordinal").alias("ordinal"))


def country_attributes(rows: DataFrame) -> DataFrame:
    """Drops aggregates (region id NA) and rows without a code."""
    return rows.where(~F.col("region_id").eqNullSafe(F.lit("NA")) & F.col("iso2").isNotNull())


def boundaries(spark: SparkSession, path: str, code: str = "ISO_A2") -> DataFrame:
    """(code, geometry) of the features of a GeoJSON file; geometries stay text."""
    schema = f"features array<struct<properties:struct<{code}:string>,geometry:string>>"
    features = spark.read.schema(schema).json(path, multiLine=True).select(F.explode("features").alias("f"))
    return features.select(F.col(f"f.properties.{code}").alias("code"), F.col("f.geometry").alias("geometry"))


def course_totals(courses: DataFrame, language: str) -> DataFrame:
    """One row (learners, courses) of the courses that teach a language; unknown numbers count as 0."""
    return courses.where(F.col("learning_language") == language).agg(
        F.coalesce(F.sum(F.coalesce("learners", F.lit(0))), F.lit(0)).alias("learners"), F.count("*").alias("courses")
    )


def knowledge_panel(rows: DataFrame, payload: str = "payload") -> DataFrame:
    """(key, ratings) of JSON panels; null without ratings."""
    parsed = F.from_json(payload, "ratings array<struct<source:string,rating:string>>")
    return rows.select("key", F.when(F.size(parsed["ratings"]) > 0, parsed["ratings"]).alias("ratings"))


def first_video(rows: DataFrame, payload: str = "payload") -> DataFrame:
    """(key, title, channel, verified, views) of the first video; no video gives nulls."""
    v = F.get(F.from_json(payload, "videos array<struct<title:string,channel:string,verified:boolean,views:bigint>>")["videos"], F.lit(0))
    return rows.select("key", v["title"].alias("title"), F.nullif(v["channel"], F.lit("")).alias("channel"), F.coalesce(v["verified"], F.lit(False)).alias("verified"), v["views"].alias("views"))
