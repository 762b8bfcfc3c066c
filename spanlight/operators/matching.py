"""Labels to codes, controls for treated keys, panels side by side."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from spanlight.functions.scalars import exact_sum, half_up, log_distance_score, reasons, turkish_lower
from spanlight.operators.stats import difference_in_differences


def resolve_labels(rows: DataFrame, label: str, places: DataFrame, aliases: DataFrame | None = None, code: str = "code", out: str = "code", fold: Callable[[Column], Column] = turkish_lower) -> DataFrame:
    """Rows with a code for their label: the label itself if it is a known code, else by name, else by alias, else null.

    ``places``: (code, name); ``aliases``: (alias, code). Names are compared after ``fold``; of equal names the first code counts.
    All keys go into one lookup table, so each label is looked up with a single join.
    """
    own = places.select(F.upper(code).alias("k"), F.lit(0).alias("stage"), F.col(code).alias("_code"))
    named = places.select(fold(F.trim("name")).alias("k"), F.lit(1).alias("stage"), F.col(code).alias("_code"))
    table = own.unionByName(named)
    if aliases is not None:
        table = table.unionByName(aliases.select(fold(F.trim("alias")).alias("k"), F.lit(2).alias("stage"), F.col(code).alias("_code")))
    best = table.groupBy("k").agg(F.min(F.struct("stage", "_code")).alias("b")).select("k", F.col("b.stage").alias("stage"), F.col("b._code").alias("_code"))
    text = F.trim(label)
    upper, lower = F.upper(text), fold(text)
    first = best.where("stage = 0").select(F.col("k").alias("k0"), F.col("_code").alias("c0"))
    later = best.where("stage > 0").select(F.col("k").alias("k1"), F.col("_code").alias("c1"))
    keyed = rows.withColumns({"_u": upper, "_l": lower})
    joined = keyed.join(first, F.col("_u") == F.col("k0"), "left").join(later, F.col("_l") == F.col("k1"), "left")
    return joined.withColumn(out, F.coalesce("c0", "c1")).drop("_u", "_l", "k0", "c0", "k1", "c1")


def unresolved(resolved: DataFrame, label: str, code: str = "code") -> DataFrame:
    return resolved.where(F.col(code).isNull()).select(label).distinct()


def suggest_controls(targets: DataFrame, candidates: DataFrame, excluded: DataFrame, key: str = "key") -> DataFrame:
    """(key, control, score, reasons): the best candidate of each target.

    ``candidates``: (key, region, income, gdp) of all keys; a target is never its own control, nor is an excluded key. 2 for
    the same region (two unknown regions are the same), 2 for the same income group, up to 2 for a similar gdp, and
    0.01 if both gdps are known. At least one reason is needed. Ties: the smaller key, among scores that agree to four decimals.

    No target meets all candidates of its region or income group. Within those that share both, the region, the income group, or
    nothing, only the nearest by gdp on either side can win, or the smallest keys where gdp decides nothing; so each target has a
    handful of candidates, whatever the size of a group.
    """
    pool = candidates.join(excluded.select(key).distinct().withColumn("_out", F.lit(True)), key, "left")
    pool = pool.join(targets.select(key).distinct().withColumn("_want", F.lit(True)), key, "left")
    log = F.when(F.col("gdp") > 0, F.ln("gdp"))
    rows = pool.select(key, "region", "income", "gdp", log.alias("x"), F.col("_out").isNull().alias("cand"), F.col("_want").isNotNull().alias("want"))
    named = lambda c: F.coalesce(F.concat(F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("-"))
    both, same_region = F.concat(F.lit("b"), named("region"), named("income")), F.concat(F.lit("r"), named("region"))
    groups = F.array(F.when(F.col("income").isNotNull(), both), same_region, F.when(F.col("income").isNotNull(), F.concat(F.lit("i"), named("income"))), F.when(F.col("x").isNotNull(), F.lit("all")))
    grouped = rows.select(key, "x", "cand", "want", F.explode(F.array_compact(groups)).alias("g"))
    wanted = grouped.where("want")
    near = _neighbours(grouped, key)
    by_gdp = wanted.where("x is not null").select(key, "g", "x").join(near, ["g", "x"]).select(key, F.explode("controls").alias("control"))
    least = _smallest(grouped.where("cand and g <> 'all'").withColumn("known", F.col("x").isNotNull()), ["g", "known"], key)
    least = least.groupBy("g").agg(F.collect_list("_k").alias("controls"))  # four at most
    by_key = wanted.where("g <> 'all'").select(key, "g").join(least, "g").select(key, F.explode("controls").alias("control"))
    handful = by_gdp.unionByName(by_key).where(F.col("control") != F.col(key)).distinct()

    mine = rows.where("want").select(key, "region", "income", "gdp")
    theirs = rows.where("cand").select(F.col(key).alias("control"), F.col("region").alias("r2"), F.col("income").alias("i2"), F.col("gdp").alias("g2"))
    found = handful.join(mine, key).join(theirs, "control")
    same_region = F.col("region").eqNullSafe(F.col("r2"))
    same_income = F.coalesce(F.col("income") == F.col("i2"), F.lit(False))
    gdp = log_distance_score("gdp", "g2")
    score = F.when(same_region, 2.0).otherwise(0.0) + F.when(same_income, 2.0).otherwise(0.0) + F.coalesce(gdp + 0.01, F.lit(0.0))
    text = reasons((same_region, "same region"), (same_income, "same income group"), (F.coalesce(gdp > 1, F.lit(False)), "similar gdp"))
    scored = found.select(key, "control", half_up(score, 4).alias("score"), text.alias("reasons")).where("reasons <> ''")
    best = F.min_by(F.struct("control", "score", "reasons"), F.struct((-F.col("score")).alias("s"), "control")).alias("b")
    return scored.groupBy(key).agg(best).select(key, "b.control", "b.score", "b.reasons")


def _smallest(rows: DataFrame, by: list[str], key: str, n: int = 2) -> DataFrame:
    """(by…, _k): the ``n`` smallest keys of each group; tasks keep ``n`` of their own before the shuffle."""
    ranked = rows.select(*by, F.col(key).alias("_k")).withColumn("_r", F.row_number().over(W.partitionBy(*by).orderBy("_k")))
    return ranked.where(F.col("_r") <= n).drop("_r")


def _neighbours(grouped: DataFrame, key: str, cells: int = 1024) -> DataFrame:
    """(g, x, controls): at each place ``x`` of a target, the two smallest candidates there and one at the next place on each side.

    A group is cut into cells of a ``cells``-th of a unit of the logarithm. Places meet in an ordered window inside their cell, and the ends of
    cells in one over the cells of a group, so a group of any size is spread; a group has few cells, as logarithms are small numbers.
    """
    known = grouped.where("x is not null")
    here = _smallest(known.where("cand"), ["g", "x"], key).groupBy("g", "x").agg(F.min("_k").alias("k1"), F.max("_k").alias("k2"))
    places = here.unionByName(known.where("want").select("g", "x"), allowMissingColumns=True).groupBy("g", "x").agg(F.max("k1").alias("k1"), F.max("k2").alias("k2"))
    places = places.withColumns({"cell": F.floor(F.col("x") * cells), "near": F.when(F.col("k1").isNotNull(), F.struct("x", "k1"))})
    inside, across = W.partitionBy("g", "cell").orderBy("x"), W.partitionBy("g").orderBy("cell")
    earlier, later = (lambda w: w.rowsBetween(W.unboundedPreceding, -1)), (lambda w: w.rowsBetween(1, W.unboundedFollowing))
    ends = places.groupBy("g", "cell").agg(F.min("near").alias("low"), F.max("near").alias("high"))
    ends = ends.select("g", "cell", F.last("high", True).over(earlier(across)).alias("below"), F.first("low", True).over(later(across)).alias("above"))
    sided = places.withColumns({"before": F.last("near", True).over(earlier(inside)), "after": F.first("near", True).over(later(inside))}).join(ends, ["g", "cell"])
    controls = F.array("k1", "k2", F.coalesce("before", "below")["k1"], F.coalesce("after", "above")["k1"])
    return sided.select("g", "x", F.array_distinct(F.array_compact(controls)).alias("controls"))


def paired_panels(controls: DataFrame, pairs: DataFrame, key: str = "key") -> DataFrame:
    """Treated and control pairs that agree on month and both years, with the difference in differences.

    ``pairs``: (key, month, before_year, after_year, before_value, after_value).
    """
    same = ["month", "before_year", "after_year"]
    treated = controls.select(key, "control").join(pairs, key)
    other = pairs.select(F.col(key).alias("control"), *same, F.col("before_value").alias("control_before"), F.col("after_value").alias("control_after"))
    joined = treated.join(other, ["control", *same])
    did = difference_in_differences(F.col("before_value"), F.col("after_value"), F.col("control_before"), F.col("control_after"))
    return joined.withColumn("d", did).select(key, "control", *same, "before_value", "after_value", "control_before", "control_after", "d.did", "d.treated_pct", "d.control_pct")


def merge_terms(interest: DataFrame, key: str = "code", value: str = "value", term: str = "term") -> DataFrame:
    """(key, average, term_count): mean over the terms that know a key; a union and one aggregate replace outer joins."""
    return interest.groupBy(key).agg(half_up(exact_sum(value) / F.count(F.col(value)), 1).alias("average"), F.countDistinct(term).alias("term_count"))


def last_wins(df: DataFrame, keys: list[str], ordinal: str) -> DataFrame:
    """The row with the largest ordinal of each key."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max(F.struct(ordinal, *[c for c in rest if c != ordinal])).alias("b"))
    return best.select(*keys, "b.*").select(df.columns)


def top_label(index: DataFrame, membership: DataFrame, group: str, key: str, value: str) -> DataFrame:
    """(group, key, value): the key with the largest value of each group; ties: the smaller key."""
    ranked = index.join(membership, key).withColumn("_r", F.row_number().over(W.partitionBy(group).orderBy(F.col(value).desc(), key)))
    return ranked.where("_r = 1").select(group, key, value)


def rating_chain(titles: DataFrame, external_ids: DataFrame, ratings: DataFrame, id_col: str = "id", external: str = "external_id") -> DataFrame:
    """(id, external_id, rating, votes): ratings found over the external id; null from the step on that finds nothing."""
    found = titles.select(id_col).join(external_ids.select(id_col, external), id_col, "left")
    return found.join(ratings.select(external, "rating", "votes"), external, "left").select(id_col, external, "rating", "votes")
