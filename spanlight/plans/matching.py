"""Queries on labels, controls, panels, statistics and interest."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanlight.functions.scalars import half_up
from spanlight.operators import matching as match
from spanlight.operators import ranking as rank
from spanlight.operators import stats
from spanlight.operators import temporal as tm
from spanlight.plans import bindings as b
from spanlight.plans.bindings import sql
from spanlight.plans.history import PAIR, TREND, country_scores, trended
from spanlight.sources import tables as src
from spanlight.sources.tables import read_table


def interest_raw(spark, d):
    """Event types are terms; users of one residue live in one country, named by location, code or not at all."""
    e = read_table(spark, d, "events")
    n = F.col("user_id") % 27
    name = F.concat(F.lit("NATION_"), n.cast("string"))
    return e.select(
        F.col("event_type").alias("term"),
        F.when(n == 26, None).when(F.col("event_id") % 3 == 0, F.lit("")).otherwise(F.lower(name)).alias("location"),
        F.when(n == 26, None).otherwise(F.concat(F.lit("N"), n.cast("string"))).alias("geo"),
        F.when(F.col("event_id") % 5 != 0, F.col("value")).alias("extracted_value"),
        F.when(F.col("event_id") % 7 != 0, F.col("value").cast("string")).alias("value"),
        F.col("event_id").alias("ordinal"),
    )


def codes(spark, d):
    n = read_table(spark, d, "nation")
    return n.select(F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("code"), F.col("n_name").alias("name"))


def resolved(spark, d):
    aliases = spark.createDataFrame([("nation_25", "N0")], "alias string, code string")
    rows = src.interest_rows(interest_raw(spark, d))
    return match.resolve_labels(rows, "label", codes(spark, d), aliases, fold=F.lower)


def per_term(spark, d):
    """The last value of each term and country."""
    known = resolved(spark, d).where("code is not null").select("term", "code", "value", "ordinal")
    return match.last_wins(known, ["term", "code"], "ordinal")


def code_groups(spark, d):
    named = b.membership(spark, d).join(codes(spark, d), F.col("country") == F.col("name"))
    return named.select("code", "continent")


def attributes(spark, d):
    """(key, region, income, gdp) of nations: the most common segment is the income group, the mean balance the gdp."""
    c, n = read_table(spark, d, "customer"), read_table(spark, d, "nation")
    seg = c.groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("n"))
    modal = seg.groupBy("c_nationkey").agg(F.min_by("c_mktsegment", F.struct((-F.col("n")).alias("x"), "c_mktsegment")).alias("income"))
    gdp = c.groupBy("c_nationkey").agg(half_up(F.sum(F.col("c_acctbal").cast("decimal(24,4)")).cast("double") / F.count("*"), 2).alias("gdp"))
    return (
        n.select(F.col("n_nationkey").alias("key"), F.when(F.col("n_regionkey") < 4, F.col("n_regionkey")).alias("region"))
        .join(modal, F.col("key") == modal["c_nationkey"], "left")
        .drop("c_nationkey")
        .join(gdp, F.col("key") == gdp["c_nationkey"], "left")
        .select("key", "region", "income", "gdp")
    )


def controls(spark, d):
    """Nations of even key are treated; those of key 1 and 3 are excluded as controls, and so are the treated."""
    a = attributes(spark, d)
    targets = a.where("key % 2 = 0").select("key")
    excluded = a.where("key % 2 = 0 or key in (1, 3)").select("key")
    return match.suggest_controls(targets, a, excluded)


def panels(spark, d):
    return match.paired_panels(controls(spark, d), tm.arrivals_pair(b.arrivals(spark, d)))


def guarded(spark, d):
    """Correlation of quantity and price by part size; one size has a constant second side."""
    l, p = read_table(spark, d, "lineitem"), read_table(spark, d, "part")
    j = l.join(p, F.col("l_partkey") == F.col("p_partkey")).select("p_size", "l_quantity", F.when(F.col("p_size") == 1, F.lit(1.0)).otherwise(F.col("l_extendedprice")).alias("price"))
    return j.groupBy("p_size").agg(half_up(stats.pearson("l_quantity", "price"), 6).alias("r"), F.count("*").alias("n"))


def intervals(spark, d):
    low, high = stats.fisher_interval("r", "n")
    rows = guarded(spark, d).select("p_size", half_up("r", 2).alias("r"), F.when(F.col("p_size") == 2, F.lit(3)).otherwise(F.col("n")).cast("bigint").alias("n"))
    return rows.select("p_size", "r", "n", low.alias("low"), high.alias("high"))


def impact_summary(spark, d):
    """One row: counts of trends and the leading country with its share."""
    counts = rank.trend_counts(trended(spark, d))
    lead = rank.shares(country_scores(spark, d), "score").orderBy(F.col("score").desc(), "country").limit(1)
    return counts.join(lead.select(F.col("country").alias("leader"), F.col("share_pct").alias("leader_share")))


QUERIES = {
    "interest_clean": lambda s, d: src.interest_rows(interest_raw(s, d)),
    "interest_numeric": lambda s, d: src.interest_rows(interest_raw(s, d), prefer="geo", numeric=True),
    "label_resolution": lambda s, d: resolved(s, d).select("term", "label", "code", "ordinal"),
    "unresolved_labels": lambda s, d: match.unresolved(resolved(s, d), "label"),
    "interest_last_value": per_term,
    "interest_multi_term": lambda s, d: match.merge_terms(per_term(s, d)),
    "interest_by_region_top": lambda s, d: match.top_label(match.merge_terms(per_term(s, d)), code_groups(s, d), "continent", "code", "average"),
    "arrivals_by_continent_top3": lambda s, d: rank.top_in_group(
        tm.latest_arrivals(b.arrivals(s, d)).join(read_table(s, d, "nation"), F.col("key") == F.col("n_nationkey")).select(F.col("n_name").alias("country"), "after_value"), b.membership(s, d), 3, "after_value"
    ).select("continent", "country", "value", F.col("rank").cast("long").alias("rank")),
    "control_match": controls,
    "did": panels,
    "pearson_guarded": guarded,
    "fisher_ci": intervals,
    "tourism_correlation": lambda s, d: stats.correlation_report(panels(s, d), "treated_pct", "control_pct"),
    "impact_summary": impact_summary,
}

RAW = """
raw AS (SELECT event_type AS term, CASE WHEN user_id % 27 = 26 THEN NULL WHEN event_id % 3 = 0 THEN '' ELSE 'nation_' || (user_id % 27) END AS location,
               CASE WHEN user_id % 27 <> 26 THEN 'N' || (user_id % 27) END AS geo, CASE WHEN event_id % 5 <> 0 THEN value END AS extracted_value,
               CASE WHEN event_id % 7 <> 0 THEN value END AS v, event_id AS ordinal FROM events),
clean AS (SELECT term, coalesce(nullif(location, ''), geo) AS label, coalesce(extracted_value, v) AS value, ordinal FROM raw WHERE coalesce(extracted_value, v) IS NOT NULL AND coalesce(nullif(location, ''), geo) IS NOT NULL),
resolved AS (SELECT c.*, coalesce(a.code, n.code, CASE WHEN lower(label) = 'nation_25' THEN 'N0' END) AS code FROM clean c
             LEFT JOIN (SELECT 'N' || n_nationkey AS code FROM nation) a ON upper(c.label) = a.code
             LEFT JOIN (SELECT 'N' || n_nationkey AS code, lower(n_name) AS name FROM nation) n ON lower(c.label) = n.name),
per_term AS (SELECT term, code, value, ordinal FROM (SELECT *, row_number() OVER (PARTITION BY term, code ORDER BY ordinal DESC) AS r FROM resolved WHERE code IS NOT NULL) WHERE r = 1),
merged AS (SELECT code, floor(sum(value::DECIMAL(24, 4))::DOUBLE / count(*) * 10.0 + 0.5) / 10.0 AS average, count(DISTINCT term) AS term_count FROM per_term GROUP BY 1)
"""
CONTROL = """
attrs AS (SELECT n_nationkey AS key, CASE WHEN n_regionkey < 4 THEN n_regionkey END AS region, m.income, g.gdp FROM nation
          LEFT JOIN (SELECT * FROM (SELECT c_nationkey, c_mktsegment AS income, row_number() OVER (PARTITION BY c_nationkey ORDER BY count(*) DESC, c_mktsegment) AS r FROM customer GROUP BY 1, 2) WHERE r = 1) m ON n_nationkey = m.c_nationkey
          LEFT JOIN (SELECT c_nationkey, floor(sum(c_acctbal::DECIMAL(24, 4))::DOUBLE / count(*) * 100.0 + 0.5) / 100.0 AS gdp FROM customer GROUP BY 1) g ON n_nationkey = g.c_nationkey),
sc AS (SELECT t.key, c.key AS control, t.region IS NOT DISTINCT FROM c.region AS sr, coalesce(t.income = c.income, false) AS si,
              CASE WHEN t.gdp > 0 AND c.gdp > 0 THEN greatest(0.0, 2 - abs(ln(t.gdp) - ln(c.gdp))) END AS gs
       FROM attrs t, attrs c WHERE t.key % 2 = 0 AND c.key % 2 = 1 AND c.key NOT IN (1, 3) AND t.key <> c.key),
sd AS (SELECT key, control, floor((CASE WHEN sr THEN 2.0 ELSE 0.0 END + CASE WHEN si THEN 2.0 ELSE 0.0 END + coalesce(gs + 0.01, 0.0)) * 10000.0 + 0.5) / 10000.0 AS score,
              concat_ws(', ', CASE WHEN sr THEN 'same region' END, CASE WHEN si THEN 'same income group' END, CASE WHEN gs > 1 THEN 'similar gdp' END) AS reasons FROM sc),
ctl AS (SELECT key, control, score, reasons FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY score DESC, control) AS r FROM sd WHERE reasons <> '') WHERE r = 1)
"""
PAIRED = (
    CONTROL
    + ","
    + PAIR
    + """,
did AS (SELECT c.key, c.control, t.month, t.before_year, t.after_year, t.before_value, t.after_value, o.before_value AS control_before, o.after_value AS control_after,
               floor(((t.after_value - t.before_value) - (o.after_value - o.before_value)) * 100.0 + 0.5) / 100.0 AS did,
               floor((t.after_value - t.before_value) / nullif(t.before_value, 0) * 100.0 * 100.0 + 0.5) / 100.0 AS treated_pct,
               floor((o.after_value - o.before_value) / nullif(o.before_value, 0) * 100.0 * 100.0 + 0.5) / 100.0 AS control_pct
        FROM ctl c JOIN pair t ON c.key = t.key JOIN pair o ON c.control = o.key AND t.month = o.month AND t.before_year = o.before_year AND t.after_year = o.after_year)
"""
)


R = "floor(CASE WHEN var_pop({x}) * var_pop({y}) > 0 THEN greatest(-1.0, least(1.0, covar_pop({x}, {y}) / sqrt(var_pop({x}) * var_pop({y})))) ELSE 0.0 END * {k} + 0.5) / {k}"
LOW = "CASE WHEN {n} >= 4 THEN floor(tanh(atanh(greatest(-0.9999, least(0.9999, r))) {sign} 1.96 / sqrt(nullif(greatest({n} - 3, 0), 0))) * 100.0 + 0.5) / 100.0 END"
GUARD = f"gd AS (SELECT p_size, {R.format(x='q', y='price', k='1000000.0')} AS r, count(*) AS n FROM (SELECT p_size, l_quantity AS q, CASE WHEN p_size = 1 THEN 1.0 ELSE l_extendedprice END AS price FROM lineitem JOIN part ON l_partkey = p_partkey) GROUP BY 1)"

ORACLES = {
    "interest_clean": sql("SELECT * FROM clean", RAW),
    "interest_numeric": sql("SELECT term, coalesce(nullif(geo, ''), location) AS label, coalesce(extracted_value, v) AS value, ordinal FROM raw WHERE coalesce(extracted_value, v) IS NOT NULL AND coalesce(nullif(geo, ''), location) IS NOT NULL", RAW),
    "label_resolution": sql("SELECT term, label, code, ordinal FROM resolved", RAW),
    "unresolved_labels": sql("SELECT DISTINCT label FROM resolved WHERE code IS NULL", RAW),
    "interest_last_value": sql("SELECT * FROM per_term", RAW),
    "interest_multi_term": sql("SELECT * FROM merged", RAW),
    "interest_by_region_top": sql(
        "SELECT continent, code, average FROM (SELECT continent, code, average, row_number() OVER (PARTITION BY continent ORDER BY average DESC, code) AS r FROM merged JOIN (SELECT 'N' || n_nationkey AS code, r_name AS continent FROM nation JOIN region ON n_regionkey = r_regionkey) USING (code)) WHERE r = 1",
        RAW,
    ),
    "control_match": sql("SELECT * FROM ctl", CONTROL),
    "did": sql("SELECT * FROM did", PAIRED),
    "pearson_guarded": sql("SELECT * FROM gd", GUARD),
    "fisher_ci": sql(f"SELECT p_size, r, n, {LOW.format(n='n', sign='-')} AS low, {LOW.format(n='n', sign='+')} AS high FROM (SELECT p_size, floor(r * 100.0 + 0.5) / 100.0 AS r, CASE WHEN p_size = 2 THEN 3 ELSE n END::BIGINT AS n FROM gd)", GUARD),
    "tourism_correlation": sql(
        f"SELECT CASE WHEN pairs >= 3 THEN 'computed' ELSE 'pending' END AS status, pairs, CASE WHEN pairs >= 3 THEN r END AS r, CASE WHEN pairs >= 3 THEN {LOW.format(n='pairs', sign='-')} END AS low, "
        f"CASE WHEN pairs >= 3 THEN {LOW.format(n='pairs', sign='+')} END AS high FROM (SELECT count(*) AS pairs, {R.format(x='treated_pct', y='control_pct', k='100.0')} AS r FROM did WHERE treated_pct IS NOT NULL AND control_pct IS NOT NULL)",
        PAIRED,
    ),
}

ORACLES |= {
        "arrivals_by_continent_top3": sql(
            "SELECT continent, country, after_value AS value, row_number() OVER (PARTITION BY continent ORDER BY after_value DESC, country) AS rank FROM pair JOIN nation ON key = n_nationkey JOIN membership ON n_name = country QUALIFY rank <= 3", PAIR
        ),
        "impact_summary": sql(
            "SELECT count(*) FILTER (WHERE direction = 'rising') AS rising, count(*) FILTER (WHERE direction = 'falling') AS falling, count(*) AS total, coalesce(bool_or(direction <> 'insufficient'), false) AS enough_history, "
            "(SELECT country FROM totals ORDER BY score DESC, country LIMIT 1) AS leader, floor((SELECT max(score) FROM totals) / (SELECT sum(score::DECIMAL(24, 4))::DOUBLE FROM totals) * 100.0 * 10.0 + 0.5) / 10.0 AS leader_share FROM trended",
            TREND,
        ),
}
