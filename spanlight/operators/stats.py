"""Guarded statistics over groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanlight.functions.scalars import col, half_up


def pearson(x: Column | str, y: Column | str) -> Column:
    """Aggregate: correlation of the pairs in which both are known; 0 where a side does not vary.

    Merging partial moments can leave a tiny variance where all values are equal, so that case is told by the extremes.
    """
    both = col(x).isNotNull() & col(y).isNotNull()
    a, b = F.when(both, col(x)), F.when(both, col(y))
    n = F.count(F.when(both, 1))
    spread = F.sqrt(F.var_pop(a) * F.var_pop(b))
    r = F.covar_pop(a, b) / F.nullif(spread, F.lit(0.0))
    still = (F.min(a) == F.max(a)) | (F.min(b) == F.max(b))
    return F.when(n == 0, None).when(still, 0.0).otherwise(F.coalesce(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)), F.lit(0.0)))


def fisher_interval(r: Column | str, n: Column | str) -> tuple[Column, Column]:
    """Bounds of the 95 % interval of a correlation, two digits; null below four pairs."""
    z = F.atanh(F.greatest(F.lit(-0.9999), F.least(F.lit(0.9999), col(r))))
    width = 1.96 / F.sqrt(F.nullif(F.greatest(col(n) - 3, F.lit(0)), F.lit(0)))
    bound = lambda b: F.when(col(n) >= 4, half_up(F.tanh(b), 2))
    return bound(z - width), bound(z + width)


def difference_in_differences(treated_before: Column, treated_after: Column, control_before: Column, control_after: Column) -> Column:
    """Struct (did, treated_pct, control_pct), two digits; a change in percent is null where the base is 0."""
    def pct(after: Column, before: Column) -> Column:
        return half_up((after - before) / F.nullif(before, F.lit(0.0)) * 100.0, 2)

    did = half_up((treated_after - treated_before) - (control_after - control_before), 2)
    return F.struct(did.alias("did"), pct(treated_after, treated_before).alias("treated_pct"), pct(control_after, control_before).alias("control_pct"))


def correlation_report(pairs: DataFrame, x: str, y: str, least: int = 3) -> DataFrame:
    """One row (status, pairs, r, low, high). Below ``least`` pairs the status is ``pending`` and all else null.

    The interval takes the rounded correlation.
    """
    row = pairs.agg(F.count(F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), 1)).alias("pairs"), half_up(pearson(x, y), 2).alias("r"))
    low, high = fisher_interval("r", "pairs")
    enough = F.col("pairs") >= least
    return row.select(
        F.when(enough, "computed").otherwise("pending").alias("status"),
        "pairs",
        F.when(enough, F.col("r")).alias("r"),
        F.when(enough, low).alias("low"),
        F.when(enough, high).alias("high"),
    )
