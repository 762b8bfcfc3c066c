"""Changes to keyed tables, as functions from old rows and updates to new rows.

Files are immutable, so a change is a new version of the table: compute it with these functions and write it with
``spanlight.sources.versions``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def newest(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    return rows.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")


def upsert(base: DataFrame, updates: DataFrame, keys: list[str]) -> DataFrame:
    """Updates replace rows of the base with the same key; updates must be unique by key."""
    return base.join(updates, keys, "left_anti").unionByName(updates)


def upsert_columns(base: DataFrame, updates: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Only ``columns`` are replaced on known keys (with nulls too); new keys come with null elsewhere."""
    known = F.col("_known")
    u = updates.select(*keys, *[F.col(c).alias(f"_{c}") for c in columns], F.lit(True).alias("_known"))
    return base.join(u, keys, "full").select(
        *keys, *[F.when(known, F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in base.columns if c not in keys]
    )


def insert_missing(base: DataFrame, updates: DataFrame, keys: list[str]) -> DataFrame:
    """Known keys keep their rows."""
    return base.unionByName(updates.join(base, keys, "left_anti"))


def replace_children(base: DataFrame, children: DataFrame, parent: str, touched: DataFrame | None = None) -> DataFrame:
    """All children of the parents at hand are replaced; ``touched`` names parents that may be left with none."""
    parents = (children if touched is None else touched).select(parent).distinct()
    return base.join(parents, parent, "left_anti").unionByName(children)


def delete_keys(base: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return base.join(gone, keys, "left_anti")


def overlay(base: DataFrame, corrections: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Corrections that are not null win; the newest correction of a key is meant to be the only one."""
    c = corrections.select(*keys, *[F.col(x).alias(f"_{x}") for x in columns])
    joined = base.join(c, keys, "left")
    return joined.select(*[F.coalesce(f"_{x}", x).alias(x) if x in columns else F.col(x) for x in base.columns])


def set_columns(base: DataFrame, updates: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Three-valued updates of known keys: a column is left, set, or set to null.

    ``updates`` has, for each column, its new value and a boolean ``<column>_set``: only where that is true the value is taken, a
    null one too. Updates must be unique by key; those of unknown keys do nothing.
    """
    u = updates.select(*keys, *[F.col(c).alias(f"_{c}") for c in columns], *[F.col(f"{c}_set").alias(f"_{c}_set") for c in columns])
    joined = base.join(u, keys, "left")
    return joined.select(*[F.when(F.coalesce(F.col(f"_{c}_set"), F.lit(False)), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in base.columns])


def clear_columns(base: DataFrame, gone: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """The columns of the keys in ``gone`` become null, as when an override is taken back."""
    nulls = [F.lit(None).cast(base.schema[c].dataType).alias(c) for c in columns]
    return set_columns(base, gone.select(*keys).distinct().select(*keys, *nulls, *[F.lit(True).alias(f"{c}_set") for c in columns]), keys, columns)


class DuplicateKeyError(ValueError):
    """A row to be inserted has a key that is there already, or that comes twice."""


def insert_once(base: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """``base`` and ``rows``; raises ``DuplicateKeyError`` if any key of ``rows`` is in ``base`` or comes twice. Null keys are keys.

    Only the keys are read for the test: those of ``rows`` are counted, and looked for in ``base``.
    """
    twice = rows.groupBy(*keys).count().where("count > 1")
    same = [F.col(f"_{k}").eqNullSafe(F.col(k)) for k in keys]
    known = rows.select(*[F.col(k).alias(f"_{k}") for k in keys]).join(base.select(*keys), same, "left_semi")
    found = twice.select(*keys).unionByName(known.toDF(*keys)).first()
    if found is not None:
        raise DuplicateKeyError(f"key {tuple(found)} is there already")
    return base.unionByName(rows)


def migrate(df: DataFrame, add: dict[str, Column], drop: tuple[str, ...] = ()) -> DataFrame:
    """Columns that are missing are added and filled; columns that are no longer wanted go."""
    missing = {name: value for name, value in add.items() if name not in df.columns}
    return df.withColumns(missing).drop(*drop)


def invalid_choices(df: DataFrame, column: str, valid: list[str]) -> DataFrame:
    """Rows whose value (or any element of an array) is outside a closed set."""
    choices = F.array(*[F.lit(v) for v in valid])
    if dict(df.dtypes)[column].startswith("array"):
        return df.where(F.size(F.array_except(column, choices)) > 0)
    return df.where(~F.coalesce(F.col(column).isin(*valid), F.lit(False)))
