"""A bitmap of hashed keys that is small enough to be broadcast, so that rows that cannot be hits need no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanlight.llm.common import fresh

PART = 1 << 15  # bits of one row of the bitmap
MOST = 1 << 27  # bits of the whole bitmap at most: 16 MB


def bit_of(held: Column, at: Column) -> Column:
    """Whether bit ``at`` of a row ``held`` of a bitmap is set; false where there is no such row."""
    byte = F.conv(F.hex(F.substring(held, F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.call_function("shiftright", byte, (at % 8).cast("int")).bitwiseAND(1) == 1, F.lit(False))


def bitmap_of(keys: DataFrame, key: Column, bits: int, part: str = "part", held: str = "held") -> DataFrame:
    """(part, held): the rows of a bitmap with the spots of ``key``, each of ``PART`` bits; parts without a bit are missing."""
    at = F.pmod(key, F.lit(bits))
    return keys.select(F.floor(at / PART).alias(part), (at % PART).alias("at")).groupBy(part).agg(F.bitmap_construct_agg("at").alias(held))


def flag_by_keys(docs: DataFrame, key: Column, keys: DataFrame, name: str, most: int = MOST) -> DataFrame:
    """``docs`` in one pass, with a boolean column ``name`` more: whether ``key`` may be among ``keys`` (false: it is not, for certain).

    ``keys``: a written table with one column of long hashes, as ``key`` is. The bitmap has 16 bits for each of them, but no
    more than ``most``: with more keys more rows are held possible, and none is lost.
    """
    bits = PART
    count = keys.count()
    while bits < most and bits < 16 * count:
        bits *= 2
    spot, part, held = fresh(docs, "__spot", "__part", "__bits")
    made = bitmap_of(keys, F.col(keys.columns[0]), bits, part, held)
    placed = docs.withColumn(spot, F.pmod(key, F.lit(bits))).withColumn(part, F.floor(F.col(spot) / PART))
    joined = placed.join(F.broadcast(made), part, "left")
    return joined.select(*[F.col(f"`{c}`") for c in docs.columns], bit_of(F.col(held), F.col(spot) % PART).alias(name))


def split_by_keys(docs: DataFrame, key: Column, keys: DataFrame, most: int = MOST) -> tuple[DataFrame, DataFrame]:
    """(rows of ``docs`` whose ``key`` may be among ``keys``, rows where it is not for certain), by ``flag_by_keys``."""
    (name,) = fresh(docs, "__hit")
    flagged = flag_by_keys(docs, key, keys, name, most)
    names = [F.col(f"`{c}`") for c in docs.columns]
    return flagged.where(F.col(name)).select(*names), flagged.where(~F.col(name)).select(*names)
