"""Joins whose frequent keys stay off the shuffle.

A key is heavy if it holds more than one in ``HEAVY`` of all rows.  As counts add up to the whole, there are fewer than ``HEAVY`` such keys
whatever the input, so these may go to every task; any other key holds at most its share of the rows and is dealt by hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEAVY = 4096


def _is_heavy(m: str, total: int) -> Column:
    return F.col(m) * HEAVY > total


def join_counted(rows: DataFrame, counts: DataFrame, key: str, m: str) -> DataFrame:
    """``rows`` joined with ``counts``, a written table of one row for each key with its number ``m`` of rows; other keys go."""
    total = counts.agg(F.sum(m)).first()[0] or 0
    heavy, rest = counts.filter(_is_heavy(m, total)), counts.filter(~_is_heavy(m, total))
    dealt = rows.join(F.broadcast(heavy.select(key)), key, "left_anti").join(rest.hint("shuffle_hash"), key)
    return rows.join(F.broadcast(heavy), key).unionByName(dealt)


def join_spread(pairs: DataFrame, keyed: DataFrame, keys: list[str], tables: dict[str, str], key: str, value: str) -> DataFrame:
    """The written ``pairs`` with ``value`` of ``keyed`` at each of their two ``keys``, under the names in ``tables``.

    The pairs of a heavy key are dealt by their other key to as many parts as it has shares, each with a copy of its value: fewer than
    2 * ``HEAVY`` copies in all, and never more than one for each pair.
    """
    total = max(1, pairs.count())
    met, sides = pairs, {}
    for k, other in (keys, keys[::-1]):
        counts = pairs.groupBy(k).agg(F.count("*").alias("_m")).filter(_is_heavy("_m", total))
        parts = F.broadcast(counts.select(k, F.least("_m", F.ceil(F.col("_m") * HEAVY / total)).cast("int").alias("_parts")))
        of = F.coalesce("_parts", F.lit(1))
        met = met.join(parts, k, "left").withColumn(f"_part_{k}", F.pmod(F.xxhash64(other), of).cast("int")).drop("_parts")
        side = keyed.select(F.col(key).alias(k), F.col(value).alias(tables[k])).join(parts, k, "left")
        sides[k] = side.select(k, tables[k], F.explode(F.sequence(F.lit(0), of - 1)).alias(f"_part_{k}"))
    for k in keys:
        met = met.join(sides[k], [k, f"_part_{k}"])
    return met.drop(*(f"_part_{k}" for k in keys))
