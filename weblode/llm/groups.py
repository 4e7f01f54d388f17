"""Joining rows to their group's one row, where one group may hold a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A group is heavy if it holds more than one row in so many. Fewer groups than this can be heavy, at any size of the input.
SHARE = 1000


def with_group(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, how: str = "inner") -> DataFrame:
    """``rows`` joined to ``groups``, which has one row for each value of ``keys`` and its number of rows in ``size``.

    Heavy groups are broadcast, a proven bound of ``SHARE`` rows: their members are matched where they lie, whatever their number.
    All others are joined by shuffle, where one key brings a task at most a thousandth of all rows. ``groups`` should be a
    written table, since it is read three times. Keys compare as equal where both are null only if ``keys`` are never null.
    """
    total = groups.agg(F.sum(size)).first()[0] or 0
    heavy = F.col(size) > total // SHARE
    few = F.broadcast(groups.filter(heavy))
    light = groups.filter(~heavy)
    return rows.join(few, keys).unionByName(rows.join(few, keys, "left_anti").join(light, keys, how), allowMissingColumns=True)


#: Tasks that the rows of one heavy key are dealt to where its other side is too large to broadcast.
DEAL = 64


def heavy_keys(rows: DataFrame, key: str) -> DataFrame:
    """The heavy values of ``key``, fewer than ``SHARE``, as (key, _heavy). ``rows`` should be a written table."""
    counts = rows.groupBy(key).agg(F.count("*").alias("_rows"))
    return counts.filter(F.col("_rows") > rows.count() // SHARE + 1).select(key, F.lit(True).alias("_heavy"))


def joined_by(rows: DataFrame, other: DataFrame, key: str, spread: str, heavy: DataFrame | None = None) -> DataFrame:
    """``rows`` joined on ``key`` to ``other``, whose rows may be large and of which a key has few.

    Where a key is heavy, its rows are dealt by the hash of ``spread`` to ``DEAL`` places and its side of ``other`` is copied to each:
    fewer than ``SHARE * DEAL`` copies at any size of the input. With ``heavy`` found beforehand, both sides are read once.
    """
    heavy = F.broadcast(heavy_keys(rows, key) if heavy is None else heavy)
    here = rows.join(heavy, key, "left").withColumn("_deal", F.when(F.col("_heavy"), F.pmod(F.xxhash64(spread), F.lit(DEAL))).otherwise(0).cast("int"))
    there = other.join(heavy, key, "left").withColumn(
        "_deal", F.explode(F.when(F.col("_heavy"), F.sequence(F.lit(0), F.lit(DEAL - 1))).otherwise(F.array(F.lit(0)))))
    return here.drop("_heavy").join(there.drop("_heavy"), [key, "_deal"]).drop("_deal")
