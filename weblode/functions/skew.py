"""Look-ups whose asking side may be skewed: one key can be asked for by a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is heavy if more than one row in so many asks for it; fewer keys than this can be.
SHARE = 1000


def looked_up(rows: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` left-joined to ``table``, which has one row for each value of ``keys``.

    The entries of heavy keys, fewer than ``SHARE`` at any size, are broadcast and matched where their rows lie. All others are
    joined by shuffle, where one key brings a task a thousandth of the rows at most. Rows with a null key match nothing and
    are not moved. ``rows`` and ``table`` are read more than once: pass written tables.
    """
    known = rows.dropna(subset=keys)
    counts = known.groupBy(*keys).agg(F.count("*").alias("_asked"))
    heavy = counts.filter(F.col("_asked") > rows.count() // SHARE + 1).select(*keys)
    entries = table.join(F.broadcast(heavy), keys, "left_semi")
    here = known.join(F.broadcast(heavy), keys, "left_semi").join(F.broadcast(entries), keys, "left")
    rest = known.join(F.broadcast(heavy), keys, "left_anti").join(table, keys, "left")
    lost = rows.filter(" OR ".join(f"`{k}` IS NULL" for k in keys))
    return here.unionByName(rest).unionByName(lost, allowMissingColumns=True)
