"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weblode.sources.stages import written

BLOCK = 16
SHARD_WORDS = 1 << 20
SHARD_ROWS = 1 << 12


def word_count(text: Column) -> Column:
    """Runs of characters outside ``[\\x20\\x09-\\x0D]``; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """Adds weight and target to ``sources(source, source_size)``: the share by weight, stopped at ``most`` times the source.

    Sources take the weights in turn by code point, null last. What a stopped source leaves is reshared by weight until none is
    above its stop; that level is the largest of (total - stops so far) / (weights left) over sources in order of stop / weight.
    """
    by_name, by_level = Window.orderBy(F.col("source").asc_nulls_last()), Window.orderBy("stop_level", "turn")
    ranked = sources.withColumn("turn", F.row_number().over(by_name)).withColumn(
        "weight", F.get(F.array(*map(F.lit, weights)), (F.col("turn") - 1) % len(weights)).cast("double"))
    ranked = ranked.withColumn("stop", F.lit(float(most)) * F.col("source_size")).withColumn("stop_level", F.col("stop") / F.col("weight"))
    before, every = by_level.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    level = ((F.sum(F.col("source_size").cast("double")).over(every) - F.coalesce(F.sum("stop").over(before), F.lit(0.0)))
             / F.sum("weight").over(by_level.rowsBetween(0, Window.unboundedFollowing)))
    leveled = ranked.withColumn("level", level).withColumn("level", F.max("level").over(every))
    return leveled.select("source", "source_size", "docs", "turn", F.least("stop", F.col("level") * F.col("weight")).alias("target"))


def sainte_lague(parties: DataFrame, votes: str, seats: str, order: list[str], within: list[str]) -> DataFrame:
    """Adds ``quota``: seats dealt by highest quotients votes / (2 s + 1), ties by ``order``, separately within ``within``.

    No seat is dealt one by one. With n parties the divisor lies between total / (seats + n / 2) and total / (seats - n / 2), so
    each party's seats are known but for a few, about 2 n in all; only those are ranked.
    """
    every = Window.partitionBy(*within)
    sure = parties.withColumn("_v", F.col(votes).cast("double")).withColumn("_all", F.sum("_v").over(every)).withColumn(
        "_half", F.count("*").over(every) / F.lit(2.0) + 1)
    low = F.greatest(F.floor(F.col("_v") * (F.col(seats) - F.col("_half")) / F.col("_all") + 0.5) - 1, F.lit(0))
    high = F.floor(F.col("_v") * (F.col(seats) + F.col("_half")) / F.col("_all") + 0.5) + 1
    none = (F.col("_all") <= 0) | (F.col("_v") <= 0)
    sure = sure.withColumn("_low", F.when(none, 0).otherwise(low).cast("long")).withColumn("_high", F.when(none, 0).otherwise(high).cast("long"))
    sure = sure.withColumn("_open", F.col(seats) - F.sum("_low").over(every))
    open_ = sure.select(*parties.columns, "_v", "_low", "_open", F.explode_outer(
        F.when(F.col("_high") > F.col("_low"), F.sequence(F.col("_low") + 1, F.col("_high")))).alias("_seat"))
    ranked = open_.withColumn("_rank", F.row_number().over(every.orderBy(
        (F.col("_v") / (F.col("_seat") - 0.5)).desc_nulls_last(), *order)))
    won = (F.col("_seat").isNotNull() & (F.col("_rank") <= F.col("_open"))).cast("long")
    return ranked.groupBy(*parties.columns).agg((F.max("_low") + F.sum(won)).alias("quota"))


def mixture(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3, seed: int = 42, block: int = BLOCK,
            shard_words: int = SHARD_WORDS, shard_rows: int = SHARD_ROWS, places: bool = False) -> DataFrame:
    """``docs(doc_id, text, source, ...)`` to one row per input row: doc_id, size, source_size, target, taken; with ``places`` also the
    number of the source (turn) and the shard.

    1. Sizes are counted in the scan; everything after works on rows of a few numbers.
    2. ``targets`` gives every source its share of all words; Sainte-Lague deals blocks of ``block`` words to the sources.
    3. A source of any size is cut by a seeded hash of doc_id into shards of about ``shard_words`` words and ``shard_rows`` rows, and
       Sainte-Lague deals its blocks to them as integer quotas.
    4. In a shard the documents lie end to end in seeded order, as a ring. Its quota of blocks is laid on the ring from a seeded
       start: whole rounds, then one arc. A document's ``taken`` words are its rounds plus its part of the arc.

    A quota stops at ``most`` rounds, so no document is taken more than ``most`` times. A source's taken words miss its target by
    less than a block, and where it is stopped by less than a block a shard. Null texts have size 0 and are taken 0 times; a null
    source is a source, ordered last; null doc_ids are hashed as the word ``null``. Reruns agree. An empty table gives no rows.
    """
    sized = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
                                word_count(F.col("text").cast("string")).alias("size")), "mix-sizes")
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    goals = targets(sources, weights, most).withColumn("blocks", F.floor(F.sum("source_size").over(Window.partitionBy()) / block))
    goals = sainte_lague(goals, "target", "blocks", ["turn"], []).withColumnRenamed("quota", "source_blocks")
    goals = goals.withColumn("shards", (1 + F.floor(F.col("source_size") / shard_words) + F.floor(F.col("docs") / shard_rows)).cast("long"))
    goals = written(goals, "mix-sources")

    draw = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    placed = sized.join(goals.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).withColumn("draw", draw).withColumn(
        "shard", F.pmod(F.conv(F.substring("draw", 1, 8), 16, 10).cast("long"), F.col("shards")))
    shards = placed.groupBy("turn", "source_blocks", "shard").agg(F.sum("size").alias("words"))
    quotas = sainte_lague(shards, "words", "source_blocks", ["shard"], ["turn"]).select(
        F.col("turn").alias("_turn"), F.col("shard").alias("_shard"), "words",
        (F.least("quota", F.floor(F.lit(most) * F.col("words") / block)) * block).alias("quota"))
    start = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("_turn").cast("string"), F.lit(":"), F.col("_shard").cast("string"))), 1, 12), 16, 10)
    ring = quotas.filter("words > 0").withColumn("rounds", F.expr("quota div words")).withColumn(
        "arc", F.col("quota") % F.col("words")).withColumn("start", start.cast("long") % F.col("words"))

    lane = Window.partitionBy("turn", "shard").orderBy("draw", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    laid = placed.withColumn("stop", F.sum("size").over(lane)).withColumn("begin", F.col("stop") - F.col("size"))
    both = laid.join(ring, (F.col("turn") == F.col("_turn")) & (F.col("shard") == F.col("_shard")), "left")
    head = F.greatest(F.least("stop", F.col("start") + F.col("arc")) - F.greatest("begin", "start"), F.lit(0))
    wrapped = F.greatest(F.least(F.col("stop"), F.col("start") + F.col("arc") - F.col("words")) - F.col("begin"), F.lit(0))
    taken = F.col("size") * F.col("rounds") + head + wrapped
    return both.select("doc_id", "size", "source_size", "target", F.coalesce(taken, F.lit(0)).cast("long").alias("taken"),
                       *(["turn", "shard"] if places else []))


def whole_copies(docs: DataFrame, **how) -> DataFrame:
    """(doc_id, copies) of the documents that ``mixture`` takes at least once, as whole copies.

    Only a document where a shard's arc begins or ends is taken in part. Of a shard's few such documents, those are taken once more,
    larger ones first, that bring the words nearer to the shard's quota; so a shard misses its quota by half of its largest cut
    document at most, where rounding each alone could miss it by both halves. Rows that share a doc_id get the same copies.
    """
    mixed = mixture(docs, places=True, **how).groupBy("doc_id").agg(
        F.sum("taken").alias("taken"), F.sum("size").alias("size"), F.min("turn").alias("turn"), F.min("shard").alias("shard")).filter("size > 0")
    mixed = mixed.withColumn("whole", F.expr("taken div size")).withColumn("part", F.col("taken") % F.col("size"))
    cut = mixed.filter("part > 0").groupBy("turn", "shard").agg(
        F.sum("part").alias("want"), F.sort_array(F.collect_list(F.struct("size", "doc_id", "whole")), asc=False).alias("cuts"))

    def nearer(state, cut):
        more = state.have + cut["size"]
        take = F.abs(more - F.col("want")) < F.abs(state.have - F.col("want"))
        return F.struct(F.when(take, more).otherwise(state.have).alias("have"), F.array_append(state.rows, F.struct(
            cut["doc_id"].alias("doc_id"), (cut["whole"] + take.cast("int")).alias("copies"))).alias("rows"))

    zero = F.struct(F.lit(0).cast("long").alias("have"), F.array().cast("array<struct<doc_id:bigint,copies:bigint>>").alias("rows"))
    rounded = cut.select(F.inline(F.aggregate("cuts", zero, nearer, lambda state: state.rows)))
    even = mixed.filter("part = 0").select("doc_id", F.col("whole").alias("copies"))
    return even.unionByName(rounded).filter("copies > 0").withColumn("copies", F.col("copies").cast("int"))
