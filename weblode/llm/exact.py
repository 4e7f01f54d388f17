"""Exact dedup by progressive refinement: length, then prefix hash, then full hash. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weblode.sources.stages import written

#: Normalised characters that the prefix hash covers, and bits of the survivors' filter (128 KiB, whatever the input).
PREFIX = 64
FILTER_BITS = 20


def normalised(text: Column) -> Column:
    """The text without its white space; null counts as empty."""
    for space in " \n\t\r\x0b\x0c":
        text = F.replace(text, F.lit(space), F.lit(""))
    return F.coalesce(text, F.lit(""))


def _survivors(keys: DataFrame) -> Column:
    """Whether a row's (length, prefix hash) may belong to more than one row.

    Lengths of one row go first, then prefix hashes of one row. What is left marks bits of a fixed-size filter, which is the
    only thing that leaves the cluster; a false mark costs one more full hash.
    """
    lengths = keys.groupBy("length").agg(F.count("*").alias("rows")).filter("rows > 1")
    heads = keys.groupBy("length", "head").agg(F.count("*").alias("rows")).filter("rows > 1").join(lengths.select("length"), "length", "left_semi")
    bit = F.pmod(F.xxhash64("length", "head"), F.lit(1 << FILTER_BITS))
    marks = heads.select(bit.alias("bit")).groupBy(F.shiftright("bit", 6).cast("int").alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("mask"))
    words = [0] * (1 << FILTER_BITS - 6)
    for row in marks.collect():
        words[row["word"]] = row["mask"]
    table = F.from_json(F.lit(str(words)), "array<bigint>")
    return F.getbit(F.get(table, F.shiftright(bit, 6).cast("int")), (bit.bitwiseAND(F.lit(63))).cast("int")) == 1


def exact_groups(docs: DataFrame, digests: bool = False) -> DataFrame:
    """``docs(doc_id, text, ...)`` to one row per input row: doc_id, keep_id, group_size, kept, full_hash.

    Texts are equal when identical without white space. Of equal texts the row with the most code points in the original, then
    the smallest doc_id (nulls last), stays; rows alike in that too leave one of them. ``full_hash`` (SHA-256, hex) is computed
    only for rows whose length and prefix hash both occur again; with ``digests`` the others get theirs as well.

    Null texts are empty texts and equal each other. An empty table gives no rows; other columns are ignored. Groups are
    counted map-side first and joined back as one row each, so a group of copies of any size only skews a join, which
    adaptive execution splits.
    """
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    bare = normalised(F.col("text"))
    keyed = text.select(
        "doc_id", F.coalesce(F.length("text"), F.lit(0)).alias("n_chars"), F.octet_length(bare).cast("long").alias("length"),
        F.xxhash64(F.substring(bare, 1, PREFIX)).alias("head"), bare.alias("bare"))
    suspect = _survivors(keyed.select("length", "head"))
    rows = written(keyed.withColumn("suspect", suspect).select(
        "doc_id", "n_chars", "length", "head", "suspect", F.monotonically_increasing_id().alias("row"),
        F.when(F.lit(digests) | F.col("suspect"), F.sha2("bare", 256)).alias("full_hash")), "exact-rows")
    best = F.struct((-F.col("n_chars")).alias("fewer"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")
    groups = rows.filter("suspect").groupBy("length", "head", "full_hash").agg(
        F.min(best).alias("best"), F.count("*").alias("group_size")).filter("group_size > 1")
    found = rows.join(groups, ["length", "head", "full_hash"], "left")
    return found.select(
        "doc_id", F.when(F.col("best").isNull(), F.col("doc_id")).otherwise(F.col("best.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (F.col("best").isNull() | (F.col("best.row") == F.col("row"))).alias("kept"), "full_hash")


def exact_dedup(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, whole and with all their columns, for a table whose doc_id is a key."""
    gone = exact_groups(docs).filter("not kept").select(F.col("doc_id").alias("_gone"))
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")
