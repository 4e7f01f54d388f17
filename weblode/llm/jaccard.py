"""N-gram Jaccard join: rare-first prefix filtering with length, positional and suffix filters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weblode.llm.blocks import blocks, mix, shingle_sets
from weblode.llm.components import components
from weblode.llm.ship import ship
from weblode.sources.stages import written

#: Fixed sizes, whatever the input: counters of the frequency sketch (4 bytes each), bits of the candidate filter, and the
#: estimated documents of a shingle from which its posting list is dealt to several tasks.
SKETCH_BITS = 20
FILTER_BITS = 23
LIST_ROWS = 4096
_CHUNK = 4096
_PIVOTS = (np.arange(1, 32, dtype=np.uint64) << np.uint64(59))

_SETS = "doc_id long, n int, f1 long, f2 long, ranges array<int>, chunk int, counts binary"


def _scan_sets(k: int):
    """Per document: shingle count, 128-bit fingerprint and counts by hash range of its set. Per task: the counters of the sketch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(1 << SKETCH_BITS, np.int64)
        for batch, data, offsets in blocks(batches):
            sets = list(shingle_sets(data, offsets, k))
            every = np.concatenate(sets)
            sketch += np.bincount((every >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=len(sketch))
            prints = np.frombuffer(b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in sets), np.int64).reshape(-1, 2)
            size = len(sets)
            ranges = np.concatenate([np.diff(np.concatenate([[0], np.searchsorted(s, _PIVOTS), [len(s)]])) for s in sets])
            width = len(_PIVOTS) + 1
            yield pa.record_batch(
                [batch.column("doc_id").cast(pa.int64()), pa.array([len(s) for s in sets], pa.int32()), pa.array(prints[:, 0]),
                 pa.array(prints[:, 1]), pa.ListArray.from_arrays(
                     pa.array(np.arange(size + 1, dtype=np.int32) * width), pa.array(ranges.astype(np.int32))),
                 pa.nulls(size, pa.int32()), pa.nulls(size, pa.binary())],
                names=["doc_id", "n", "f1", "f2", "ranges", "chunk", "counts"])
        parts = [(i // _CHUNK, np.minimum(p, 2**32 - 1).astype(np.uint32).tobytes())
                 for i in range(0, len(sketch), _CHUNK) if (p := sketch[i:i + _CHUNK]).any()]
        size = len(parts)
        yield pa.record_batch(
            [pa.nulls(size, pa.int64()), pa.nulls(size, pa.int32()), pa.nulls(size, pa.int64()), pa.nulls(size, pa.int64()),
             pa.nulls(size, pa.list_(pa.int32())), pa.array([c for c, _ in parts], pa.int32()), pa.array([p for _, p in parts], pa.binary())],
            names=["doc_id", "n", "f1", "f2", "ranges", "chunk", "counts"])
    return run


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the counters, chunk by chunk; holds one array for each of the fixed number of chunks."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for chunk, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            got = np.frombuffer(counts, np.uint32).astype(np.int64)
            total[chunk] = total[chunk] + got if chunk in total else got
    yield pa.record_batch(
        [pa.array(list(total), pa.int32()), pa.array([np.minimum(v, 2**32 - 1).astype(np.uint32).tobytes() for v in total.values()], pa.binary())],
        names=["chunk", "counts"])


def _frequencies(found: DataFrame) -> np.ndarray:
    """The sketch of all documents: ``2**SKETCH_BITS`` counters, 4 MiB at any input size."""
    parts = found.filter("chunk is not null").select("chunk", "counts").repartition("chunk").mapInArrow(_add_up, "chunk int, counts binary")
    out = np.zeros(1 << SKETCH_BITS, np.uint32)
    for row in parts.collect():
        out[row.chunk * _CHUNK:(row.chunk + 1) * _CHUNK] = np.frombuffer(row.counts, np.uint32)
    return out


def _postings(k: int, percent: int, sketch):
    """The prefix of every document in rare-first order: (shingle, doc_id, n, pos, short, salt).

    ``short`` marks the shorter prefix that is enough where the document is the smaller one of a pair. Copies within a task
    are written once. The order is by estimated frequency, then hash, the same for all documents.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, seen = sketch.value, set()
        usual = 2 * int(counts.sum(dtype=np.int64)) // len(counts)
        for batch, data, offsets in blocks(batches):
            rows: list[tuple] = []
            for doc_id, s in zip(batch.column("doc_id").to_pylist(), shingle_sets(data, offsets, k)):
                n = len(s)
                if not n or doc_id is None or (mark := xxhash.xxh3_128_digest(s.tobytes())) in seen:
                    continue
                seen.add(mark)
                probe = n - -(-n * percent // 100) + 1
                index = n - -(-2 * percent * n // (100 + percent)) + 1
                often = counts[s >> np.uint64(64 - SKETCH_BITS)]
                if probe < n // 2:
                    near = np.argpartition(often, probe)[:probe]
                    near = np.flatnonzero(often <= often[near].max())
                else:
                    near = np.arange(n)
                order = near[np.lexsort((s[near], often[near]))][:probe]
                rows.append((doc_id, n, index, s[order], often[order]))
            if not rows:
                continue
            sizes = [len(r[3]) for r in rows]
            docs = np.repeat(np.array([r[0] for r in rows], np.int64), sizes)
            pos = np.concatenate([np.arange(x, dtype=np.int32) for x in sizes])
            often = np.concatenate([r[4] for r in rows]).astype(np.int64)
            dealt = (1 + np.maximum(often - usual, 0) // LIST_ROWS).astype(np.uint64)
            yield pa.record_batch(
                [pa.array(np.concatenate([r[3] for r in rows]).view(np.int64)), pa.array(docs),
                 pa.array(np.repeat(np.array([r[1] for r in rows], np.int32), sizes)), pa.array(pos),
                 pa.array(pos < np.repeat(np.array([r[2] for r in rows], np.int32), sizes)),
                 pa.array((mix(docs.view(np.uint64)) % dealt).astype(np.int32)), pa.array(dealt > 1)],
                names=["shingle", "doc_id", "n", "pos", "short", "salt", "dealt"])
    return run


def _sets_of(k: int, wanted):
    """The shingle sets of documents that the filter of candidate ids lets through."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = wanted.value
        for batch, data, offsets in blocks(batches):
            ids = batch.column("doc_id").cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False)
            at = _bit(ids)
            hit = (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
            hit &= batch.column("doc_id").is_valid().to_numpy(zero_copy_only=False)
            if not hit.any():
                continue
            lengths = np.diff(offsets)
            keep = np.repeat(hit, lengths)
            few = np.concatenate([[0], np.cumsum(lengths[hit])])
            sets = [s.tobytes() for s in shingle_sets(data[keep], few, k)]
            yield pa.record_batch([pa.array(ids[hit]), pa.array(sets, pa.binary())], names=["doc_id", "shingles"])
    return run


def _bit(ids: np.ndarray) -> np.ndarray:
    return (mix(ids.astype(np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


def _filter_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(byte, mask) rows of the candidate filter, one per byte that a task sets."""
    bits = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
    for batch in batches:
        at = _bit(batch.column(0).to_numpy(zero_copy_only=False))
        np.bitwise_or.at(bits, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))
    full = np.flatnonzero(bits)
    yield pa.record_batch([pa.array(full.astype(np.int32)), pa.array(bits[full].astype(np.int32))], names=["at", "mask"])


def _wanted(ids: DataFrame) -> np.ndarray:
    """A filter of ``2**FILTER_BITS`` bits (1 MiB) over the ids; a false hit costs a set that no pair asks for."""
    out = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
    rows = ids.mapInArrow(_filter_bytes, "at int, mask int").groupBy("at").agg(F.bit_or("mask").alias("mask"))
    for batch in rows.toArrow().to_batches():
        out[batch.column(0).to_numpy()] = batch.column(1).to_numpy()
    return out


def _verify(percent: int):
    """Pairs that link, by the exact intersection."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for x, y, sx, sy in zip(*(batch.column(c) for c in ("a", "b", "set_a", "set_b"))):  # one pair's sets at a time
                merged = np.concatenate([np.frombuffer(s.as_buffer(), np.uint64) for s in (sx, sy)])
                merged.sort()
                if (100 + percent) * np.count_nonzero(merged[1:] == merged[:-1]) >= percent * len(merged):
                    a.append(x.as_py())
                    b.append(y.as_py())
            yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
    return run


def _judged(pairs: DataFrame, ranges: DataFrame, percent: int) -> DataFrame:
    """Adds ``likely``: the suffix filter. Sets cannot share more in a hash range than the smaller one has there."""
    def side(name: str) -> DataFrame:
        return ranges.select(F.col("doc_id").alias(name), F.col("ranges").alias(f"ranges_{name}"), F.col("n").alias(f"n_{name}"))

    shared = F.aggregate(F.zip_with("ranges_a", "ranges_b", lambda x, y: F.least(x, y)), F.lit(0), lambda s, x: s + x)
    likely = (100 + percent) * shared.cast("long") >= percent * (F.col("n_a").cast("long") + F.col("n_b"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", likely.alias("likely"))


def _linked(pairs: DataFrame, text: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs that link. Shingle sets are made, in one more scan, for the documents of the pairs only."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id"))
    wanted = text.sparkSession.sparkContext.broadcast(_wanted(ids))
    sets = written(text.mapInArrow(_sets_of(k, wanted), "doc_id long, shingles binary"), "jaccard-members")
    full = (pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("set_a")), "a")
            .join(sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("set_b")), "b"))
    return full.select("a", "b", "set_a", "set_b").mapInArrow(_verify(percent), "a long, b long")


def jaccard_components(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """``docs(doc_id, text, ...)`` to one row per document: doc_id, n_shingles, class_id, component_id.

    Texts are lower-cased (A-Z) and cut into words; a document's set is its distinct ``k``-word shingles, the whole sequence
    where it has fewer words. Two documents link when 100 * intersection >= percent * union; ``component_id`` is the smallest
    doc_id reachable by links, ``class_id`` the smallest doc_id with the very same set.

    1. Documents with equal sets (128-bit fingerprint) form classes; one representative of each goes on.
    2. Every set is ordered rare-first by a fixed-size frequency sketch over all documents; its prefix is posted.
    3. Posting lists of one document go. In each other list every document meets the most central one (the least rare
       shingles before the list's): such pairs grow with the list, and merge groups of near copies.
    4. Documents of one list that are still in different components are paired under the length and positional filters,
       so no link between components is lost, and pairs inside a found component are never made.
    5. Pairs are made distinct, pass a suffix filter over hash ranges, and are verified once, on whole sets.

    Null or word-less texts have n_shingles 0 and are their own component. Rows that share a doc_id are one document: each row
    is returned, all in one component. Rows with a null doc_id are returned with null component. An empty table gives no rows;
    other columns are ignored. Shingles are compared by 64-bit hash, sets by 128-bit fingerprint.
    """
    spark = docs.sparkSession
    ship(spark)
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = written(text.mapInArrow(_scan_sets(k), _SETS), "jaccard-sets")
    rows = found.filter("chunk is null").select("doc_id", "n", "f1", "f2")
    full = rows.filter("n > 0 and doc_id is not null")
    classes = full.groupBy("f1", "f2", "n").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("copies"))
    copies = written(
        full.join(classes.filter("copies > 1"), ["f1", "f2", "n"]).filter("doc_id <> class_id").select("doc_id", "class_id").distinct(),
        "jaccard-copies")
    class_of = copies.groupBy("doc_id").agg(F.min("class_id").alias("class_id"))

    sketch = spark.sparkContext.broadcast(_frequencies(found))
    posted = text.mapInArrow(
        _postings(k, percent, sketch), "shingle long, doc_id long, n int, pos int, short boolean, salt int, dealt boolean")
    lists = (posted.withColumn("many", F.count("*").over(Window.partitionBy("shingle", "salt")) > 1).filter("many or dealt")
             .join(class_of, "doc_id", "left").withColumn("doc_id", F.coalesce("class_id", "doc_id"))
             .select("shingle", "doc_id", "n", "pos", "short").distinct())
    lists = written(lists, "jaccard-lists")

    need = f"ceil({percent} * (cast(x.n as long) + y.n) / {100 + percent})"
    possible = (f"100L * least(x.n, y.n) >= {percent}L * greatest(x.n, y.n)"
                f" and least(x.n - x.pos, y.n - y.pos) >= {need}")
    ranges = found.filter("n > 0 and doc_id is not null").select("doc_id", "n", "ranges")
    hubs = lists.groupBy("shingle").agg(F.min(F.struct("pos", "n", "doc_id")).alias("hub"), F.count("*").alias("size")).filter("size > 1")
    hubs = hubs.select("shingle", "hub.*")
    first = written(_judged(
        hubs.alias("x").join(lists.alias("y"), F.expr(f"x.shingle = y.shingle and x.doc_id <> y.doc_id and {possible}"))
        .select(F.least("x.doc_id", "y.doc_id").alias("a"), F.greatest("x.doc_id", "y.doc_id").alias("b")).distinct(), ranges, percent), "jaccard-first")
    links = written(_linked(first.filter("likely").select("a", "b").distinct(), text, k, percent), "jaccard-links")
    joined = components(links)

    labelled = (lists.join(joined.withColumnRenamed("node", "doc_id"), "doc_id", "left")
                .withColumn("label", F.coalesce("label", "doc_id")))
    split = labelled.groupBy("shingle").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high").select("shingle")
    labelled = written(labelled.join(split, "shingle", "left_semi"), "jaccard-split")
    rest = (labelled.alias("x").join(labelled.alias("y"), F.expr(
        "x.shingle = y.shingle and x.short and x.label <> y.label and (x.n < y.n or x.n = y.n and y.short and x.doc_id < y.doc_id)"
        f" and {possible}"))
        .select(F.least("x.doc_id", "y.doc_id").alias("a"), F.greatest("x.doc_id", "y.doc_id").alias("b")).distinct()
        .join(first, ["a", "b"], "left_anti"))
    rest = written(_judged(rest, ranges, percent).filter("likely").select("a", "b").distinct(), "jaccard-rest")
    more = written(_linked(rest, text, k, percent), "jaccard-links")
    labels = components(links.union(more).union(copies.select(F.col("class_id").alias("a"), F.col("doc_id").alias("b"))))
    return (rows.join(class_of, "doc_id", "left").join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left")
            .select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("class_id", "doc_id").alias("class_id"),
                    F.coalesce("label", "doc_id").alias("component_id")))
