"""Near duplicates by SuperMinHash: signatures, banding, verification on whole sets, union-find grouping."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weblode.llm.blocks import blocks, mix, shingle_sets
from weblode.llm.components import components
from weblode.llm.groups import heavy_keys, joined_by, with_group
from weblode.llm.ship import ship
from weblode.sources.stages import written

#: Slots of a signature and slots of a band. A pair at the threshold of 0.8 shares no band with probability (1 - 0.8**4)**32, 5e-8.
SLOTS = 128
BAND = 4
#: Bits of a slot's print, and the fewest equal prints a pair needs. A pair at 0.8 has 104 of 128 on average, standard deviation 4.4
#: at most: one in 1e10 has fewer than 76.
PRINT_BITS = 4
PRINTS = 76
#: Counters of the frequency sketch that orders shingles (4 bytes each; any order common to all documents gives right results).
SKETCH_BITS = 20
#: Bits of the largest filter of ids that is broadcast (16 MiB). More ids than a quarter of it are joined instead.
FILTER_BITS = 27
#: Links that one union-find holds at once.
LINKS = 1 << 18
U = np.uint64
_BAND_STEP = mix(np.arange(1, BAND + 1, dtype=np.uint64) * U(0x9E3779B97F4A7C15)) | U(1)
_LEVEL = mix((np.arange(1, SLOTS + 1, dtype=np.uint64)) * U(0xD1342543DE82EF95))


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """SuperMinHash signatures (rows of ``SLOTS`` numbers) of sets of 64-bit hashes; an empty set has the largest number everywhere.

    Every element draws a random permutation of the slots, step by step, and puts ``step + r`` into the slot of each step; a slot
    keeps its least value. All elements of all sets take a step together. A value of a later step is larger than any of an
    earlier one, so a set stops as soon as each of its slots has a value: after one step for a long text, about
    ``SLOTS * log(SLOTS)`` draws for a short one. Ranks of one element are correlated, which lowers the variance.
    """
    out = np.full((len(sets), SLOTS), np.iinfo(np.uint64).max, np.uint64)
    sizes = np.array([len(s) for s in sets], np.int64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    elements = np.concatenate([*sets, np.empty(0, np.uint64)])
    flat, order = out.reshape(-1), None
    for step in range(SLOTS):
        if step:
            open_ = (out == np.iinfo(np.uint64).max).any(1)[owner]
            if not open_.any():
                break
            if order is None:
                order = _first_swaps(pick[open_])
            elif not open_.all():
                order = order[open_]
            owner, elements = owner[open_], elements[open_]
        drawn = mix(elements ^ _LEVEL[step])
        pick = (U(step) + ((drawn & U(0xFFFFFF)) * U(SLOTS - step) >> U(24))).astype(np.int64)
        if step:
            at = np.arange(len(pick))
            slot = order[at, pick]
            order[at, pick] = order[:, step]
        else:
            slot = pick
        np.minimum.at(flat, owner * SLOTS + slot, U(step) << U(40) | drawn >> U(24))
    return out


def _first_swaps(pick: np.ndarray) -> np.ndarray:
    """The permutations after their first step, for the elements that need another."""
    order = np.tile(np.arange(SLOTS, dtype=np.uint8), (len(pick), 1))
    order[np.arange(len(pick)), pick] = 0
    return order


def _scan(k: int):
    """Per document: its shingles and the 128-bit fingerprint of its set. Per task: a frequency sketch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(1 << SKETCH_BITS, np.int64)
        for batch, data, offsets in blocks(batches):
            sets = list(shingle_sets(data, offsets, k))
            sketch += np.bincount((np.concatenate(sets) >> U(64 - SKETCH_BITS)).astype(np.int64), minlength=len(sketch))
            prints = np.frombuffer(b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in sets), np.int64).reshape(-1, 2)
            none = [None] * len(sets)
            yield _found(batch.column("doc_id").cast(pa.int64()), [len(s) for s in sets], prints[:, 0], prints[:, 1], none, none)
        parts = [(i, p.tobytes()) for i in range(0, len(sketch), _PART) if (p := np.minimum(sketch[i:i + _PART], 2**32 - 1).astype(np.uint32)).any()]
        none = [None] * len(parts)
        yield _found(none, none, none, none, [i for i, _ in parts], [p for _, p in parts])
    return run


_PART = 1 << 12
_FOUND = "doc_id long, n int, f1 long, f2 long, part int, counts binary"


def _found(*columns) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
    return pa.record_batch([c if isinstance(c, pa.Array) else pa.array(c, k) for c, k in zip(columns, kinds)],
                           names=["doc_id", "n", "f1", "f2", "part", "counts"])


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the sketch, part by part."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            total[part] = total.get(part, 0) + np.frombuffer(counts, np.uint32).astype(np.int64)
    yield pa.record_batch([pa.array(list(total), pa.int32()), pa.array([np.minimum(v, 2**32 - 1).astype(np.uint32).tobytes() for v in total.values()], pa.binary())],
                          names=["part", "counts"])


def _sketch(found: DataFrame) -> np.ndarray:
    """How often the shingles of each hash range occur, over all documents: 4 MiB at any input size."""
    parts = found.filter("part is not null").select("part", "counts").repartition("part")
    out = np.zeros(1 << SKETCH_BITS, np.uint32)
    for row in parts.mapInArrow(_added, "part int, counts binary").collect():
        out[row["part"]:row["part"] + _PART] = np.frombuffer(row["counts"], np.uint32)
    return out


def _places(ids: np.ndarray, bits: int) -> np.ndarray:
    return (mix(ids.view(np.uint64) + U(0x9E3779B97F4A7C15)) >> U(64 - bits)).astype(np.int64)


def _chosen(texts: DataFrame, ids: DataFrame) -> tuple[DataFrame, object, int]:
    """The texts that may belong to ``ids``: by a broadcast filter of at least four bits an id, or by a join where that is too large."""
    ids = written(ids.distinct(), "superminhash-ids")
    bits = max(16, (4 * ids.count()).bit_length())
    if bits > FILTER_BITS:
        return texts.join(ids, "doc_id", "left_semi"), None, 0

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = np.zeros(1 << bits - 3, np.uint8)
        for batch in batches:
            at = _places(batch.column(0).to_numpy(zero_copy_only=False), bits)
            np.bitwise_or.at(flags, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))
        full = np.flatnonzero(flags)
        yield pa.record_batch([pa.array(full.astype(np.int32)), pa.array(flags[full].astype(np.int32))], names=["at", "mask"])

    flags = np.zeros(1 << bits - 3, np.uint8)
    for batch in ids.mapInArrow(mark, "at int, mask int").groupBy("at").agg(F.bit_or("mask").alias("mask")).toArrow().to_batches():
        flags[batch.column(0).to_numpy()] = batch.column(1).to_numpy()
    return texts, ids.sparkSession.sparkContext.broadcast(flags), bits


def _passing(batches: Iterator[pa.RecordBatch], flags, bits: int) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """Ids, bytes and offsets of the texts that the filter lets through."""
    for batch, data, offsets in blocks(batches):
        known = batch.column("doc_id").is_valid().to_numpy(zero_copy_only=False)
        ids = batch.column("doc_id").fill_null(0).to_numpy(zero_copy_only=False)
        if flags is not None:
            at = _places(ids, bits)
            known &= flags.value[at >> 3] >> (at & 7).astype(np.uint8) & 1 == 1
        if known.any():
            sizes = np.diff(offsets)
            yield ids[known].tolist(), data[np.repeat(known, sizes)], np.concatenate([[0], np.cumsum(sizes[known])])


def _prefixes(k: int, percent: int, counts, flags, bits: int):
    """The rarest shingles of each chosen document, enough that two documents that link share one: (shingle, doc_id, n, pos, short).

    The order is by estimated frequency, then hash. ``short`` marks the fewer that are enough where the document is the smaller one.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, data, offsets in _passing(batches, flags, bits):
            out: list[tuple] = []
            for doc_id, s in zip(ids, shingle_sets(data, offsets, k)):
                n = len(s)
                if not n:
                    continue
                most = n - -(-n * percent // 100) + 1
                order = np.lexsort((s, counts.value[s >> U(64 - SKETCH_BITS)]))[:most]
                out.append((s[order], doc_id, n, n - -(-2 * percent * n // (100 + percent)) + 1))
            sizes = [len(o[0]) for o in out]
            pos = np.concatenate([np.arange(x, dtype=np.int32) for x in sizes]) if out else np.empty(0, np.int32)
            each = lambda i, kind: np.repeat(np.array([o[i] for o in out], kind), sizes)
            yield pa.record_batch(
                [pa.array(np.concatenate([o[0] for o in out]).view(np.int64) if out else np.empty(0, np.int64)), pa.array(each(1, np.int64)),
                 pa.array(each(2, np.int32)), pa.array(pos), pa.array(pos < each(3, np.int32))], names=["shingle", "doc_id", "n", "pos", "short"])
    return run


def _signed(k: int, flags, bits: int):
    """(doc_id, n, bands, prints) of the chosen documents: a hash of every band of its signature, and the lowest bits of every slot."""
    each = 64 // PRINT_BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, data, offsets in _passing(batches, flags, bits):
            sets = list(shingle_sets(data, offsets, k))
            some = np.array([len(s) > 0 for s in sets])
            if not some.any():
                continue
            slots = mix(signatures([s for s in sets if len(s)])) >> U(32)
            banded = slots.reshape(-1, SLOTS // BAND, BAND)
            bands = mix((banded * _BAND_STEP).sum(2, dtype=np.uint64) + np.arange(SLOTS // BAND, dtype=np.uint64))
            low = (slots & U((1 << PRINT_BITS) - 1)).reshape(-1, SLOTS // each, each)
            packed = np.bitwise_or.reduce(low << (np.arange(each, dtype=np.uint64) * U(PRINT_BITS)), 2)
            lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.view(np.int64).ravel())) for x in (bands, packed)]
            yield pa.record_batch([pa.array(np.array(ids, np.int64)[some]), pa.array(np.array([len(s) for s in sets], np.int32)[some]), *lists],
                                  names=["doc_id", "n", "bands", "prints"])
    return run


def _equal_prints(x: str, y: str) -> Column:
    """How many slots of two documents have equal prints."""
    total = F.lit(0)
    ones = F.lit(int("1" * (64 // PRINT_BITS), 1 << PRINT_BITS))
    for i in range(SLOTS * PRINT_BITS // 64):
        differ = F.get(x, F.lit(i)).bitwiseXOR(F.get(y, F.lit(i)))
        any_bit = differ
        for shift in range(1, PRINT_BITS):
            any_bit = any_bit.bitwiseOR(F.shiftrightunsigned(differ, shift))
        total = total + 64 // PRINT_BITS - F.bit_count(any_bit.bitwiseAND(ones)).cast("int")
    return total


def _members(k: int, flags, bits: int, name: str):
    """(doc_id, shingles) of the chosen documents under the names of a pair's side."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, data, offsets in _passing(batches, flags, bits):
            sets = pa.array([s.tobytes() for s in shingle_sets(data, offsets, k)], pa.binary())
            yield pa.record_batch([pa.array(ids, pa.int64()), sets], names=[name, f"set_{name}"])
    return run


def _confirm(percent: int):
    """Pairs whose whole sets link."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column("set_a"), batch.column("set_b"))):  # one pair's sets at a time
                both = np.concatenate([np.frombuffer(s.as_buffer(), np.uint64) for s in (x, y)])
                both.sort()
                good[i] = (100 + percent) * np.count_nonzero(both[1:] == both[:-1]) >= percent * len(both)
            yield batch.select(["a", "b"]).filter(pa.array(good))
    return run


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over each run of links: one link from every node to the smallest node of its tree, and none more."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = root[up]
            x = root[up]
        return x

    def trees() -> pa.RecordBatch:
        pairs = [(find(x), x) for x in list(root)]
        pairs = [p for p in pairs if p[0] != p[1]]
        return pa.record_batch([pa.array([p[i] for p in pairs], pa.int64()) for i in (0, 1)], names=["a", "b"])

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
        if len(root) > LINKS:
            yield trees()
            root = {}
    yield trees()


def _grouped(links: DataFrame) -> DataFrame:
    """``(node, label)``: union-find thins the links of each task to trees, which are then joined across tasks."""
    return components(links.select("a", "b").mapInArrow(_forest, "a long, b long"))


def _linked(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs that link. Whole sets are made for the documents of the pairs only, each side's in a scan of its own, and are not stored;
    the second sides move first, then the first sides, of which there are few, come to them."""
    def sets(name: str) -> DataFrame:
        some, flags, bits = _chosen(texts, pairs.select(F.col(name).alias("doc_id")))
        return some.mapInArrow(_members(k, flags, bits, name), f"{name} long, set_{name} binary")

    full = joined_by(pairs.join(sets("b"), "b"), sets("a"), "a", "b", heavy_keys(pairs, "a"))
    return full.select("a", "b", "set_a", "set_b").mapInArrow(_confirm(percent), "a long, b long")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """``docs(doc_id, text, ...)`` to one row per document: doc_id, n_shingles, class_id, component_id, kept.

    Texts are lower-cased (A-Z) and cut into words; a document's set is its distinct ``k``-word shingles, the whole sequence
    where it has fewer words. Two documents link when 100 * intersection >= percent * union, which is confirmed on whole sets;
    ``component_id`` is the smallest doc_id reachable by links, ``class_id`` the smallest with the very same set, ``kept`` marks the
    document its component is named after.

    1. Documents with sets of equal fingerprints are one class; one of each goes on and gets a SuperMinHash signature.
    2. Bands of four slots are buckets. Every document meets the likeliest of its buckets' smallest ones; pairs that link are grouped.
    3. Documents of buckets that still hold different groups meet across groups where they share a bucket, one of their rarest
       shingles (as any two that link do, by counting), and signature prints enough. So no link between groups is lost, pairs inside
       a group are never made, and near copies of one text that do not link to each other do not all meet.
    4. Links are grouped by union-find in each task and then by label over tasks.

    A link is missed only if its two signatures share no band or too few prints (see ``SLOTS`` and ``PRINTS``); ``percent`` below 80
    needs wider bands. Classes and buckets of many documents are met by broadcast of their one row (at most a thousand such).

    Null or word-less texts have n_shingles 0 and are their own component. Rows that share a doc_id are one document: each row
    is returned, all in one component. Rows with a null doc_id are returned with null ids and ``kept`` false. An empty table gives
    no rows; other columns are ignored. Shingles are compared by 64-bit hash, sets by 128-bit fingerprint.
    """
    if percent < 80:
        raise ValueError("percent must be 80 or more; bands and prints are set for it")
    spark = docs.sparkSession
    ship(spark)
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = written(text.mapInArrow(_scan(k), _FOUND), "superminhash-found")
    full = found.filter("n > 0 and doc_id is not null")
    keys = ["f1", "f2", "n"]
    classes = written(full.groupBy(*keys).agg(F.min("doc_id").alias("class_id"), F.count("*").alias("copies")), "superminhash-classes")
    copies = written(
        with_group(full.select("doc_id", *keys), classes.filter("copies > 1"), keys, "copies").filter("doc_id <> class_id").select("doc_id", "class_id").distinct(),
        "superminhash-copies")
    class_of = copies.groupBy("doc_id").agg(F.min("class_id").alias("class_id"))
    # a copy that the filter lets through as well only meets its own class once more
    some, flags, bits = _chosen(text, classes.select(F.col("class_id").alias("doc_id")))
    single = written(some.mapInArrow(_signed(k, flags, bits), "doc_id long, n int, bands array<long>, prints array<long>"), "superminhash-signed")

    posted = single.select("doc_id", F.explode("bands").alias("bucket"))
    hubs = written(posted.groupBy("bucket").agg(
        F.min("doc_id").alias("hub"), F.max("doc_id").alias("last"), F.count("*").alias("size")).filter("hub <> last"), "superminhash-buckets")
    posted = written(with_group(posted, hubs.select("bucket", "hub", "size"), ["bucket"], "size").select("bucket", "doc_id", "hub"), "superminhash-posted")
    pairs = written(posted.filter("hub <> doc_id").select(F.col("hub").alias("a"), F.col("doc_id").alias("b")).distinct(), "superminhash-pairs")
    prints = single.select("doc_id", "n", "prints")
    side = lambda name: prints.select(F.col("doc_id").alias(name), F.col("n").alias(f"n_{name}"), F.col("prints").alias(f"p_{name}"))
    fits = f"100L * least(n_a, n_b) >= {percent}L * greatest(n_a, n_b)"
    first = joined_by(pairs.join(side("b"), "b"), side("a"), "a", "b").filter(fits).withColumn("equal", _equal_prints("p_a", "p_b")).filter(F.col("equal") >= PRINTS)
    # the likeliest of a document's hubs; whatever another would add is met in the next step
    first = written(first.groupBy("b").agg(F.min(F.struct((-F.col("equal")).alias("less"), "a")).alias("best")).select("best.a", "b"), "superminhash-likely")
    links = written(_linked(first, text, k, percent), "superminhash-links")
    joined = _grouped(links)

    label_of = joined.withColumnRenamed("node", "doc_id")
    labelled = posted.select("bucket", "doc_id").join(label_of, "doc_id", "left").withColumn("label", F.coalesce("label", "doc_id"))
    split = labelled.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high").select("bucket")
    open_ = written(labelled.join(split, "bucket", "left_semi").select("bucket", "doc_id", "label"), "superminhash-open")
    some, flags, bits = _chosen(text, open_.select("doc_id"))
    rare = written(some.mapInArrow(_prefixes(k, percent, spark.sparkContext.broadcast(_sketch(found)), flags, bits),
                                   "shingle long, doc_id long, n int, pos int, short boolean"), "superminhash-rare")
    shared = written(rare.groupBy("shingle").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count("*").alias("size"))
                     .filter("low <> high").select("shingle", "size"), "superminhash-shared")
    label = open_.select("doc_id", "label").distinct()
    rare = written(with_group(rare, shared, ["shingle"], "size").drop("size").join(label, "doc_id"), "superminhash-rare")
    need = f"ceil({percent} * (cast(x.n as long) + y.n) / {100 + percent})"
    met = rare.alias("x").join(rare.alias("y"), F.expr(
        "x.shingle = y.shingle and x.short and x.label <> y.label and (x.n < y.n or x.n = y.n and y.short and x.doc_id < y.doc_id)"
        f" and 100L * x.n >= {percent}L * y.n and least(x.n - x.pos, y.n - y.pos) >= {need}"))
    met = written(met.select(F.least("x.doc_id", "y.doc_id").alias("a"), F.greatest("x.doc_id", "y.doc_id").alias("b")).distinct()
                  .join(first, ["a", "b"], "left_anti"), "superminhash-met")
    both = joined_by(met.join(side("b"), "b"), side("a"), "a", "b").filter(_equal_prints("p_a", "p_b") >= PRINTS).select("a", "b").distinct()
    bands = open_.groupBy("doc_id").agg(F.collect_set("bucket").alias("buckets"))
    near = (both.join(bands.select(F.col("doc_id").alias("a"), F.col("buckets").alias("in_a")), "a")
            .join(bands.select(F.col("doc_id").alias("b"), F.col("buckets").alias("in_b")), "b").filter(F.arrays_overlap("in_a", "in_b")))
    more = written(_linked(written(near.select("a", "b"), "superminhash-likely"), text, k, percent), "superminhash-links")
    labels = _grouped(links.union(more).union(copies.select(F.col("class_id").alias("a"), F.col("doc_id").alias("b"))))
    rows = found.filter("part is null").select("doc_id", "n")
    named = (rows.filter("doc_id is not null").join(class_of, "doc_id", "left").join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left")
             .unionByName(rows.filter("doc_id is null"), allowMissingColumns=True))
    component = F.coalesce("label", "doc_id")
    return named.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("class_id", "doc_id").alias("class_id"),
                        component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(False)).alias("kept"))
