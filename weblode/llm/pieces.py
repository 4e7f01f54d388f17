"""SentencePiece encoding and decoding: a relational lattice over words, folded by a higher-order aggregate."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from sentencepiece import sentencepiece_model_pb2 as model_pb2

from weblode.llm.blocks import _powers, mix
from weblode.llm.ship import ship
from weblode.sources.stages import written

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Words of the broadcast dictionary, characters of a word that has a lattice (its cuts are bits of a long), characters of a block of
#: text, and words a task remembers of those outside the dictionary.
DICTIONARY = 1 << 18
LONGEST = 60
BLOCK = 1 << 18
REMEMBERED = 1 << 15
#: Words a task counts before it hands them on.
COUNTED = 1 << 17
SPACE = "▁"


class Vocabulary:
    """A byte-fallback BPE model: pieces with ids and ranks (lower merges first), bytes, and the characters that can merge."""

    def __init__(self, path: str = MODEL):
        model = model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        norm = model.normalizer_spec
        if model.trainer_spec.model_type != 2 or not model.trainer_spec.byte_fallback or norm.precompiled_charsmap or norm.remove_extra_whitespaces:
            raise ValueError("a BPE model with byte fallback and without normalisation is needed")
        kinds = [(i, p.piece, p.score, p.type) for i, p in enumerate(model.pieces)]
        self.rank = {piece: -score for _, piece, score, kind in kinds if kind == 1}
        self.id = {piece: i for i, piece, _, kind in kinds if kind == 1}
        self.bytes = [i for _, i in sorted((int(piece[3:5], 16), i) for i, piece, _, kind in kinds if kind == 6)]
        self.prefix = SPACE if norm.add_dummy_prefix else ""
        multi = [p for p in self.id if len(p) > 1]
        if any(SPACE in p.lstrip(SPACE) for p in multi):
            raise ValueError("pieces that reach over a space are not provided for")
        self.longest = max(map(len, multi))
        self.merging = sorted({c for p in multi for c in p} - {SPACE})
        raw = {i: piece.replace(SPACE, " ").encode() for piece, i in self.id.items()} | {i: bytes([b]) for b, i in enumerate(self.bytes)}
        self.raw = [raw.get(i, b"") for i in range(len(kinds))]

    def rows(self, spark: SparkSession) -> DataFrame:
        """(piece, rank, id): as many rows as the model has pieces."""
        return spark.createDataFrame([(p, float(r), self.id[p]) for p, r in self.rank.items()], "piece string, rank double, id int")

    def fold(self, word: str) -> list[int]:
        """The merges of one word, best rank first and leftmost among equals, for words outside the dictionary."""
        parts: list[str | None] = list(word)
        right, left = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        heap = [(self.rank[p], i, p) for i in range(len(parts) - 1) if (p := word[i:i + 2]) in self.rank]
        heapq.heapify(heap)
        while heap:
            _, i, both = heapq.heappop(heap)
            j = right[i]
            if parts[i] is None or j >= len(parts) or len(parts[i]) + len(parts[j]) != len(both) or parts[i] + parts[j] != both:
                continue
            parts[i], parts[j], right[i] = both, None, right[j]
            if right[i] < len(parts):
                left[right[i]] = i
            for a, b in ((left[i], i), (i, right[i])):
                if a >= 0 and b < len(parts) and (p := parts[a] + parts[b]) in self.rank:
                    heapq.heappush(heap, (self.rank[p], a, p))
        return [k for p in parts if p is not None for k in ([self.id[p]] if p in self.id else [self.bytes[b] for b in p.encode()])]


class Cutter:
    """Cuts texts into words that no piece reaches over: spaces with the mergeable characters after them, or one other character."""

    def __init__(self, vocabulary: Vocabulary):
        self.prefix = vocabulary.prefix
        self.kind = np.zeros(0x110000, np.uint8)
        self.kind[[ord(c) for c in vocabulary.merging]] = 1
        self.kind[ord(SPACE)] = 2
        self.draw = mix(np.arange(1, 0x110001, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def hashes(self, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A 64-bit hash of each run of code points."""
        power, inverse = _powers(max(len(codes), BLOCK) + 1)
        sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(self.draw[codes] * power[:len(codes)], out=sums[1:])
        return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))

    def cut(self, texts: list[str | None]) -> Cut:
        joined = "".join([self.prefix + t for t in texts if t]).replace(" ", SPACE)
        offsets = np.cumsum([0] + [len(t) + len(self.prefix) if t else 0 for t in texts])
        codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        kind = self.kind[codes]
        begins = np.ones(len(codes), bool)
        begins[1:] = ~(((kind[:-1] == 2) & (kind[1:] > 0)) | ((kind[:-1] == 1) & (kind[1:] == 1)))
        begins[offsets[offsets < len(codes)]] = True
        starts = np.flatnonzero(begins)
        hashes = self.hashes(codes, starts, np.append(starts[1:], len(codes))[:len(starts)])
        unique, at, back = np.unique(hashes, return_index=True, return_inverse=True)
        ends = np.append(starts[1:], len(codes))[:len(starts)]
        return Cut(joined, codes, unique, starts[at], ends[at] - starts[at], back, np.searchsorted(starts, offsets))


class Cut(NamedTuple):
    """A block of texts as words: the distinct ones by hash, with a place each; which one stands where; where each text begins.

    In a block words are told apart by their 64-bit hash.
    """

    joined: str
    codes: np.ndarray
    hashes: np.ndarray
    starts: np.ndarray
    sizes: np.ndarray
    back: np.ndarray
    first: np.ndarray

    def words(self, which: np.ndarray) -> list[str]:
        return [self.joined[a:a + n] for a, n in zip(self.starts[which].tolist(), self.sizes[which].tolist())]


def _slices(batch: pa.RecordBatch, text: int) -> Iterator[tuple[int, list[str | None]]]:
    """(first row, texts) of runs of rows with about ``BLOCK`` characters."""
    run: list[str | None] = []
    size = start = 0
    for i, value in enumerate(batch.column(text)):
        value = value.as_py()
        run.append(value)
        size += len(value or "")
        if size >= BLOCK:
            yield start, run
            run, size, start = [], 0, i + 1
    if run:
        yield start, run


def _count_words(cutter):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, int] = {}

        def rows() -> pa.RecordBatch:
            out = pa.record_batch([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
            held.clear()
            return out

        for batch in batches:
            for _, texts in _slices(batch, 0):
                cut = cutter.value.cut(texts)
                short = np.flatnonzero(cut.sizes <= LONGEST)
                for word, n in zip(cut.words(short), np.bincount(cut.back, minlength=len(cut.hashes))[short].tolist()):
                    held[word] = held.get(word, 0) + n
                if len(held) > COUNTED:
                    yield rows()
            batch = None  # not beside the next one
        yield rows()
        pa.default_memory_pool().release_unused()
    return run


def frequent_words(docs: DataFrame, vocabulary: Vocabulary, most: int = DICTIONARY) -> DataFrame:
    """At most ``most`` words of all texts, the most frequent ones: words above the smallest count that lets no more in."""
    cutter = docs.sparkSession.sparkContext.broadcast(Cutter(vocabulary))
    counted = written(docs.select(F.col("text").cast("string").alias("text")).mapInArrow(_count_words(cutter), "word string, n long")
                      .groupBy("word").agg(F.sum("n").alias("n")), "piece-words")
    steps = counted.groupBy("n").agg(F.count("*").alias("words")).withColumn(
        "within", F.sum("words").over(Window.orderBy(F.col("n").desc()).rowsBetween(Window.unboundedPreceding, 0)))
    least = steps.filter(F.col("within") <= most).agg(F.min("n")).first()[0]
    return counted.filter(F.col("n") >= (least if least is not None else 1 << 62)).select("word")


def lattice(words: DataFrame, pieces: DataFrame, longest: int, bytes_: list[int]) -> DataFrame:
    """``words(word)`` to (word, ids): the segmentation of each distinct word.

    Substrings of up to ``longest`` characters are exploded and equi-joined to the piece table; what joins is an edge of the word's
    lattice. A word's edges are grouped (they are where the word is, nothing moves) and folded by ``aggregate``: the state is the set
    of cuts as bits, each step takes the best-ranked, leftmost edge that spans exactly two of the present segments and drops the
    cut inside. This is the merge order of a BPE model; summing scores along paths would give other segmentations. A character
    without a piece becomes its UTF-8 bytes.
    """
    bit = lambda at: F.expr(f"shiftleft(1L, {at})")
    spans = words.repartition("word").select("word", F.explode(F.expr("sequence(0, char_length(word) - 1)")).alias("i"))
    spans = spans.select("word", "i", F.explode(F.expr(f"sequence(i + 1, least(i + {longest}, char_length(word)))")).alias("j"))
    spans = spans.withColumn("piece", F.expr("substring(word, i + 1, j - i)"))
    known = spans.join(F.broadcast(pieces), "piece", "left").filter("id is not null or j = i + 1")
    table = F.array(*map(F.lit, bytes_))
    spelled = F.transform(F.expr("sequence(0, octet_length(piece) - 1)"), lambda k: F.get(
        table, F.conv(F.substring(F.hex(F.encode("piece", "UTF-8")), 2 * k + 1, 2), 16, 10).cast("int")))
    edge = F.struct(
        F.when(F.col("j") > F.col("i") + 1, F.col("rank")).alias("rank"), "i", (bit("i").bitwiseOR(bit("j"))).alias("ends"),
        F.expr("(shiftleft(1L, j) - 1) & ~(shiftleft(1L, i + 1) - 1)").alias("inside"),
        F.when(F.col("id").isNotNull(), F.array("id")).otherwise(spelled).alias("ids"))
    grouped = known.groupBy("word").agg(F.array_sort(F.collect_list(edge)).alias("edges"))
    grouped = grouped.withColumn("merges", F.filter("edges", lambda e: e["rank"].isNotNull()))
    cuts = F.expr("""aggregate(sequence(1, char_length(word)), shiftleft(1L, char_length(word) + 1) - 1, (cuts, step) ->
        cuts & ~coalesce(get(filter(merges, e -> (cuts & e.ends) = e.ends and bit_count(cuts & e.inside) = 1), 0).inside, 0L))""")
    chosen = "filter(edges, e -> (cuts & e.ends) = e.ends and (cuts & e.inside) = 0L)"
    ids = F.expr(f"flatten(transform(array_sort(transform({chosen}, e -> struct(e.i, e.ids))), e -> e.ids))")
    return grouped.select("word", "edges", cuts.alias("cuts")).select("word", ids.alias("ids"))


class Encoder:
    """The dictionary as flat arrays in hash order, and the fold for the words it lacks."""

    def __init__(self, vocabulary: Vocabulary, words: list[str], ids: np.ndarray, sizes: np.ndarray):
        self.vocabulary = vocabulary
        self.codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        self.sizes = np.array([len(w) for w in words], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.ids, self.id_sizes = ids.astype(np.int32), sizes.astype(np.int64)
        self.id_starts = np.cumsum(self.id_sizes) - self.id_sizes
        self.hashes = Cutter(vocabulary).hashes(self.codes, self.starts, self.starts + self.sizes)
        order = np.argsort(self.hashes, kind="stable")
        self.hashes, self.sizes, self.starts = self.hashes[order], self.sizes[order], self.starts[order]
        self.id_sizes, self.id_starts = self.id_sizes[order], self.id_starts[order]
        self.cutter = None

    def ready(self) -> Encoder:
        """Makes what is not worth sending."""
        if self.cutter is None:
            self.cutter, self.rare = Cutter(self.vocabulary), {}
            raw = self.vocabulary.raw
            self.raw = np.frombuffer(b"".join(raw), np.uint8)
            self.raw_sizes = np.array([len(r) for r in raw])
            self.raw_starts = np.cumsum(self.raw_sizes) - self.raw_sizes
        return self

    def _fold(self, word: str) -> list[int]:
        got = self.rare.get(word)
        if got is None:
            got = self.vocabulary.fold(word)
            if len(word) <= LONGEST:
                if len(self.rare) >= REMEMBERED:
                    self.rare.clear()
                self.rare[word] = got
        return got

    def _known(self, cut: Cut) -> tuple[np.ndarray, np.ndarray]:
        """Which distinct words of a block are in the dictionary, and where: same hash, same length, same characters."""
        if not len(self.hashes) or not len(cut.hashes):
            return np.zeros(len(cut.hashes), bool), np.zeros(len(cut.hashes), np.int64)
        at = np.minimum(np.searchsorted(self.hashes, cut.hashes), len(self.hashes) - 1)
        hit = (self.hashes[at] == cut.hashes) & (self.sizes[at] == cut.sizes)
        which = np.flatnonzero(hit)
        mine, bounds = _gather(cut.codes, cut.starts, cut.sizes, which)
        theirs, _ = _gather(self.codes, self.starts, self.sizes, at[which])
        other = np.flatnonzero(mine != theirs)
        hit[which[np.searchsorted(bounds, other, "right") - 1]] = False
        return hit, at

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and where each text's ids begin."""
        cut = self.cutter.cut(texts)
        hit, at = self._known(cut)
        which = np.flatnonzero(hit)
        flat, bounds = _gather(self.ids, self.id_starts, self.id_sizes, at[which])
        folded = [self._fold(w) for w in cut.words(np.flatnonzero(~hit))]
        sizes = np.empty(len(hit), np.int64)
        sizes[hit], sizes[~hit] = self.id_sizes[at[which]], [len(f) for f in folded]
        starts = np.empty(len(hit), np.int64)
        starts[hit], starts[~hit] = bounds[:-1], len(flat) + np.cumsum(sizes[~hit]) - sizes[~hit]
        rest = np.fromiter((i for f in folded for i in f), np.int32)
        ids, ends = _gather(np.concatenate([flat, rest]), starts, sizes, cut.back)
        return ids, ends[cut.first]

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
        """The texts of ids that lie end to end: pieces joined, the leading space of a text gone."""
        data, ends = _gather(self.raw, self.raw_starts, self.raw_sizes, ids)
        data, at, skip = data.tobytes(), ends[offsets].tolist(), len(self.vocabulary.prefix)
        return [data[a + (skip if data[a:a + 1] == b" " else 0):b].decode("utf-8", "replace") for a, b in zip(at[:-1], at[1:])]


def _gather(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs ``which`` of ``flat`` end to end, and their bounds."""
    bounds = np.zeros(len(which) + 1, np.int64)
    np.cumsum(sizes[which], out=bounds[1:])
    return flat[np.repeat(starts[which] - bounds[:-1], sizes[which]) + np.arange(bounds[-1])], bounds


def _encoded(shared, keep: int, check: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared.value.ready()
        for batch in batches:
            for start, texts in _slices(batch, keep):
                ids, offsets = encoder.encode(texts)
                sizes = np.diff(offsets)
                missing = np.array([t is None for t in texts])
                lists = pa.ListArray.from_arrays(
                    pa.array(offsets.astype(np.int32)), pa.array(ids)) if not missing.any() else pa.ListArray.from_arrays(
                    pa.array(offsets.astype(np.int32), mask=np.append(missing, False)), pa.array(ids))
                columns = [batch.column(i).slice(start, len(texts)) for i in range(keep)]
                columns += [pa.array(sizes.astype(np.int32), mask=missing), lists]
                names = batch.schema.names[:keep] + ["n_pieces", "pieces"]
                if check:
                    same = [t is None or d == t for d, t in zip(encoder.decode(ids, offsets), texts)]
                    columns.append(pa.array(same, pa.bool_(), mask=missing))
                    names.append("round_trip")
                yield pa.record_batch(columns, names=names)
                columns = lists = None
            batch = None  # not beside the next one
    return run


def encoder_for(docs: DataFrame, model: str = MODEL, dictionary: int = DICTIONARY) -> Encoder:
    """Counts the words of all texts, folds the lattices of the frequent ones, and takes the finished dictionary (bounded) along."""
    ship(docs.sparkSession)
    vocabulary = Vocabulary(model)
    words = frequent_words(docs, vocabulary, dictionary)
    folded = lattice(words, vocabulary.rows(docs.sparkSession), vocabulary.longest, vocabulary.bytes).toArrow()
    lists = folded.column("ids").combine_chunks() if folded.num_rows else pa.array([], pa.list_(pa.int32()))
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    sizes = np.diff(lists.offsets.to_numpy()) if len(lists) else np.empty(0, np.int64)
    return Encoder(vocabulary, folded.column("word").to_pylist(), lists.flatten().to_numpy(zero_copy_only=False), sizes)


def encode(docs: DataFrame, keep: list[str] | None = None, check: bool = False, model: str = MODEL, dictionary: int = DICTIONARY) -> DataFrame:
    """``docs(text, ...)`` with n_pieces and pieces (ids) for every row; ``keep`` names the columns to return, default all but text.

    Words are segmented once for all documents by ``lattice``, the ``dictionary`` most frequent ones; the table of their ids is bounded and
    broadcast. A word outside it is rare, and folded where it stands by the same merges: shuffling every rare word to a table
    and back would move more than the texts. Whole texts are encoded, nothing is shuffled but distinct words.

    A null text has null pieces, an empty one none. Other columns pass through, but for any called as those added. Repeated
    rows get equal pieces; an empty table gives no rows. With ``check`` a column round_trip says whether decoding gives the text back
    (it does not where the text has U+2581 itself, which the model reads as a space).
    """
    added = [T.StructField("n_pieces", T.IntegerType()), T.StructField("pieces", T.ArrayType(T.IntegerType()))]
    added += [T.StructField("round_trip", T.BooleanType())] if check else []
    names = {"text", *(f.name for f in added)}
    keep = [c for c in (docs.columns if keep is None else keep) if c not in names]
    shared = docs.sparkSession.sparkContext.broadcast(encoder_for(docs, model, dictionary))
    schema = T.StructType(docs.select(*keep).schema.fields + added)
    return docs.select(*keep, F.col("text").cast("string").alias("text")).mapInArrow(_encoded(shared, len(keep), check), schema)


def decode(encoded: DataFrame, pieces: str = "pieces", text: str = "text", model: str = MODEL) -> DataFrame:
    """``encoded`` with the column ``text`` made from the ids in ``pieces``; null gives null. Ids outside the model decode to nothing."""
    ship(encoded.sparkSession)
    shared = encoded.sparkSession.sparkContext.broadcast(Encoder(Vocabulary(model), [], np.empty(0, np.int32), np.empty(0, np.int64)))
    at, names = encoded.columns.index(pieces), [c for c in encoded.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = shared.value.ready()
        for batch in batches:
            out = []
            for ids in batch.column(at):
                ids = ids.as_py()
                known = np.array([i for i in ids or [] if i is not None and 0 <= i < len(decoder.raw_sizes)], np.int64)
                out.append(None if ids is None else decoder.decode(known, np.array([0, len(known)]))[0])
            columns = [batch.column(batch.schema.get_field_index(n)) for n in names]
            yield pa.record_batch([*columns, pa.array(out, pa.string())], names=[*names, text])

    fields = [f for f in encoded.schema.fields if f.name != text]
    return encoded.mapInArrow(run, T.StructType([*fields, T.StructField(text, T.StringType())]))
