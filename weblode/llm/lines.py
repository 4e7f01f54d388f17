"""Line dedup by content-defined chunks of lines."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weblode.llm.ship import ship
from weblode.sources.stages import written

#: Lines whose hashes decide a boundary, and the divisor of the rolling hash: about ``SPARSE`` lines make a chunk.
ROLL = 2
SPARSE = 3
BASE = 1_000_003
MODULUS = 2_147_483_647
FILTER_BITS = 23
#: Words from which on a run of lines is a passage.
PASSAGE_WORDS = 50


def line_hash(line: str) -> int:
    """31-bit hash of a line's text: the first 12 hex digits of its MD5, reduced."""
    return int(hashlib.md5(line.encode()).hexdigest()[:12], 16) % MODULUS


def chunks(text: str) -> list[tuple[int, str]]:
    """(lines, text) of the chunks of a text, in order; joined by newlines they are the text.

    The hash rolls over the last ``ROLL`` lines; a chunk ends where it is divisible by ``SPARSE``. A boundary depends on those lines
    alone, so lines put in before a passage move its boundaries along with it.
    """
    lines, out, start, before = text.split("\n"), [], 0, 0
    for i, line in enumerate(lines):
        now = line_hash(line)
        if ((before * BASE + now) % MODULUS) % SPARSE == 0 or i == len(lines) - 1:
            out.append((i + 1 - start, "\n".join(lines[start:i + 1])))
            start = i + 1
        before = now
    return out


def _digest(chunk: str) -> tuple[int, int]:
    raw = hashlib.blake2b(chunk.encode(), digest_size=16).digest()
    return int.from_bytes(raw[:8], "little", signed=True), int.from_bytes(raw[8:], "little", signed=True)


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, chunk, h1, h2) of every chunk of two lines or more that has a visible character."""
    for batch in batches:
        docs, places, h1, h2 = [], [], [], []
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
            text = text.as_py()
            if not text or doc_id is None:
                continue
            for place, (lines, chunk) in enumerate(chunks(text)):
                if lines > 1 and chunk.strip():
                    a, b = _digest(chunk)
                    docs.append(doc_id)
                    places.append(place)
                    h1.append(a)
                    h2.append(b)
        yield pa.record_batch([pa.array(docs, pa.int64()), pa.array(places, pa.int32()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64())],
                              names=["doc_id", "chunk", "h1", "h2"])


def _bit(h1: np.ndarray) -> np.ndarray:
    return (h1.view(np.uint64) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


def _texts_of(wanted):
    """The text of chunks whose hash the filter lets through: (doc_id, chunk, h1, h2, body)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = wanted.value
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                text = text.as_py()
                if not text or doc_id is None:
                    continue
                for place, (lines, chunk) in enumerate(chunks(text)):
                    if lines > 1 and chunk.strip():
                        a, b = _digest(chunk)
                        at = (a & (1 << 64) - 1) >> (64 - FILTER_BITS)
                        if bits[at >> 3] >> (at & 7) & 1:
                            rows.append((doc_id, place, a, b, chunk))
            cols = list(zip(*rows)) or [[]] * 5
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string()]
            yield pa.record_batch([pa.array(list(c), k) for c, k in zip(cols, kinds)], names=["doc_id", "chunk", "h1", "h2", "body"])
    return run


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bits = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
    for batch in batches:
        at = _bit(batch.column(0).to_numpy(zero_copy_only=False))
        np.bitwise_or.at(bits, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))
    full = np.flatnonzero(bits)
    yield pa.record_batch([pa.array(full.astype(np.int32)), pa.array(bits[full].astype(np.int32))], names=["at", "mask"])


def repeated_chunks(docs: DataFrame) -> DataFrame:
    """(doc_id, chunk) of the chunks to remove: equal bytes to an earlier chunk, of another document or the same.

    Hashes of all multi-line chunks are counted map-side first. Chunks whose hash occurs once never leave the scan with their text:
    a second scan returns only text that a fixed-size filter (1 MiB) of repeated hashes lets through. The chunk of the smallest
    (doc_id, chunk) is the one that stays; each other one is compared with it byte by byte.
    """
    ship(docs.sparkSession)
    text = docs.selectExpr("cast(doc_id as long) as doc_id", "cast(text as string) as text")
    counted = text.mapInArrow(_found, "doc_id long, chunk int, h1 long, h2 long").groupBy("h1", "h2").agg(
        F.count("*").alias("copies"), F.min(F.struct("doc_id", "chunk")).alias("first"))
    again = written(counted.filter("copies > 1").select("h1", "h2", "first"), "lines-again")
    bits = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
    for batch in again.select("h1").mapInArrow(_marks, "at int, mask int").groupBy("at").agg(F.bit_or("mask").alias("mask")).toArrow().to_batches():
        bits[batch.column(0).to_numpy()] = batch.column(1).to_numpy()
    wanted = docs.sparkSession.sparkContext.broadcast(bits)
    bodies = written(text.mapInArrow(_texts_of(wanted), "doc_id long, chunk int, h1 long, h2 long, body string")
                     .join(again, ["h1", "h2"]), "lines-bodies")
    keeper = bodies.filter("doc_id = first.doc_id and chunk = first.chunk").groupBy("h1", "h2").agg(F.first("body").alias("kept_body"))
    return (bodies.filter("not (doc_id = first.doc_id and chunk = first.chunk)").join(keeper, ["h1", "h2"])
            .filter("body = kept_body").select("doc_id", "chunk").distinct())


def _removed(names: list[str]):
    text_at, drop_at = names.index("text"), names.index("_drop")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, n_chunks, n_gone, lines_gone = [], [], [], []
            for text, drop in zip(batch.column(text_at), batch.column(drop_at).to_pylist()):
                text = text.as_py()
                if text is None or not drop:
                    texts.append(text)
                    n_gone.append(0)
                    lines_gone.append(0)
                    continue
                gone, parts = set(drop), chunks(text)
                texts.append("\n".join(c for i, (_, c) in enumerate(parts) if i not in gone))
                n_gone.append(len(gone))
                lines_gone.append(sum(n for i, (n, _) in enumerate(parts) if i in gone))
            columns = [pa.array(texts, pa.string()) if i == text_at else batch.column(i) for i in range(len(names)) if i != drop_at]
            yield pa.record_batch([*columns, pa.array(n_gone, pa.int32()), pa.array(lines_gone, pa.int32())],
                                  names=[n for n in names if n != "_drop"] + ["_chunks_removed", "_lines_removed"])
    return run


def dedup_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with globally repeated multi-line chunks removed from ``text``; adds _chunks_removed and _lines_removed.

    Every row comes back with its other columns unchanged. Of equal chunks the one in the smallest doc_id, and there the earliest,
    stays. Single-line chunks and blank ones always stay. A null text stays null, an empty one empty; a text all of whose chunks
    repeat becomes empty. Columns of the names used here (_chunks_removed, _lines_removed, _drop, _gone_id) are replaced. Rows with a null doc_id are neither counted nor changed; rows that share a doc_id are one document
    whose equal places are one chunk, and lose the same places. An empty table gives no rows.
    """
    docs = docs.drop("_chunks_removed", "_lines_removed", "_drop", "_gone_id")
    docs = docs.withColumn("text", F.col("text").cast("string"))
    gone = repeated_chunks(docs).groupBy(F.col("doc_id").alias("_gone_id")).agg(F.collect_list("chunk").alias("_drop"))
    joined = docs.join(gone, docs["doc_id"].cast("long") == gone["_gone_id"], "left").drop("_gone_id")
    counts = [T.StructField("_chunks_removed", T.IntegerType()), T.StructField("_lines_removed", T.IntegerType())]
    return joined.mapInArrow(_removed(joined.columns), T.StructType(docs.schema.fields + counts))


def spans(text: str) -> set[tuple[int, int]]:
    """(first line, line after the last) of every span of a text that is looked for elsewhere.

    From every line with a word on, and up to every such line, the fewest lines with ``PASSAGE_WORDS`` words; the chunks of two lines or
    more; all of a text of two lines or more. Each depends on its own lines alone, and the first two kinds cover every line of every run of that
    many words, but for blank lines at its ends: a line with too few words between it and the end of a run is in the span that ends
    there. So two texts have a run in common just where they have its spans in common. Blank spans are left out, and no line is in
    more than a few times ``PASSAGE_WORDS`` spans, so time follows the text.
    """
    lines = text.split("\n")
    total = [0]
    for line in lines:
        total.append(total[-1] + len(line.split()))
    out, end = set(), 1
    for start in range(len(lines)):
        end = max(end, start + 1)
        while end <= len(lines) and total[end] - total[start] < PASSAGE_WORDS:
            end += 1
        if end > len(lines):
            break
        if total[start + 1] > total[start]:
            out.add((start, end))
    start = len(lines) - 1
    for end in range(len(lines), 0, -1):
        start = min(start, end - 1)
        while start >= 0 and total[end] - total[start] < PASSAGE_WORDS:
            start -= 1
        if start < 0:
            break
        if total[end] > total[end - 1]:
            out.add((start, end))
    start = 0
    for n, _ in chunks(text):
        out.add((start, start + n))
        start += n
    out.add((0, len(lines)))
    return {(a, b) for a, b in out if total[b] > total[a] and (b - a > 1 or total[b] - total[a] >= PASSAGE_WORDS)}


_SPAN = "doc_id long, start int, n int, h1 long, h2 long"


def _spans_of(wanted=None):
    """A row for every span, or those whose hash the filter lets through."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = None if wanted is None else wanted.value
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                text = text.as_py()
                if not text or doc_id is None:
                    continue
                lines = text.split("\n")
                for start, end in spans(text):
                    a, b = _digest("\n".join(lines[start:end]))
                    at = (a & (1 << 64) - 1) >> (64 - FILTER_BITS)
                    if bits is None or bits[at >> 3] >> (at & 7) & 1:
                        rows.append((doc_id, start, end - start, a, b))
            cols = list(zip(*rows)) or [[]] * 5
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
            yield pa.record_batch([pa.array(list(c), k) for c, k in zip(cols, kinds)], names=["doc_id", "start", "n", "h1", "h2"])
    return run


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, start, n, h1, h2) of the spans to remove: equal to one of an earlier document, or earlier in the same and apart from it.

    Equal are spans of equal 128-bit BLAKE2b digest. Digests are counted map-side; only those behind a filter of repeated ones are
    shuffled with their place, texts never.
    """
    ship(docs.sparkSession)
    text = docs.selectExpr("cast(doc_id as long) as doc_id", "cast(text as string) as text")
    counted = text.mapInArrow(_spans_of(), _SPAN).groupBy("h1", "h2").agg(
        F.count("*").alias("copies"), F.min(F.struct("doc_id", "start")).alias("first"))
    again = written(counted.filter("copies > 1").select("h1", "h2", "first"), "spans-again")
    bits = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
    for batch in again.select("h1").mapInArrow(_marks, "at int, mask int").groupBy("at").agg(F.bit_or("mask").alias("mask")).toArrow().to_batches():
        bits[batch.column(0).to_numpy()] = batch.column(1).to_numpy()
    wanted = docs.sparkSession.sparkContext.broadcast(bits)
    return (text.mapInArrow(_spans_of(wanted), _SPAN).join(again, ["h1", "h2"])
            .filter("doc_id > first.doc_id or start >= first.start + n").select("doc_id", "start", "n", "h1", "h2"))


def _without_spans(names: list[str]):
    text_at, drop_at = names.index("text"), names.index("_drop")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, gone = [], []
            for text, drop in zip(batch.column(text_at), batch.column(drop_at)):
                text, drop = text.as_py(), drop.as_py()
                if text is None or not drop:
                    texts.append(text)
                    gone.append(0)
                    continue
                lines = text.split("\n")
                stays = [True] * len(lines)
                for x in drop:  # of rows that share a doc_id only those lose a span that have it
                    end = x["start"] + x["n"]
                    if end <= len(lines) and _digest("\n".join(lines[x["start"]:end])) == (x["h1"], x["h2"]):
                        stays[x["start"]:end] = [False] * x["n"]
                texts.append("\n".join(line for line, stay in zip(lines, stays) if stay))
                gone.append(stays.count(False))
            columns = [pa.array(texts, pa.string()) if i == text_at else batch.column(i) for i in range(len(names)) if i != drop_at]
            yield pa.record_batch([*columns, pa.array(gone, pa.int32())], names=[n for n in names if n != "_drop"] + ["_lines_removed"])
    return run


def dedup_passages(docs: DataFrame) -> DataFrame:
    """``docs`` with every repeated passage removed from ``text`` whole; adds _lines_removed.

    A passage is a run of whole lines with 50 words or more that an earlier document has too, or the same one earlier and apart;
    besides go all chunks that ``dedup_lines`` removes, and all of a text of two lines or more that an earlier one equals. Of every
    line a copy stays. Shorter runs and single lines of fewer words stay unless they are such a chunk or text.

    Every row comes back with its other columns unchanged. A null text stays null, a text all of whose lines go becomes empty. Columns
    of the names used here (_lines_removed, _drop, _gone_id) are replaced. Rows with a null doc_id are neither counted nor changed; rows
    that share a doc_id are one document, equal places in it are one. An empty table gives no rows.
    """
    docs = docs.drop("_lines_removed", "_drop", "_gone_id")
    docs = docs.withColumn("text", F.col("text").cast("string"))
    gone = repeated_spans(docs).groupBy(F.col("doc_id").alias("_gone_id")).agg(F.collect_list(F.struct("start", "n", "h1", "h2")).alias("_drop"))
    joined = docs.join(gone, docs["doc_id"].cast("long") == gone["_gone_id"], "left").drop("_gone_id")
    return joined.mapInArrow(_without_spans(joined.columns), T.StructType([*docs.schema.fields, T.StructField("_lines_removed", T.IntegerType())]))
