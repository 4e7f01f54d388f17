"""Quality rules: base word rules, then compression bands over whole documents and fixed chunks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from weblode.llm.blocks import SPACE, blocks, windows, word_hashes, words
from weblode.llm.ship import ship

SYMBOLS = np.zeros(256, bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True
WINDOW = 5
LEVEL = 3
CHUNK = 4096
#: (bytes, least ratio, most ratio) of raw to compressed bytes of a whole document, drawn straight in between over log2(bytes).
#: The most is a few hundredths above what prose reaches at that length, more where chunks tell better; the least is what encoded or
#: random text stays below.
BANDS = ((64, 0.0, 1.4), (128, 0.0, 1.6), (256, 1.1, 1.76), (512, 1.2, 1.97), (1024, 1.3, 2.12), (2048, 1.4, 2.25), (4096, 1.45, 2.34),
         (8192, 1.45, 2.5), (16384, 1.5, 2.75), (32768, 1.5, 2.95), (131072, 1.5, 3.3))
#: The same for every full chunk of ``CHUNK`` bytes. A document fails by its chunks when more than this share is outside.
CHUNK_BAND = (1.45, 2.34)
CHUNK_SHARE = 0.25
#: (least bytes of a document, bytes of its pieces). From two chunks on, pieces are held against noise alone; below, they judge what is
#: left after the first chunk.
PIECES = ((CHUNK, 1024), (2048, 512), (512, 256))
#: Short pieces vary more than documents of their length: their most is the band's times this.
PIECE_SLACK = 1.15
#: (bytes, bits, ratio): a mostly ASCII text is noise when its bytes, each coded by its own frequency, take more bits each than prose reaches
#: and it compresses to less than this ratio. Compression alone does not tell prose from noise under some 200 bytes.
NOISE = ((64, 4.7, 1.0), (80, 4.79, 1.0), (128, 5.0, 1.05), (256, 5.05, 1.2), (512, 5.05, 1.3), (1024, 5.05, 1.4))
_AT = {name: np.log2([row[0] for row in table]) for name, table in (("bands", BANDS), ("noise", NOISE))}

MEASURES = ("doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long,"
            " base_failed boolean, kept boolean, ratio double, low_chunk double, high_chunk double, odd_chunks double")
_BLANK = b" \t\n\x0b\x0c\r"


def _repeated(grams: np.ndarray) -> int:
    """Words inside windows that occur twice or more; ``grams`` are the hashes of all windows in text order."""
    ordered = np.sort(grams)
    if not (ordered[1:] == ordered[:-1]).any():
        return 0
    _, back, counts = np.unique(grams, return_inverse=True, return_counts=True)
    edge = np.zeros(len(grams) + WINDOW, np.int64)
    at = np.flatnonzero(counts[back] > 1)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + WINDOW, -1)
    return int(np.count_nonzero(np.cumsum(edge)))


def _dup_lines(text: bytes) -> int:
    lines = [x for x in text.split(b"\n") if x.strip(_BLANK)]
    return len(lines) - len(set(lines))


def _per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return np.diff(total[offsets])


def cut(text: bytes, size: int) -> list[bytes]:
    """A text's parts of ``size`` bytes; where it is no multiple of that, the last part reaches back from its end."""
    ends = list(range(size, len(text) + 1, size))
    if ends and ends[-1] < len(text):
        ends.append(len(text))
    return [text[end - size:end] for end in ends]


def is_noise(text: bytes, ratio: float) -> bool:
    """Whether a text has too many bits a byte for prose, and hardly compresses."""
    _, bits, most = zip(*NOISE)
    at = np.log2(max(len(text), 1))
    if not text or ratio >= np.interp(at, _AT["noise"], most):
        return False
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    if counts[128:].sum() * 4 > len(text):
        return False
    share = counts[counts > 0] / len(text)
    return bool(-(share * np.log2(share)).sum() > np.interp(at, _AT["noise"], bits))


def odd_pieces(text: bytes, ratio_of) -> float:
    """The share of a text's pieces that are noise or, in a text of less than two chunks, outside the band of their length."""
    size = next((size for least, size in PIECES if len(text) >= least), 0)
    pieces = cut(text, size) if size else []
    if not pieces:
        return 0.0
    _, low, high = zip(*BANDS)
    low, high = (np.interp(np.log2(size), _AT["bands"], limit) for limit in (low, high))
    odd = 0
    for piece in pieces:
        ratio = ratio_of(piece)
        odd += ratio < low or ratio > PIECE_SLACK * high and len(text) < 2 * CHUNK or is_noise(piece, ratio)
    return odd / len(pieces)


def band_verdict(size: int, ratio: float, chunks: list[float]) -> tuple[bool, float]:
    """Whether the ratios are inside the bands, and the share of chunks outside theirs."""
    bytes_, low, high = zip(*BANDS)
    at = np.log2([max(size, 1), *bytes_])
    low, high = np.interp(at[0], at[1:], low), np.interp(at[0], at[1:], high)
    odd = sum(not CHUNK_BAND[0] <= c <= CHUNK_BAND[1] for c in chunks) / len(chunks) if chunks else 0.0
    return bool(low <= ratio <= high and odd <= CHUNK_SHARE), odd


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    press = zstandard.ZstdCompressor(level=LEVEL, write_content_size=False, write_checksum=False)

    def ratio_of(part: bytes) -> float:
        return len(part) / len(press.compress(part)) if part else 0.0

    for batch, data, offsets in blocks(batches):
        starts, ends, first = words(data, offsets)
        grams = windows(word_hashes(data, starts, ends), WINDOW)
        n_words = np.diff(first)
        repeats, dups, rest = np.zeros(len(n_words), np.int64), np.zeros(len(n_words), np.int64), []
        for i in range(len(n_words)):
            if n_words[i] > WINDOW:
                repeats[i] = _repeated(grams[first[i]:first[i + 1] - WINDOW + 1])
            text = data[offsets[i]:offsets[i + 1]].tobytes()
            dups[i] = _dup_lines(text)
            ratio = ratio_of(text)
            parts = [ratio_of(part) for part in cut(text if len(text) >= 2 * CHUNK else text[:CHUNK], CHUNK)]
            fine, odd = band_verdict(len(text), ratio, parts)
            odd = max(odd, odd_pieces(text, ratio_of))
            fine = fine and odd <= CHUNK_SHARE and not is_noise(text, ratio)
            rest.append((fine, ratio, min(parts, default=None), max(parts, default=None), odd))
        failed = (n_words < 10) | (100 * repeats > 20 * n_words)
        fine, ratio, low, high, odd = zip(*rest)
        yield pa.record_batch(
            [batch.column("doc_id").cast(pa.int64()), pa.array(n_words), pa.array(_per_text(~SPACE[data] & ((data & 0xC0) != 0x80), offsets)),
             pa.array(_per_text(SYMBOLS[data], offsets)), pa.array(dups), pa.array(repeats), pa.array(failed), pa.array(~failed & np.array(fine)),
             pa.array(ratio, pa.float64()), pa.array(low, pa.float64()), pa.array(high, pa.float64()), pa.array(odd, pa.float64())],
            names=[field.split()[0] for field in MEASURES.split(", ")])


def quality_measures(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text, ...)`` to one row per input row with its measures and verdict.

    A row fails the base rules with fewer than 10 words, or when more than 20 % of its words are in 5-word windows that occur
    again in the text. A row that passes is kept when its zstandard ratio (raw to compressed bytes) is in the band of its length,
    no more than a quarter of its 4 KiB chunks are outside theirs and no more than a quarter of its smaller pieces (256 to 1,024
    bytes, from 512 bytes on) are odd: repetitive text lies above a band, noise below. The last piece ends with the text,
    and so does the last chunk from 8 KiB on. Odd is noise in texts of any length, repetition in pieces of texts under 8 KiB. A text
    under 512 bytes is judged whole; mostly non-ASCII text by compression alone. odd_chunks is the larger of the two shares.

    Whole texts are read, in blocks; null is the empty text and fails. Rows are judged alone, so ties and repeated rows do not
    matter; a null doc_id passes through. An empty table gives no rows; other columns are ignored.
    """
    ship(docs.sparkSession)
    return docs.selectExpr("cast(doc_id as long) as doc_id", "cast(text as string) as text").mapInArrow(_measured, MEASURES)


def good_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns: judged in the scan, nothing is shuffled."""
    ship(docs.sparkSession)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            judged = pa.record_batch([pa.nulls(batch.num_rows, pa.int64()), batch.column(at)], names=["doc_id", "text"])
            kept = [flag for part in _measured(iter([judged])) for flag in part.column("kept").to_pylist()]
            yield batch.filter(pa.array(kept, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
