"""Fill-in-middle transformation: unit boundaries found in 64-bit words of the UTF-8 bytes (SIMD within a register)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weblode.llm.blocks import blocks
from weblode.llm.ship import ship

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"

U = np.uint64
_ONES = U(0x0101010101010101)
_HIGH = U(0x8080808080808080)
_LOW7 = U(0x7F7F7F7F7F7F7F7F)
_NEWLINES = U(0x0A0A0A0A0A0A0A0A)


def as_words(data: np.ndarray) -> np.ndarray:
    """The bytes as little-endian 64-bit words, with at least one zero byte behind the last."""
    padded = np.zeros((len(data) // 8 + 1) * 8, np.uint8)
    padded[:len(data)] = data
    return padded.view("<u8")


def newline_marks(words: np.ndarray) -> np.ndarray:
    """The high bit of every byte that is a newline: a byte is zero after the exclusive or, and adding 0x7F to its low bits
    sets the high bit of every other one. No carry leaves a byte, so the marks are exact."""
    x = words ^ _NEWLINES
    return ~(((x & _LOW7) + _LOW7) | x) & _HIGH


def lead_marks(words: np.ndarray) -> np.ndarray:
    """The high bit of every byte that begins a code point, which is every byte but 10xxxxxx (padding is marked as well)."""
    return ~(words & ~(words << U(1))) & _HIGH


class Marks:
    """Marked bytes with their running count by word: rank and select in constant and logarithmic time."""

    def __init__(self, marks: np.ndarray) -> None:
        self.marks = marks
        self.before = np.zeros(len(marks) + 1, np.int64)
        np.cumsum(np.bitwise_count(marks), dtype=np.int64, out=self.before[1:])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """How many marked bytes lie before each place."""
        word = at >> 3
        below = (U(1) << ((at & 7).astype(U) << U(3))) - U(1)
        return self.before[word] + np.bitwise_count(self.marks[word] & below)

    def select(self, k: np.ndarray) -> np.ndarray:
        """The place of the k-th marked byte, from 0. The word is found in the running counts; in it, the product with ones holds in
        each byte the marks up to that byte, and the bytes that hold k or fewer are the ones before the place."""
        word = np.searchsorted(self.before, k, "right") - 1
        left = (k - self.before[word]).astype(U)
        upto = (self.marks[word] >> U(7)) * _ONES
        return (word << 3) + np.bitwise_count(((left * _ONES | _HIGH) - upto) & _HIGH)


def _cuts(data: np.ndarray, offsets: np.ndarray, h1: np.ndarray, h2: np.ndarray):
    """For each text: its units, and the bytes and code points where prefix and middle end."""
    words = as_words(data)
    lines, leads = Marks(newline_marks(words)), Marks(lead_marks(words))
    start, end = offsets[:-1], offsets[1:]
    first = lines.rank(start)
    whole = lines.rank(end) - first
    full = end > start
    open_ended = np.zeros(len(start), bool)
    open_ended[full] = data[end[full] - 1] != 10
    n = whole + open_ended
    cuts = [h1 % (n + 1), h2 % (n + 1)]
    places = []
    for units in (np.minimum(*cuts), np.maximum(*cuts)):
        place = np.where(units == n, end, start)
        inner = (units > 0) & (units < n)
        place[inner] = lines.select(first[inner] + units[inner] - 1) + 1
        places.append(place)
    a, b = places
    base, mid, top = leads.rank(start), leads.rank(a), leads.rank(b)
    return n, a, b, mid - base, top - mid


def _arrange(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, data, offsets in blocks(batches):
        column = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
        n, a, b, prefix_chars, middle_chars = _cuts(data, offsets, column["h1"].to_numpy(), column["h2"].to_numpy())
        forms, raw, out, sizes = column["form"].to_pylist(), memoryview(data.tobytes()), [], np.zeros(batch.num_rows + 1, np.int64)
        p, s, m = PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()
        for i, form in enumerate(forms):
            prefix, middle, suffix = raw[offsets[i]:a[i]], raw[a[i]:b[i]], raw[b[i]:offsets[i + 1]]
            if form == "psm":
                out += p, prefix, s, suffix, m, middle
            elif form == "spm":
                out += s, suffix, p, prefix, m, middle
            else:
                out.append(raw[offsets[i]:offsets[i + 1]])
            sizes[i + 1] = sizes[i] + offsets[i + 1] - offsets[i] + (0 if form == "plain" else len(p) + len(s) + len(m))
        plain = np.array([f == "plain" for f in forms])
        output = pa.Array.from_buffers(
            pa.large_utf8(), batch.num_rows, [None, pa.py_buffer(sizes.tobytes()), pa.py_buffer(b"".join(out))])
        yield pa.record_batch(
            [column["doc_id"], pa.array(n, pa.int64()), column["form"], pa.array(prefix_chars, pa.int64(), mask=plain),
             pa.array(middle_chars, pa.int64(), mask=plain), output.cast(pa.utf8())],
            names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])


def fill_in_middle(docs: DataFrame, seed: int = 7, fim_percent: int = 100, spm_percent: int = 50) -> DataFrame:
    """``docs(doc_id, text, ...)`` to one row per document: doc_id, n, form, prefix_chars, middle_chars, output.

    A text's units are its lines with their newlines. The first four 32-bit numbers of the SHA-256 of ``seed:doc_id`` choose the
    two cuts, whether the text is transformed (``fim_percent``), and which order it gets (``spm_percent``): ``psm`` gives
    ``<P>`` prefix ``<S>`` suffix ``<M>`` middle, ``spm`` gives ``<S>`` suffix ``<P>`` prefix ``<M>`` middle. A text that is
    empty or holds one of the three marks is ``plain`` and returned as it is.

    Bytes are searched as 64-bit words: newlines and code point starts are marked arithmetically, counted by word, and the
    word of a cut is found in the running counts. Work and memory follow the bytes; nothing is shuffled.

    Null texts are empty (``output`` is the empty text); a null doc_id is hashed as the word ``null``; repeated rows give repeated
    results; an empty table gives no rows; other columns are ignored. ``restored`` gives the text back.
    """
    ship(docs.sparkSession)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))), 256)
    draw = [F.conv(F.substring("digest", 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), digest.alias("digest"))
    marked = F.lit(False)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        marked = marked | F.contains("text", F.lit(mark))
    form = (F.when((F.col("text") == "") | marked | (draw[2] % 100 >= fim_percent), "plain")
            .when(draw[3] % 100 < spm_percent, "spm").otherwise("psm"))
    drawn = rows.select("doc_id", "text", draw[0].alias("h1"), draw[1].alias("h2"), form.alias("form"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return drawn.mapInArrow(_arrange, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text that ``output`` was made from. Texts with marks are plain, and no mark can begin inside another, so every mark
    found was put there."""
    between = lambda a, b: F.substring_index(F.substring_index(output, b, 1), a, -1)
    prefix = F.when(form == "psm", between(PREFIX, SUFFIX)).otherwise(between(PREFIX, MIDDLE))
    suffix = F.when(form == "psm", between(SUFFIX, MIDDLE)).otherwise(between(SUFFIX, PREFIX))
    return F.when(form == "plain", output).otherwise(F.concat(prefix, F.substring_index(output, MIDDLE, -1), suffix))
