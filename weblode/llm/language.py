"""Language identification by rank-order n-gram profiles and out-of-place distance."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weblode.llm.ship import ship

#: N-grams of 1 to this many characters, most frequent n-grams in a profile, and about how many documents of a language are
#: learned from (a documented bound; which ones is decided by a hash of doc_id).
LONGEST = 3
PROFILE = 300
LEARN_DOCS = 5000
UNKNOWN = "und"
_BLANK = 0x5F
_LETTERS: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    if not _LETTERS:
        _LETTERS.append(np.fromiter((not 0xD800 <= c < 0xE000 and chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


def ngrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams of a text's lower-cased words and their counts; words are runs of letters, blank at both ends.

    An n-gram is its code points in 21 bits each. No letter gives none.
    """
    codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
    letter = _is_letter()[codes]
    if not letter.any():
        return np.empty(0, np.int64), np.empty(0, np.int64)
    padded = np.full(len(codes) + 2, _BLANK, np.int64)
    padded[1:-1][letter] = codes[letter]
    solid = np.zeros(len(padded), bool)
    solid[1:-1] = letter
    keep = solid.copy()
    keep[1:] |= solid[:-1]
    keep[:-1] |= solid[1:]
    padded, solid = padded[keep], solid[keep]
    found = [padded[solid]]
    gram = padded
    for n in range(2, LONGEST + 1):
        gram = (gram[:-1] << 21) | padded[n - 1:]
        inner = np.ones(len(gram), bool)
        for j in range(1, n - 1):
            inner &= solid[j:len(solid) - n + 1 + j]
        if n == 2:
            inner = solid[:-1] | solid[1:]
        found.append(gram[inner])
    return np.unique(np.concatenate(found), return_counts=True)


def top(grams: np.ndarray, counts: np.ndarray, most: int = PROFILE) -> np.ndarray:
    """The most frequent n-grams in rank order, ties by n-gram."""
    if len(grams) > most:
        least = np.partition(counts, len(counts) - most)[len(counts) - most]
        near = counts >= least
        grams, counts = grams[near], counts[near]
    return grams[np.lexsort((grams, -counts))][:most]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, gram, n): sums over each batch, so what leaves a task is its vocabulary and not its text."""
    for batch in batches:
        langs: dict[str, list] = {}
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
            langs.setdefault(lang, []).append(ngrams(text or ""))
        for lang, parts in langs.items():
            grams, back = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
            sums = np.zeros(len(grams), np.int64)
            np.add.at(sums, back, np.concatenate([c for _, c in parts]))
            yield pa.record_batch([pa.array([lang] * len(grams), pa.string()), pa.array(grams), pa.array(sums)], names=["lang", "gram", "n"])


def learn(docs: DataFrame, learn_docs: int = LEARN_DOCS) -> list[tuple[str, list[int]]]:
    """A rank-order profile for each non-null lang of ``docs(doc_id, text, lang)``: at most ``PROFILE`` n-grams a language.

    ``learn_docs`` bounds the expected number of documents a language is learned from; a seeded hash of doc_id decides which.
    N-grams are counted in the tasks, summed by Spark, and only the finished profiles reach the driver.
    """
    ship(docs.sparkSession)
    labelled = docs.selectExpr("cast(doc_id as long) as doc_id", "cast(lang as string) as lang", "cast(text as string) as text").filter(
        "lang is not null")
    sizes = labelled.groupBy("lang").agg(F.count("*").alias("docs"))
    share = F.lit(float(1 << 20)) * learn_docs / F.col("docs")
    part = labelled.join(F.broadcast(sizes) if sizes.count() <= 10000 else sizes, "lang").filter(
        F.pmod(F.xxhash64(F.lit("lang"), "doc_id"), F.lit(1 << 20)) < share)
    counted = part.select("lang", "text").mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.col("n").desc(), "gram"))
    best = counted.withColumn("rank", rank).filter(F.col("rank") <= PROFILE)
    rows = best.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "gram"))), lambda x: x["gram"]).alias("grams")).collect()
    return sorted((r["lang"], r["grams"]) for r in rows)


class Profiles:
    """Profiles as one table: the rank of each known n-gram in each language."""

    def __init__(self, profiles: list[tuple[str, list[int]]]):
        self.langs = [lang for lang, _ in profiles]
        self.grams = np.unique(np.concatenate([np.array(g, np.int64) for _, g in profiles])) if profiles else np.empty(0, np.int64)
        self.ranks = np.full((len(self.grams) + 1, len(profiles)), -1, np.int64)
        for j, (_, grams) in enumerate(profiles):
            self.ranks[np.searchsorted(self.grams, np.array(grams, np.int64)), j] = np.arange(len(grams))

    def predict(self, text: str | None) -> tuple[str, float]:
        """The nearest language and 1 - distance / largest distance; ties go to the first language in code point order."""
        grams, counts = ngrams(text or "")
        if not len(grams) or not self.langs:
            return UNKNOWN, 0.0
        mine = top(grams, counts)
        at = np.searchsorted(self.grams, mine)
        known = (at < len(self.grams)) & (np.append(self.grams, -1)[at] == mine)
        theirs = self.ranks[np.where(known, at, len(self.grams))]
        out = np.where(theirs < 0, PROFILE, np.abs(theirs - np.arange(len(mine))[:, None])).sum(axis=0)
        best = int(out.argmin())
        return self.langs[best], float(1 - out[best] / (PROFILE * len(mine)))


def predict(docs: DataFrame, profiles: list[tuple[str, list[int]]]) -> DataFrame:
    """``docs(doc_id, text, ...)`` to one row per input row: doc_id, lang_pred, score. Only the text is looked at.

    ``und`` with score 0 where the text is null, has no letter, or nothing was learned. Whole texts are profiled, in the scan,
    one document at a time; repeated rows get equal answers; a null doc_id passes through; an empty table gives no rows.
    """
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(Profiles(profiles))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            langs, scores = [], []
            for text in batch.column("text"):
                lang, score = known.predict(text.as_py())
                langs.append(lang)
                scores.append(score)
            yield pa.record_batch([batch.column("doc_id"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                                  names=["doc_id", "lang_pred", "score"])

    return docs.selectExpr("cast(doc_id as long) as doc_id", "cast(text as string) as text").mapInArrow(
        run, "doc_id long, lang_pred string, score double")


def held_out(doc_id: Column) -> Column:
    """Documents that are never learned from: crc32 of the doc_id as text leaves 2 modulo 4 (null counts as an empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2
