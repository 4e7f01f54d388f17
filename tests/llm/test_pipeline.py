"""The pipeline's stages, each against brute force on its own input."""

import os

import pytest

import corpus_pipeline
from tests.llm.test_jaccard import brute as links
from weblode.llm.pieces import MODEL
from weblode.llm.quality import _measured

import pyarrow as pa

def repeated_lines(docs):
    """Lines in a shortest run of 50 words or more, from any line on, that an earlier document has too."""
    seen, out = {}, {}
    for d, text in docs:
        lines, gone = text.split("\n"), set()
        for a in range(len(lines)):
            b, words = a, 0
            while b < len(lines) and words < 50:
                words += len(lines[b].split())
                b += 1
            if words >= 50 and seen.setdefault("\n".join(lines[a:b]), d) != d:
                gone.update(range(a, b))
        out[d] = gone
    return out


COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not (os.path.isdir(SF) and os.path.exists(MODEL)), reason="no supplied tables")


def table(df):
    return sorted(((r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in df.collect()), key=str)


def test_stages(spark, tmp_path):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "line_dedup", "near_duplicates", "mixing", "sentence_pieces"]
    steps = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    start = table(docs)

    kept = steps["quality_rules"](spark, docs, SF)
    batch = pa.record_batch([pa.array([r[0] for r in start]), pa.array([r[1] for r in start])], names=["doc_id", "text"])
    good = {i for part in _measured(iter([batch])) for i, k in zip(part.column("doc_id").to_pylist(), part.column("kept").to_pylist()) if k}
    assert kept.columns == COLUMNS and table(kept) == [r for r in start if r[0] in good]
    kept.write.parquet(str(tmp_path / "1"))
    kept = spark.read.parquet(str(tmp_path / "1"))

    cut = steps["line_dedup"](spark, kept, SF)
    before, after = {r[0]: r[1] for r in table(kept)}, {r.doc_id: (r.text, r.n_chars) for r in cut.collect()}
    gone = repeated_lines(sorted(before.items()))
    assert cut.columns == COLUMNS and sum(map(len, gone.values())) > 0
    for i, text in before.items():
        left = after[i][0].split("\n") if i in after else []
        stays = iter(text.split("\n"))
        assert all(any(x == y for y in stays) for x in left)  # lines go, none changes
        assert len(left) <= len(text.split("\n")) - len([x for x in gone[i] if text.split("\n")[x].strip()])
        assert i not in after or after[i] == (text, len(text)) or after[i][1] == len(after[i][0])
    lines = lambda texts: {x for t in texts for x in t.split("\n") if x.strip()}
    assert lines(before.values()) == lines(t for t, _ in after.values())  # of every line a copy stays
    cut.write.parquet(str(tmp_path / "2"))
    cut = spark.read.parquet(str(tmp_path / "2"))

    single = steps["near_duplicates"](spark, cut, SF)
    first = {c for _, _, c in links([r[:2] for r in table(cut)], 5, 80)}
    assert single.columns == COLUMNS and table(single) == [r for r in table(cut) if r[0] in first]
    single.write.parquet(str(tmp_path / "3"))
    single = spark.read.parquet(str(tmp_path / "3"))

    mixed = steps["mixing"](spark, single, SF)
    rows, known = table(mixed), set(table(single))
    assert mixed.columns == COLUMNS and set(rows) <= known and max(rows.count(r) for r in set(rows)) <= 3
    words = lambda rs: sum(len(r[1].split()) for r in rs)
    assert abs(words(rows) / words(known) - 1) < 0.1
    mixed.write.parquet(str(tmp_path / "4"))

    out = steps["sentence_pieces"](spark, spark.read.parquet(str(tmp_path / "4")), SF)
    assert sorted(r.doc_id for r in out.collect()) == sorted(r[0] for r in rows) and "pieces" in out.columns


def test_odd_rows(spark):
    rows = [(None, None, None, None, None), (1, "", "en", None, 0), (2, "one line of text only " * 3, "en", "a", 9), (2, "one line of text only " * 3, "en", "a", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for frame in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            stage(spark, frame, SF).collect()
