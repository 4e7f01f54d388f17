"""Lookup tables and placement."""

import hashlib
from collections import Counter

import pytest

from weblode.llm.sharding import SLOTS, lookup_table, place, write_shards

NAMES = [f"s{i}" for i in range(7)]


def turns(shards, slots):
    draw = lambda s, salt: int(hashlib.md5(f"{salt}:{s}".encode()).hexdigest()[:12], 16)
    prefer = [[(draw(s, "offset") + j * (draw(s, "skip") % (slots - 1) + 1)) % slots for j in range(slots)] for s in shards]
    table = {}
    while len(table) < slots:
        for i, order in enumerate(prefer):
            free = next((x for x in order if x not in table), None)
            if free is not None:
                table[free] = i
    return [table[i] for i in range(slots)]


def test_table_like_turn_taking():
    for shards, slots in ((NAMES, 101), (NAMES[:1], 3), (NAMES[:3], 31)):
        assert lookup_table(shards, slots).tolist() == turns(shards, slots)


def test_even_and_stable():
    table, fewer = lookup_table(NAMES), lookup_table(NAMES[:-1])
    counts = Counter(table.tolist())
    assert max(counts.values()) - min(counts.values()) <= 1
    stayed = sum(a == b for a, b in zip(table, fewer) if a != 6) / sum(a != 6 for a in table)
    assert stayed > 0.8


@pytest.mark.parametrize("shards,slots", [([], 7), (["a", "a"], 7), (["a"], 8), (["a"], 2), (["a", "b", "c", "d"], 3)])
def test_refused(shards, slots):
    with pytest.raises(ValueError):
        lookup_table(shards, slots)


def test_placement(spark):
    rows = [(1, "x", 5), (1, "y", 6), (None, "z", 7), (10**15, None, None)]
    got = place(spark.createDataFrame(rows, "doc_id long, _shard string, _slot int"), "doc_id", NAMES).collect()
    table = lookup_table(NAMES)
    assert len(got) == 4
    for r in got:
        slot = int(hashlib.md5(("" if r.doc_id is None else str(r.doc_id)).encode()).hexdigest()[:12], 16) % SLOTS
        assert r._slot == slot and r._shard == NAMES[table[slot]]
    assert place(spark.createDataFrame([], "doc_id long"), "doc_id", NAMES).collect() == []


def test_written_shards(spark, tmp_path):
    df = spark.range(200).withColumnRenamed("id", "doc_id")
    write_shards(df, "doc_id", NAMES, str(tmp_path / "out"), files=2)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert {(r.doc_id, r._shard) for r in back.collect()} == {(r.doc_id, r._shard) for r in place(df, "doc_id", NAMES).collect()}
