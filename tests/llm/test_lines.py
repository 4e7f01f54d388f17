"""Line chunks against brute force."""

import random

from weblode.llm.lines import chunks, dedup_lines, dedup_passages

SCHEMA = "doc_id long, text string, _drop int, chunk string"


def frame(spark, docs):
    return spark.createDataFrame([(*d, 1, "c") for d in docs], SCHEMA)


def brute(docs):
    seen, first = {}, {}
    for doc_id, text in docs:
        if doc_id is not None:
            for i, (n, body) in enumerate(chunks(text) if text else []):
                if n > 1 and body.strip():
                    first[body] = min(first.get(body, (doc_id, i)), (doc_id, i))
    out = []
    for doc_id, text in docs:
        parts = chunks(text) if text and doc_id is not None else []
        gone = {i for i, (n, body) in enumerate(parts) if n > 1 and body.strip() and first[body] != (doc_id, i)}
        seen[doc_id] = gone
        out.append((doc_id, "\n".join(b for i, (_, b) in enumerate(parts) if i not in gone) if gone else text, len(gone)))
    return sorted(out, key=str)


def answer(spark, docs):
    return sorted(((r.doc_id, r.text, r._chunks_removed) for r in dedup_lines(frame(spark, docs)).collect()), key=str)


def test_chunks_join_to_the_text_and_follow_a_shift():
    rng = random.Random(0)
    for text in ("", "one", "a\n", "\n\n", "a\n\nb", "\r\nx\n"):
        assert "\n".join(b for _, b in chunks(text)) == text
    passage = [f"line {rng.randrange(10**6)}" for _ in range(40)]
    alone, shifted = chunks("\n".join(passage)), chunks("\n".join(["new", "lines", "before", *passage]))
    assert len({b for _, b in alone} & {b for _, b in shifted}) >= len(alone) - 2


def test_against_brute_force(spark):
    rng = random.Random(3)
    pool = [f"line {i}" for i in range(300)]
    passage = [f"shared {i} " + "w " * 20 for i in range(12)]
    docs = []
    for i in range(80):
        lines = [rng.choice(pool) for _ in range(rng.randrange(1, 25))]
        if rng.random() < 0.4:
            at = rng.randrange(len(lines) + 1)
            lines[at:at] = passage
        docs.append((i, "\n".join(lines)))
    docs += [(100 + i, docs[5][1]) for i in range(30)] + [(-1, docs[7][1]), (200, None), (201, ""), (202, "\n\n\n"), (203, "\n\n\n"), (None, docs[5][1])]
    assert answer(spark, docs) == brute(docs)


def test_repeats_inside_one_long_document_and_repeated_rows(spark):
    rng = random.Random(4)
    part = "\n".join(f"p{rng.randrange(10**9)}" for _ in range(9))
    long = "\n".join([part, *(f"u{i}" for i in range(20000)), part])
    docs = [(1, long), (2, part), (3, "k\nl\nm\nn\no"), (3, "k\nl\nm\nn\no")]
    assert answer(spark, docs) == brute(docs)


def test_empty_table(spark):
    got = dedup_lines(frame(spark, []))
    assert got.collect() == [] and got.columns == ["doc_id", "text", "chunk", "_chunks_removed", "_lines_removed"]


def runs(docs):
    """Lines of each document in a run of 50 words or more that an earlier document has too, by comparing all pairs of documents."""
    out = {}
    for d, text in docs:
        mine = text.split("\n")
        gone = set()
        for e, other in docs:
            theirs = other.split("\n") if e < d and not set(mine).isdisjoint(other.split("\n")) else []
            for shift in range(-len(theirs), len(mine)):
                run = []
                for i in [*range(max(0, shift), min(len(mine), shift + len(theirs))), None]:
                    if i is not None and mine[i] == theirs[i - shift]:
                        run.append(i)
                        continue
                    if sum(len(mine[j].split()) for j in run) >= 50:
                        gone.update(run)
                    run = []
        out[d] = gone
    return out


def passages(spark, docs):
    return {r.doc_id: (r.text, r._lines_removed) for r in dedup_passages(frame(spark, docs)).collect()}


def test_planted_passages_of_one_to_eight_lines_go_whole(spark):
    rng = random.Random(6)
    docs, planted = [], {}
    own = lambda: [f"own {rng.randrange(10**9)} " + "x " * rng.randrange(12) for _ in range(rng.randrange(1, 6))]
    for n in range(1, 9):
        for k in range(5):
            passage = [f"passage {rng.randrange(10**9)} " + "w " * (60 // n) for _ in range(n)]
            first, second = len(docs), len(docs) + 1
            docs += [(first, "\n".join([*own(), *passage, *own()])), (second, "\n".join([*own(), *passage, *own()]))]
            planted[second] = passage
    docs += [(len(docs), docs[3][1]), (len(docs) + 1, "one line " * 30), (len(docs) + 2, "one line " * 30)]
    want, got = runs(docs), passages(spark, docs)
    for d, text in docs:
        assert want[d] == set() or len(want[d]) >= len(planted.get(d, ()))
        assert got[d] == ("\n".join(x for i, x in enumerate(text.split("\n")) if i not in want[d]), len(want[d])), d
    for d, passage in planted.items():
        assert not set(passage) & set(got[d][0].split("\n"))
    assert got[len(docs) - 1][0] == "" and got[len(docs) - 3][0] == ""


def test_passages_against_line_runs_chunks_and_what_stays(spark):
    rng = random.Random(7)
    pool = [f"line {i} " + "w " * rng.randrange(30) for i in range(40)]
    docs = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randrange(1, 30)))) for i in range(60)]
    want, got, chunked = runs(docs), passages(spark, docs), {i: n for i, _, n in brute(docs)}
    for d, text in docs:
        lines, left = text.split("\n"), iter(got[d][0].split("\n"))
        assert all(any(x == y for y in lines) for x in left) and got[d][1] >= len(want[d]) and (got[d][1] > 0) >= (chunked[d] > 0)
    assert {x for _, t in docs for x in t.split("\n")} == {x for t, _ in got.values() for x in t.split("\n") if x}


def test_passages_of_odd_rows(spark):
    line = "w " * 60 + "end"
    docs = [(1, "a\n" + line), (1, "a\n" + line), (2, None), (3, ""), (None, line), (4, "\n".join([line] * 3 + ["b c"] * 60)), (5, "b c\n\nb c"), (6, "b c\n\nb c")]
    got = sorted(((r.doc_id, r.text, r._lines_removed) for r in dedup_passages(frame(spark, docs)).collect()), key=str)
    kept = [t.count("b c") for i, t, _ in got if i == 4]
    assert 25 <= kept[0] < 60 and [g for g in got if g[0] != 4] == sorted(
        [(1, "a\n" + line, 0), (1, "a\n" + line, 0), (2, None, 0), (3, "", 0), (None, line, 0), (5, "b c\n\nb c", 0), (6, "", 3)], key=str)
    assert all(line not in t for i, t, _ in got if i == 4)
    empty = dedup_passages(frame(spark, []))
    assert empty.collect() == [] and empty.columns == ["doc_id", "text", "chunk", "_lines_removed"]


def test_blank_lines_cost_no_more_than_others():
    import time

    from weblode.llm.lines import _digest, spans

    start = time.perf_counter()
    text = "\n" * 60_000 + "w " * 30 + "\n" * 60_000 + "v " * 30
    found = spans(text)
    assert sum(b - a for a, b in found) < 3 * 150_000 + len(text) and all(_digest(text) for _ in range(2)) and time.perf_counter() - start < 5
