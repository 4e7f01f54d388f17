"""Quality measures against plain Python."""

import random
import re
import string

from weblode.llm.quality import band_verdict, cut, good_documents, is_noise, quality_measures

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    words = WORD.findall(text or "")
    grams = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    again = {i + j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(5)} if len(grams) < 2000 else set()
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    failed = len(words) < 10 or 100 * len(again) > 20 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(again), failed


def texts():
    rng = random.Random(1)
    vocabulary = ["".join(rng.choices(string.ascii_lowercase + "éß", k=rng.randrange(1, 9))) for _ in range(200)]
    out = [" ".join(rng.choices(vocabulary, k=rng.randrange(1, 300))) for _ in range(60)]
    out += ["\n".join([t, t, t[:20]]) for t in out[:20]] + [t.replace("a", "# ") for t in out[:10]]
    return out + [None, "", " \x0b\x0c\r\n\t ", "a", "a b c d e", "x y z x y z x y z x y z", "   ", "a\x1cb c\x85d", "\n\nq\n q\nq\n"]


def test_against_plain_python(spark):
    rows = list(enumerate(texts()))
    got = quality_measures(spark.createDataFrame([(*r, 1, True) for r in rows], "doc_id long, text string, n_words int, kept boolean")).collect()
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(rows[r.doc_id][1]), rows[r.doc_id]
        assert not (r.base_failed and r.kept)
    assert len(got) == len(rows)


def test_bands():
    assert band_verdict(3000, 2.0, []) == (True, 0.0)
    assert not band_verdict(3000, 3.0, [])[0] and not band_verdict(3000, 1.2, [])[0]
    assert band_verdict(50, 0.8, [])[0]
    assert not band_verdict(20000, 2.2, [2.1, 2.1, 9.0, 9.0])[0] and band_verdict(20000, 2.2, [2.1, 2.1, 2.1, 9.0])[0]


def test_noise_and_repetition_go_and_prose_stays(spark):
    rng = random.Random(2)
    vocabulary = ["".join(rng.choices("etaoinshrdlu", weights=range(12, 0, -1), k=rng.randrange(2, 9))) for _ in range(3000)]
    prose = " ".join(rng.choices(vocabulary, k=900))
    noise = " ".join("".join(rng.choices(string.ascii_letters + string.digits + "+/", k=60)) for _ in range(90))
    numbered = "\n".join(f"the same sentence with a number, and this number is {i}" for i in range(200))
    docs = spark.createDataFrame([(1, prose, "k"), (2, noise, "k"), (3, numbered, "k"), (None, prose, "k"), (4, None, "k")], "doc_id long, text string, extra string")
    kept = good_documents(docs).collect()
    assert sorted((r.doc_id, r.extra) for r in kept if r.doc_id) == [(1, "k")] and len(kept) == 2


def test_long_text_in_blocks_and_empty_table(spark):
    rng = random.Random(3)
    long = " ".join(f"{rng.randrange(10**6)}" for _ in range(400000))
    row = quality_measures(spark.createDataFrame([(1, long), (2, "a b")], "doc_id long, text string")).filter("doc_id = 1").first()
    assert row.n_words == 400000 and row.n_symbols == 0
    assert quality_measures(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_noise_goes_wherever_it_lies_and_however_short(spark):
    rng = random.Random(5)
    vocabulary = ["".join(rng.choices("etaoinshrdlu", weights=range(12, 0, -1), k=rng.randrange(2, 9))) for _ in range(3000)]

    def prose(n):
        return " ".join(rng.choices(vocabulary, k=n)).capitalize()[:n]

    def noise(n, word=60):
        return " ".join("".join(rng.choices(string.ascii_letters + string.digits + "+/", k=word)) for _ in range(n // word + 1))[:n]

    good = [prose(n) for n in (80, 100, 150, 220, 600, 1500, 3000, 5000, 7500, 9000, 14000) for _ in range(5)]
    bad = [noise(n, max(3, n // 14)) for n in (80, 100, 150, 220) for _ in range(5)]
    for size, junk in ((1500, 700), (3000, 1400), (6000, 2800), (7000, 2904), (8191, 4095), (8192, 4096), (12000, 5000)):
        for at in (0, (size - junk) // 2, size - junk):
            bad.append(prose(at) + noise(junk) + prose(size - junk - at))
    rows = [(i, t) for i, t in enumerate(good + bad)]
    kept = {r.doc_id for r in good_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == set(range(len(good))), sorted(kept ^ set(range(len(good))))


def test_chunks_and_pieces_reach_the_end():
    assert cut(b"abcdefgh", 3) == [b"abc", b"def", b"fgh"] and cut(b"abcdef", 3) == [b"abc", b"def"] and cut(b"ab", 3) == []
    assert not is_noise("가나다라마바사 아자차카타파하 거너더러머버서 어저처커터퍼허".encode(), 0.9)
