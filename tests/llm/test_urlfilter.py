"""Temporal list join against plain loops."""

import random

from weblode.llm.urlfilter import filter_urls

CAPTURES, CHANGES = "page_id long, url string, fetched_at long, rule string, bucket int", "list string, rule string, verdict string, action string, at long"


def keys(url):
    rest = url.split("://", 1)[1].split("#")[0].split("?")[0]
    host, _, path = rest.partition("/")
    host = host.lower()
    labels = host.split(".")
    return {".".join(labels[i:]) for i in range(len(labels))} | {(host + "/" + path).rstrip("/")}


def brute(captures, changes):
    out = []
    for page_id, url, at in captures:
        active = []
        for name, rule in {(c[0], c[1]) for c in changes if c[0] and c[1] and c[4] is not None and c[3] in ("add", "remove")}:
            past = [c for c in changes if c[:2] == (name, rule) and c[3] in ("add", "remove") and c[4] is not None and at is not None and c[4] <= at]
            if past and url is not None and rule in keys(url):
                last = max(past, key=lambda c: (c[4], c[3] == "add", c[2] or ""))
                if last[3] == "add":
                    active.append((-len(rule), last[2] != "allow", name, rule, last[2]))
        best = min(active, default=None)
        out.append((page_id, url, at, len(active), best and best[3], best and best[2], best and best[4], not best or best[4] != "block"))
    return sorted(out, key=str)


def answer(spark, captures, changes, bucket=1000):
    df = filter_urls(spark.createDataFrame([(*c, "x", 1) for c in captures], CAPTURES), spark.createDataFrame(changes, CHANGES), bucket)
    return sorted(map(tuple, df.collect()), key=str)


def test_against_brute_force(spark):
    rng = random.Random(9)
    hosts = ["example.com", "a.example.com", "B.a.example.com", "other.org", "com"]
    captures = [(i, f"https://{rng.choice(hosts)}/{rng.choice(['', 'p', 'p/', 'q?x=1', 'p/r#t'])}", rng.randrange(-500, 9000)) for i in range(300)]
    rules = ["example.com", "a.example.com", "b.a.example.com", "com", "other.org", "other.org/p", "example.com/p", "example.com/p/r"]
    changes = [(rng.choice(["l1", "l2", "l3"]), rng.choice(rules), rng.choice(["block", "allow"]), rng.choice(["add", "add", "remove"]), rng.randrange(0, 8000, 50)) for _ in range(80)]
    assert answer(spark, captures, changes) == brute(captures, changes)


def test_odd_rows(spark):
    captures = [(1, None, 5), (2, "https://x.org/", None), (None, "https://x.org/", 5), (4, "not a url", 5), (5, "https://x.org/", 5), (5, "https://x.org/", 5), (6, "https://x.org/" + "p" * 20000, 10)]
    changes = [("l", "x.org", "block", "add", 5), ("l", "x.org", "block", "add", 5), ("l", "x.org", "block", "remove", 5), ("l", "x.org", None, "remove", 10),
               (None, "x.org", "block", "add", 1), ("l", None, "block", "add", 1), ("l", "x.org", "block", "other", 1), ("l", "x.org", "block", "add", None)]
    want = [(1, None, 5, 0, None, None, None, True), (2, "https://x.org/", None, 0, None, None, None, True), (None, "https://x.org/", 5, 1, "x.org", "l", "block", False),
            (4, "not a url", 5, 0, None, None, None, True), *[(5, "https://x.org/", 5, 1, "x.org", "l", "block", False)] * 2,
            (6, captures[-1][1], 10, 0, None, None, None, True)]
    assert answer(spark, captures, changes) == sorted(want, key=str)


def test_empty_tables(spark):
    assert answer(spark, [], [("l", "x.org", "block", "add", 5)]) == []
    assert answer(spark, [(1, "https://x.org/", 5)], []) == [(1, "https://x.org/", 5, 0, None, None, None, True)]
