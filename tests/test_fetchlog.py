"""Fetch outcomes and crawls over a log, against literal cases and a hop-by-hop walk."""

import random
from urllib.parse import urljoin

from pyspark.sql import functions as F

from weblode.config import CrawlConfig
from weblode.functions.skew import looked_up
from weblode.operators.crawl import classify_pages, crawl_summary, crawled_pages, emit_crawl_events, link_stats, MEDIA
from weblode.operators.fetchlog import deep_crawl_logged, fetch_outcomes

LOG = "url string, attempt int, status int, location string, content_type string, content_length long, body_chars int, error string, at_ms long, note string"


def ok(url, attempt=1, **more):
    return row(url, attempt, 200, **more)


def row(url, attempt=1, status=None, location=None, kind="text/html", length=None, chars=10, error=None, at=0):
    return (url, attempt, status, location, kind, length, chars, error, at, "x")


def outcomes(spark, rows):
    got = fetch_outcomes(spark.createDataFrame(rows, LOG))
    return {r.url: r for r in got.collect()}


def test_classes(spark):
    b = "https://a.example/"
    log = [ok(b + "ok#frag"), row(b + "401", status=401), row(b + "404", status=404), row(b + "429", status=429), row(b + "png", status=200, kind="image/png"),
           row(b + "big", status=200, chars=5 * 1024 * 1024 + 1), row(b + "long", status=200, length=6_000_000), row(b + "none"),
           row(b + "slow", error="AbortError: x"), row(b + "blk", error="Blocked"), row(b + "dns", error="getaddrinfo ENOTFOUND"), row(b + "odd", error="?"),
           row(b + "503", status=503), row(b + "503b", status=503), ok(b + "503b", 2), row(b + "503c", status=503), row(b + "503c", 2, status=403),
           ok(b + "two", 2), row(b + "nokind", status=200, kind=None), row(None, status=200), ok(b + "twice"), ok(b + "twice")]
    got = outcomes(spark, log)
    want = {"ok": None, "401": "auth_required", "404": "unknown_error", "429": "rate_limited", "png": "not_html", "big": "too_large", "long": "too_large",
            "none": "unreachable", "slow": "timeout", "blk": "blocked", "dns": "unreachable", "odd": "unknown_error", "503": "server_error", "503b": None,
            "503c": "auth_required", "two": None, "nokind": "not_html", "twice": None}
    assert {u[len(b):]: r.error for u, r in got.items()} == want
    assert {u[len(b):] for u, r in got.items() if r.attempt == 2} == {"503", "503b", "503c", "two"}


def test_redirects(spark):
    b = "https://a.example/d/"
    log = [row(b + "r", status=301, location="../x?y#z"), ok("https://a.example/x?y"), row(b + "gone", status=302, location="/nowhere"),
           row(b + "empty", status=302, location=""), row(b + "mail", status=302, location="mailto:a@b.c"), row(b + "in", status=307, location="//10.0.0.1/"),
           row(b + "loop", status=308, location="loop"), row(b + "five0", status=301, location="five1"), row(b + "304", status=304, location="x"),
           row(b + "again", status=301, location="flaky"), row(b + "flaky", status=502), row(b + "flaky", 2, status=303, location="../x?y")]
    log += [row(f"{b}five{i}", status=301, location=f"five{i + 1}") for i in range(1, 6)]
    log += [row(f"{b}five6", status=301, location=None)]
    got = {u[len(b):]: (r.final_url, r.hops, r.error, r.fault, r.attempt) for u, r in outcomes(spark, log).items() if u.startswith(b)}
    x = "https://a.example/x?y"
    assert got["r"] == (x, 1, None, None, 1) and got["again"] == (x, 2, None, None, 2) and got["flaky"] == (x, 1, None, None, 2)
    assert got["gone"] == ("https://a.example/nowhere", 1, "unreachable", None, 1) and got["304"][2:] == ("unknown_error", None, 1)
    assert [got[k][2:4] for k in ("empty", "mail", "in", "loop")] == [
        ("unknown_error", f) for f in ("missing_location", "invalid_url", "private_host", "too_many_redirects")]
    # the sixth redirect ends the chase before its own fault is seen
    assert got["five6"][3] == "missing_location" and got["five2"][3] == "missing_location" and got["five1"][3] == got["five0"][3] == "too_many_redirects"


def test_against_a_walk(spark):
    rng = random.Random(2)
    names = [f"https://h{i % 5}.example/{i}" for i in range(120)]
    log = [row(n, status=rng.choice([200, 301, 302, 302]), location=rng.choice([rng.choice(names), f"/{rng.randrange(130)}"])) for n in names]
    by = {r[0]: r for r in log}

    def walk(url):
        for hops in range(6):
            r = by.get(url)
            if r is None or r[2] == 200:
                return url, hops, None if r else "unreachable"
            if hops < 5:
                url = urljoin(url, r[3])
        return None, 5, "unknown_error"

    assert {u: (r.final_url, r.hops, r.error) for u, r in outcomes(spark, log).items()} == {n: walk(n) for n in names}


def test_crawl(spark):
    h = "https://s.example/"
    pages = spark.createDataFrame([(1, h), (2, h + "b"), (3, h + "c"), (4, h + "d")], "page_id long, url string")
    edge = lambda f, o, u: (f, h, o, h + u, h + u, "same_domain", "anchor", False, "content-hub", False)
    links = spark.createDataFrame([edge(1, 1, "old"), edge(1, 2, "b"), edge(1, 3, "bad"), edge(1, 4, "lost"), edge(2, 1, "c"), edge(2, 2, "d"), edge(3, 1, "d"), edge(4, 1, "old")],
                                  "page_id long, page_url string, ord long, url string, key string, category string, source string, is_navigation boolean, "
                                  "discovery_reason string, interactive boolean")
    log = spark.createDataFrame([ok(h, at=100), row(h + "old", status=301, location="/c"), ok(h + "c", at=300), row(h + "b", status=500), ok(h + "b", 2, at=900),
                                 row(h + "bad", status=429, at=200), ok(h + "d", at=400)], LOG)
    seeds = spark.createDataFrame([("k", h), ("n", None)], "crawl_id string, url string")
    run = lambda **how: deep_crawl_logged(seeds.filter("url is not null"), pages, links, log, CrawlConfig(), **how)
    found = run()
    got = {r.url[len(h):]: (r.depth, r.claim, r.page_id, r.error, r.attempt) for r in found.collect()}
    assert got == {"": (0, 1, 1, None, 1), "old": (1, 2, 3, None, 1), "b": (1, 3, 2, None, 2), "bad": (1, 4, None, "rate_limited", 1),
                   "lost": (1, 5, None, "unreachable", None), "d": (2, 6, 4, None, 1)}
    loose = {r.url[len(h):] for r in run(mark_targets=False).collect()}
    assert loose == {*got, "c"}
    facts = spark.createDataFrame([(i, f"t{i}", 900) for i in (1, 2, 3, 4)], "page_id long, title string, text_length int")
    results = classify_pages(crawled_pages(found), found.select("crawl_id", "page_id", "claim").limit(0), link_stats(links), facts)
    kinds = {r.url[len(h):]: (r.page_kind, r.error, r.title) for r in results.collect()}
    assert kinds[""] == ("hub", None, "t1") and kinds["bad"] == ("unknown", "rate_limited", None) and kinds["lost"] == ("unknown", "unreachable", None)
    total = crawl_summary(results).collect()
    assert [(r.pages_crawled, r.pages_with_errors, r.duration_ms) for r in total] == [(6, 2, 800)]
    nothing = found.select("crawl_id", "depth", "claim", F.lit(1).alias("ord"), F.col("url").alias("page_url"), *[F.lit(None).cast("string").alias(m) for m in MEDIA]).limit(0)
    events = {(r.event, r.error, r.duration) for r in emit_crawl_events(found, results, nothing).select(
        "event", F.get_json_object("data", "$.error").alias("error"), F.get_json_object("data", "$.crawlDurationMs").alias("duration")).collect()}
    assert {("page_error", "rate_limited", None), ("page_error", "unreachable", None), ("crawl_complete", None, "800")} <= events


def test_empty_tables(spark):
    pages = spark.createDataFrame([], "page_id long, url string")
    links = spark.createDataFrame([], "page_id long, page_url string, ord long, url string, key string, category string, source string, is_navigation boolean, discovery_reason string")
    log = spark.createDataFrame([], LOG)
    assert fetch_outcomes(log).collect() == []
    assert deep_crawl_logged(spark.createDataFrame([], "crawl_id long, url string"), pages, links, log).collect() == []
    alone = deep_crawl_logged(spark.createDataFrame([(1, "https://s.example/")], "crawl_id long, url string"), pages, links, log).collect()
    assert [(r.claimed, r.error, r.page_id) for r in alone] == [(True, "unreachable", None)]


def test_look_up_of_a_heavy_key(spark):
    rows = spark.createDataFrame([(None if i % 7 == 0 else "hot" if i % 2 else f"k{i}", i) for i in range(8000)], "k string, i long")
    table = spark.createDataFrame([("hot", 1), ("k2", 2), ("other", 3)], "k string, v long")
    got = looked_up(rows, table, ["k"])
    want = rows.join(table, "k", "left")
    assert got.columns == want.columns and got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
