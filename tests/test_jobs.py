"""Crawls, results, admission and streams, most of them against brute force."""

import json
import random

from pyspark.sql import functions as F

from weblode.config import CrawlConfig, Limits, ShallowConfig
from weblode.operators import admission, crawl, results
from weblode.streaming import events, limiter

LINK = ("page_id bigint, page_url string, ord int, url string, key string, category string, is_navigation boolean, source string, "
        "discovery_reason string")


def graph(n=30, seed=3):
    rng = random.Random(seed)
    url = lambda i: f"https://s.example/{i}"
    rows = []
    for i in range(n):
        for k, j in enumerate(rng.sample(range(n + 6), 5)):
            rows.append((i, url(i), k + 1, url(j), url(j), "same_domain", rng.random() < 0.1, "anchor", None))
    return [(i, url(i), "") for i in range(n)], rows


def test_deep_crawl_matches_queue_walk(spark):
    pages, rows = graph()
    cfg = CrawlConfig(max_depth=3, max_pages=11)
    frame = spark.createDataFrame(rows, LINK)
    p = spark.createDataFrame(pages, "page_id bigint, url string, html string")
    got = crawl.deep_crawl(p.select(F.col("page_id").alias("crawl_id"), "url"), p, frame, cfg).filter("claimed")
    got = {(r.crawl_id, r.claim): (r.url, r.depth) for r in got.collect()}
    by_page = {}
    for r in rows:
        by_page.setdefault(r[1], []).append(r)
    want = {}
    for i, root, _ in pages:
        visited, done, level = {root}, 1, [root]
        want[(i, 1)] = (root, 0)
        queue = []
        for depth in range(0, cfg.max_depth + 1):
            if depth:
                claimed = []
                for u in queue:
                    if done >= cfg.max_pages:
                        break
                    done += 1
                    want[(i, done)] = (u, depth)
                    claimed.append(u)
                level = claimed
            queue = []
            for u in level:
                for r in sorted(by_page.get(u, []), key=lambda r: r[2]):
                    if not r[6] and r[4] not in visited:
                        visited.add(r[4])
                        queue.append(r[3])
    assert got == want


def test_shallow_crawl_stops_at_asset_cap(spark):
    pages, rows = graph(20, 8)
    p = spark.createDataFrame(pages, "page_id bigint, url string, html string")
    links = spark.createDataFrame([(r[0], r[3], r[2]) for r in rows], "page_id bigint, url string, pos int")
    assets = [(i, k, f"https://m.example/{(i * 3 + k) % 40}.jpg") for i, _, _ in pages for k in range(4)]
    cfg = ShallowConfig(max_depth=2, max_pages=14, batch=3, max_assets=22)
    scanned, found = crawl.shallow_crawl(
        p.select(F.col("page_id").alias("crawl_id"), "url"), p, links,
        spark.createDataFrame(assets, "page_id bigint, ord int, url string"), cfg)
    got_pages = {r.crawl_id: r.n for r in scanned.groupBy("crawl_id").agg(F.count("*").alias("n")).collect()}
    got = {}
    for r in found.orderBy("crawl_id", "asset_ord").collect():
        got.setdefault(r.crawl_id, []).append(r.url)
    ids = {u: i for i, u, _ in pages}
    for i, root, _ in pages:
        visited, bag, n = {root}, {}, 1
        out = lambda u: [r[3] for r in rows if r[1] == u]
        for a in assets:
            if a[0] == i:
                bag.setdefault(a[2])
        queue = []
        for u in out(root):
            if u not in visited:
                visited.add(u)
                queue.append(u)
        for depth in range(cfg.max_depth):
            nxt, k = [], 0
            while k < len(queue) and len(bag) < cfg.max_assets and cfg.max_pages - n > 0:
                batch = queue[k:min(k + cfg.batch, k + cfg.max_pages - n)]
                n += len(batch)
                for u in batch:
                    if u not in ids:
                        continue
                    for a in assets:
                        if a[0] == ids[u] and len(bag) < cfg.max_assets:
                            bag.setdefault(a[2])
                    if depth + 1 < cfg.max_depth:
                        for v in out(u):
                            if v not in visited:
                                visited.add(v)
                                nxt.append(v)
                k += cfg.batch
            queue = nxt
        assert got_pages[i] == n, i
        assert got[i] == list(bag)[: cfg.max_assets], i


def test_selection_toggles_twice_is_identity(spark):
    keys = ["crawl_id", "url"]
    items = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "crawl_id int, url string")
    chosen = spark.createDataFrame([(1, "a"), (9, "z")], "crawl_id int, url string")
    twice = results.toggle(results.toggle(chosen, items, keys), items, keys)
    assert {tuple(r) for r in twice.collect()} == {(1, "a"), (9, "z")}
    group = results.toggle_group(chosen, items, keys, "crawl_id")
    assert {tuple(r) for r in group.collect()} == {(1, "a"), (1, "b"), (2, "c"), (9, "z")}
    assert {tuple(r) for r in results.toggle_group(group, items, keys, "crawl_id").collect()} == {(9, "z")}


def test_confidence_tiers_nest(spark):
    df = spark.createDataFrame([(0.92,), (0.8,), (0.6,), (None,)], "confidence double")
    tiers = {t: [r[0] for r in df.select(results.confidence_at_least(t)).collect()] for t in ("all", "high", "medium", "low")}
    assert tiers == {"all": [True] * 4, "high": [True, False, False, False], "medium": [True, True, False, False],
                     "low": [True, True, True, False]}


def test_search_folds_case_and_accents(spark):
    df = spark.createDataFrame([("Canção nova",), ("cancao",), ("other",)], "t string")
    assert [r[0] for r in df.select(results.folded_contains(F.col("t"), "CANCAO")).collect()] == [True, True, False]


def test_bundle_names_and_limits(spark):
    names = ["a.jpg", "a.jpg", "a-2.jpg", "a", "a"]
    assets = [(1, i, f"https://m.example/{i}.jpg", n, "jpg") for i, n in enumerate(names)]
    assets += [(2, i, f"https://m.example/{i % 5}.jpg", "x.jpg", "jpg") for i in range(201)] + [(3, 0, "https://m.example/none.jpg", "n.jpg", "jpg")]
    fetches = [(f"https://m.example/{i}.jpg", 200, "image/jpeg", None, 40) for i in range(5)]
    a = spark.createDataFrame(assets, "bundle_id int, ord int, url string, file_name string, extension string")
    f = spark.createDataFrame(fetches, "url string, status int, content_type string, content_length bigint, bytes bigint")
    entries, bundles = admission.bundle_manifest(a, f, Limits(max_bundle_bytes=150))
    assert [(r.name, r.over_limit) for r in entries.orderBy("ord").collect()] == [
        ("a.jpg", False), ("a-2.jpg", False), ("a-2-2.jpg", False), ("a", True), ("a-2", True)]
    assert {r.bundle_id: r.error_code for r in bundles.collect()} == {1: "ZIP_TOO_LARGE", 2: "TOO_MANY_ASSETS", 3: "DOWNLOAD_FAILED"}


def test_redirect_chains(spark):
    hops = [(f"https://a.example/{i}", 302, f"/{i + 1}") for i in range(7)] + [("https://b.example/", 301, None)]
    hops += [("https://c.example/", 307, "http://127.0.0.1/"), ("https://d.example/", 308, "https://d.example/")]
    t = spark.createDataFrame(hops, "url string, status int, location string")
    req = spark.createDataFrame([(u,) for u in ("https://a.example/0", "https://a.example/2", "https://b.example/", "https://c.example/",
                                                "https://d.example/", "https://e.example/")], "url string")
    got = {r.url: (r.resolved_url, r.hops, r.error_code) for r in admission.resolve_redirects(req, t).collect()}
    assert got == {
        "https://a.example/0": (None, 5, "too_many_redirects"), "https://a.example/2": ("https://a.example/7", 5, None),
        "https://b.example/": (None, 0, "missing_location"), "https://c.example/": (None, 0, "private_host"),
        "https://d.example/": (None, 5, "too_many_redirects"), "https://e.example/": ("https://e.example/", 0, None)}


def walk(rows, window, limit):
    """One request after the other, the plain way."""
    state, out = {}, {}
    for client, at, rid in sorted(rows, key=lambda r: (r[1], r[2])):
        count, reset = state.get(client, (0, -1))
        count, reset = (1, at + window) if count == 0 or at > reset else (count + 1, reset)
        state[client] = (count, reset)
        out[rid] = (count > limit, max(0, limit - count), reset)
    return out


LOG = "client string, at_ms bigint, request_id bigint"


def test_rate_limit_edges(spark):
    rows = [("c", 0, i) for i in range(31)] + [("c", 60_000, 31), ("c", 60_001, 32)]
    got = {r.request_id: (r.limited, r.remaining) for r in limiter.rate_limit(spark.createDataFrame(rows, LOG)).collect()}
    assert got[29] == (False, 0) and got[30] == (True, 0) and got[31] == (True, 0) and got[32] == (False, 29)


def test_rate_limit_matches_plain_walk(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["hot", "hot", "hot", "a", "b", "c"]), rng.randint(0, 400_000), i) for i in range(3000)]
    df = spark.createDataFrame(rows, LOG)
    for window, limit in ((1_000, 3), (50, 1), (20_000, 10)):
        got = {r.request_id: (r.limited, r.remaining, r.reset_ms) for r in limiter.rate_limit(df, window, limit, 30_000).collect()}
        assert got == walk(rows, window, limit)


def test_rate_limit_of_busy_clients(spark):
    """Half of the log is one client without a pause; another asks every half window; chunks are judged apart."""
    rng = random.Random(3)
    rows = [("busy", rng.randint(0, 3_000_000), i) for i in range(6000)] + [("even", 30_000 * i, 10_000 + i) for i in range(4000)]
    rows += [(None, rng.randint(0, 500_000), 20_000 + i) for i in range(500)] + [(f"s{i}", 7_000_000 + i, 30_000 + i) for i in range(300)] + [("busy", None, 40_000)]
    df = spark.createDataFrame(rows, LOG)
    want = walk([(c or "unknown", t, i) for c, t, i in rows if t is not None], 60_000, 5)
    for chunk in (60_000, 100_000, None):
        got = {r.request_id: (r.limited, r.remaining, r.reset_ms) for r in limiter.rate_limit(df, 60_000, 5, chunk).collect()}
        assert got == want
    assert limiter.rate_limit(df.limit(0)).collect() == []
    ticks = df.filter("client = 'even'").selectExpr("client", "at_ms", "floor(at_ms / 960000) AS chunk").distinct()
    assert limiter._functions(ticks, 60_000, 960_000).selectExpr("max(size(starts))").first()[0] <= 3


def test_rate_limit_tasks_take_many_clients_at_once():
    """A client with a request or two costs no batch of its own; a group that spans batches is still one group."""
    import pyarrow as pa

    n = 5000
    ticks = pa.RecordBatch.from_pydict({"client": [f"c{i:05}" for i in range(n - 4)] + ["z"] * 4, "chunk": [0] * n, "at_ms": [*range(n - 4), 10, 20, 900, 2000]})
    made = list(limiter._describer(1_000, 16_000)(iter([ticks.slice(0, n - 2), ticks.slice(n - 2)])))
    assert len(made) <= 3 and sum(b.num_rows for b in made) == n - 3
    assert made[-1].to_pylist()[-1] == {"client": "z", "block": 0, "starts": [2000], "resets": [3000]}
    placed = pa.RecordBatch.from_pydict({
        "client": ["a", "a", "b", "b", "b"], "at_ms": [5, 1_200, 7, 8, 3_000], "request_id": [1, 2, 3, None, 5], "chunk": [0] * 5,
        "carried": [10, 10, limiter.NEVER, limiter.NEVER, limiter.NEVER], "before": [4, 4, 0, 0, 0]})
    rows = [tuple(r.values()) for b in limiter._judge(1_000, 2)(iter([placed.slice(0, 4), placed.slice(4)])) for r in b.to_pylist()]
    assert rows == [("a", 5, 1, True, 0, 10), ("a", 1_200, 2, False, 1, 2_200), ("b", 7, 3, False, 1, 1_007), ("b", 8, None, False, 0, 1_007), ("b", 3_000, 5, False, 1, 4_000)]


def feed(spark, folder, schema, batches):
    """A stream that takes one of ``batches`` at a time, in order."""
    import os

    folder.mkdir()
    for k, rows in enumerate(batches):
        path = folder / f"{k}.json"
        path.write_text("".join(json.dumps(r) + "\n" for r in rows))
        os.utime(path, (1_700_000_000 + k, 1_700_000_000 + k))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(folder))


def run_stream(stream, name, checkpoint):
    query = stream.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def test_rate_limit_stream_equals_table_and_forgets(spark, tmp_path):
    rng = random.Random(2)
    rows = sorted([(rng.choice("xyz"), rng.randint(0, 90_000), i) for i in range(300)], key=lambda r: r[1]) + [("w", 900_000, 1000), ("w", 900_001, 1001)]
    named = [dict(zip(("client", "at_ms", "request_id"), r)) for r in rows]
    stream = feed(spark, tmp_path / "in", LOG, [named[:150], named[150:300], named[300:301], named[301:]])
    query = run_stream(limiter.rate_limit_stream(stream, 5_000, 4, late="1 second"), "verdicts", tmp_path / "cp")
    assert {r.request_id: (r.limited, r.remaining, r.reset_ms) for r in spark.table("verdicts").collect()} == walk(rows, 5_000, 4)
    assert sum(o.numRowsRemoved for p in query.recentProgress for o in p.stateOperators) >= 3
    state = spark.read.format("statestore").option("stateVarName", "bucket").load(str(tmp_path / "cp"))
    assert [(r.key.client, r.value["count"]) for r in state.collect()] == [("w", 2)]  # x, y and z are forgotten


U = "https://e.example/"
ITEM = {"url": U, "type": "video", "platform": None, "videoId": None, "title": None, "thumbnailUrl": None, "canonicalUrl": None, "contentKind": None,
        "confidence": 0.9, "duration": None, "source": "x", "downloadable": True, "discoveredFrom": None, "discoveryReason": None}
PAGE = {"url": U, "depth": 0, "title": None, "media": [ITEM], "error": None, "possibleSpa": False, "pageKind": "hub", "discoveredFrom": None, "discoveryReason": None}
DONE = {"originalUrl": U, "totalPages": 3, "pagesWithErrors": 0, "totalMedia": 1, "results": [PAGE], "crawlDurationMs": 3.5}


def sample_events():
    rows = [(1, "crawl_started", {"url": U, "config": {}}), (1, "page_processing", {"url": U, "depth": 0, "pagesDone": 1, "pagesTotal": 4}),
            (1, "media_found", {"pageUrl": U, "media": ITEM}), (1, "media_found", {"pageUrl": U, "media": {**ITEM, "type": "sound"}}),
            (1, "page_processing", {"url": U, "depth": 1, "pagesDone": 3, "pagesTotal": 4}),
            (2, "crawl_started", {"url": U, "config": {"maxDepth": 1}}), (2, "crawl_error", {"error": "boom"}),
            (1, "page_discovered", {"url": U, "category": "external", "depth": 1, "source": "onclick", "fromUrl": U,
                                    "discoveryReason": "player-config"}), (1, "crawl_complete", DONE)]
    return [(c, f"2024-01-01 00:00:{i:02d}", e, json.dumps(d)) for i, (c, e, d) in enumerate(rows)]


def test_event_schemas(spark):
    """Each case and what is wrong with it: JSON types are strict, missing is not null, nested lists are looked into."""
    without = lambda d, k: {n: v for n, v in d.items() if n != k}
    cases = [
        ("crawl_started", {"url": U}, "config: not an object"), ("crawl_started", {"url": U, "config": {}}, None),
        ("crawl_started", {"url": U, "config": {"maxDepth": 4}}, "config.maxDepth: too large"), ("crawl_started", {"url": U, "config": {"maxDepth": 1.5}}, "config.maxDepth: not whole"),
        ("crawl_started", {"url": U, "config": {"maxDepth": 2.0}}, None), ("crawl_started", {"url": U, "config": {"followExternal": None}}, "config.followExternal: not a boolean"),
        ("crawl_started", {"url": U, "config": {"requestTimeout": 4999}}, "config.requestTimeout: too small"),
        ("media_found", {"pageUrl": U, "media": ITEM}, None), ("media_found", {"pageUrl": U, "media": {**ITEM, "source": ""}}, "media.source: too short"),
        ("media_found", {"pageUrl": U, "media": without(ITEM, "title")}, "media.title: not a text"), ("media_found", {"media": ITEM}, "pageUrl: not a text"),
        ("media_found", {"pageUrl": U, "media": {**ITEM, "canonicalUrl": "http://[::1]/"}}, "media.canonicalUrl: private host"),
        ("crawl_complete", DONE, None), ("crawl_complete", without(DONE, "results"), "results: not a list"), ("crawl_complete", {**DONE, "results": []}, None),
        ("crawl_complete", {**DONE, "results": [PAGE, {**PAGE, "media": [ITEM, {**ITEM, "confidence": "0.5"}]}]}, "results[1].media[1].confidence: not a number"),
        ("crawl_complete", {**DONE, "results": [PAGE, {**PAGE, "media": [ITEM, {**ITEM, "url": "http://10.1.1.1/"}]}]}, "results[1].media[1].url: private host"),
        ("crawl_complete", {**DONE, "totalPages": "1"}, "totalPages: not a number"), ("crawl_complete", {**DONE, "totalMedia": -1}, "totalMedia: too small"),
        ("page_error", {"url": "e.example.com/x", "error": "x", "depth": 0, "more": 1}, None), ("page_error", {"url": "ftp://e.example/", "error": "x", "depth": 0}, "url: not http"),
        ("page_error", {"url": U, "error": "x", "depth": True}, "depth: not a number"), ("page_error", 3, ": not an object"), ("page_error", None, ": not an object"),
        ("crawl_error", {"error": ""}, "error: too short"), ("other", {}, "unknown event"), ("page_discovered", {
            "url": U, "category": "none", "depth": 0, "source": "anchor", "fromUrl": U, "discoveryReason": None}, "category: not one of its values")]
    rows = [(i, None, e, json.dumps(d)) for i, (e, d, _) in enumerate(cases)] + [(98, None, "page_error", "{x"), (99, None, "page_error", None)]
    got = {r.crawl_id: (r.reason, r.valid) for r in events.parse_events(spark.createDataFrame(rows, "crawl_id long, ts timestamp, event string, data string")).collect()}
    assert got == {**{i: (w, w is None) for i, (_, _, w) in enumerate(cases)}, 98: ("not JSON", False), 99: ("not JSON", False)}


def test_events_stream_equals_table(spark, tmp_path):
    df = spark.createDataFrame(sample_events(), "crawl_id bigint, ts string, event string, data string").withColumn(
        "ts", F.to_timestamp("ts"))
    df.repartition(3).write.json(str(tmp_path / "log"))
    progress = {r.crawl_id: tuple(r)[1:] for r in events.crawl_progress(df).collect()}
    assert progress == {1: (3, 4, 1, 75), 2: (0, 0, 0, 0)}
    status = {r.crawl_id: (r.status, r.total_pages, r.error) for r in events.crawl_status(df).collect()}
    assert status == {1: ("complete", 3, None), 2: ("error", None, "boom")}
    stream = events.read_crawl_events(spark, str(tmp_path / "log"), 1)
    query = (events.crawl_progress(stream).writeStream.format("memory").queryName("progress").outputMode("complete")
             .trigger(availableNow=True).start())
    query.awaitTermination()
    assert {r.crawl_id: tuple(r)[1:] for r in spark.table("progress").collect()} == progress
    log = events.activity_log(df)
    want = sorted(map(tuple, events.activity_tail(log, 3).drop("recent").collect()))
    changes = run_stream(events.tail_changes(events.read_crawl_events(spark, str(tmp_path / "log"), 1), 3), "changes", tmp_path / "cp")
    tail = events.current_tail(spark.table("changes"))
    assert sorted(map(tuple, tail.collect())) == want and changes.lastProgress is not None
    assert "Página descoberta via onclick (depth 1) • configuração de player" in [r.message for r in tail.collect()]


def test_tail_changes_are_appended_and_idle_crawls_forgotten(spark, tmp_path):
    def event(crawl, second, url):
        return {"crawl_id": crawl, "ts": f"2024-01-01T00:00:{second:02d}", "event": "page_error", "data": json.dumps({"url": f"https://e.example/{url}", "error": "x", "depth": 0})}

    batches = [[event(1, 1, "a"), event(1, 2, "b"), event(1, 2, "b"), event(2, 1, "z")], [event(1, 5, "c")], [event(1, 0, "old")], [event(1, 50, "d")], [event(1, 51, "e")]]
    stream = events.tail_changes(feed(spark, tmp_path / "in", events.EVENTS, batches), 2, idle_ms=10_000, late="0 seconds")
    run_stream(stream, "idle", tmp_path / "cp")
    got = [(r.crawl_id, r.url[-1], r.change) for r in spark.table("idle").collect()]
    assert sorted(got) == sorted([(1, "b", "in"), (1, "b", "in"), (2, "z", "in"), (1, "c", "in"), (1, "b", "out"), (1, "d", "in"), (1, "b", "out"), (1, "e", "in"), (1, "c", "out")])
    assert sorted((r.crawl_id, r.url[-1]) for r in events.current_tail(spark.table("idle")).collect()) == [(1, "d"), (1, "e"), (2, "z")]
    state = spark.read.format("statestore").option("stateVarName", "tail").load(str(tmp_path / "cp"))
    assert {r.key.crawl_id for r in state.collect()} == {1}


def test_payloads_are_parsed_once(spark):
    rows = spark.range(1).selectExpr("id AS crawl_id", "timestamp'2024-01-01' AS ts", "concat('page_', id) AS event", "concat('{', id) AS data")
    plan = events.parse_events(rows)._jdf.queryExecution().optimizedPlan().toString().lower()
    assert plan.count("parsejson") + plan.count("parse_json") == 1


def test_members_of_events_are_read_in_one_pass(spark):
    from weblode.plans.workloads import _members

    data = json.dumps({"url": "u\"é", "pagesDone": 3, "error": None, "media": {"url": "m", "platform": None}, "config": {"maxPages": 50, "followExternal": True},
                       "results": [{"url": "r", "pageKind": "hub", "mediaCount": 2}, {"url": "s"}]})
    log = spark.createDataFrame([(1, data), (2, '{"url":"v","results":[]}'), (3, "{}")], "crawl_id long, data string").selectExpr(
        "crawl_id", "named_struct('depth', 1) AS seq", "'e' AS event", "data")
    paths = ["url", "pagesDone", "error", "media.url", "media.platform", "config.maxPages", "config.followExternal", "results[0].url", "results[0].mediaCount", "totalMedia"]
    df = _members(log, {f"f{i}": path for i, path in enumerate(paths)}, "depth")
    assert df._jdf.queryExecution().optimizedPlan().toString().count("from_json(") == 1
    want = log.select("crawl_id", "seq.depth", "event", *[F.get_json_object("data", f"$.{path}") for path in paths])
    assert sorted(map(tuple, df.collect())) == sorted(map(tuple, want.collect()))
