"""Inputs of the registered queries, derived from the supplied tables by portable SQL.

Each text runs unchanged in Spark SQL and in an ANSI engine ({table} stands for a supplied table), so both
sides of a check start from identical rows. All of them read whole tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weblode.plans.enrich import markup_sql

TABLES = ["pages", "documents", "events", "orders", "customer"]


def _case(expr: str, *values: str, other: str = "NULL") -> str:
    return f"CASE {expr} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + f" ELSE {other} END"


BASES: dict[str, str] = {
    "enriched": f"SELECT page_id, url, {markup_sql()} AS html FROM {{pages}}",
    # page results and media rows of crawls of 50 pages: more data is more crawls, not larger ones
    "page_results": """
        SELECT CAST(floor(page_id / 50) AS BIGINT) AS crawl_id, page_id % 50 + 1 AS claim, url,
               CAST(page_id % 3 AS INT) AS depth, page_id,
               CASE WHEN page_id % 5 = 0 THEN NULL ELSE 'Página ' || CAST(page_id AS STRING) END AS title,
               CASE WHEN page_id % 3 = 0 THEN NULL ELSE 'https://seed.example.com/' || CAST(CAST(floor(page_id / 50) AS BIGINT) AS STRING) END
                 AS discovered_from,
               CASE WHEN page_id % 3 = 0 THEN NULL WHEN page_id % 3 = 1 THEN 'content-hub' ELSE 'onclick-navigation' END
                 AS discovery_reason,
               CASE page_id % 4 WHEN 0 THEN 'media' WHEN 1 THEN 'hub' WHEN 2 THEN 'landing' ELSE 'unknown' END AS page_kind,
               CASE WHEN page_id % 13 = 0 THEN 'timeout' END AS error
        FROM {pages}""",
    "media": f"""
        SELECT CAST(floor(doc_id / 200) AS BIGINT) AS crawl_id, doc_id % 10 + 1 AS claim,
               CAST(floor(doc_id % 200 / 10) AS BIGINT) + 1 AS ord,
               'https://m' || CAST(doc_id % 7 AS STRING) || '.example.com/f/' || CAST(doc_id AS STRING) ||
                 {_case('doc_id % 4', "'.mp4'", "'.jpg?w=1'", "'.png'", other="''")} AS url,
               CASE WHEN doc_id % 4 IN (0, 3) THEN 'video' ELSE 'image' END AS type,
               {_case('doc_id % 6', "'youtube'", "'vimeo'", "'direct'", "'peertube'")} AS platform,
               CASE WHEN doc_id % 2 = 0 THEN 'id' || CAST(doc_id AS STRING) END AS video_id,
               CASE WHEN doc_id % 9 = 0 THEN NULL ELSE text END AS title,
               CASE WHEN doc_id % 10 = 1 THEN 'https://t.example.com/' || CAST(doc_id AS STRING) || '.jpg' END AS thumbnail_url,
               CASE WHEN doc_id % 10 < 5 THEN 'https://c.example.com/' || CAST(doc_id AS STRING) END AS canonical_url,
               {_case('doc_id % 5', "'video'", "'live'", "'short'", "'playlist'")} AS content_kind,
               CASE WHEN doc_id % 11 = 0 THEN NULL ELSE CAST(40 + n_chars % 60 AS DOUBLE) / 100 END AS confidence,
               {_case('doc_id % 3', "'img[src]'", "'iframe'", other="'link'")} AS source,
               doc_id % 3 <> 0 AS downloadable,
               {_case('doc_id % 3', "'dom-extracted-asset'", "'content-hub'", other="'player-config'")} AS discovery_reason
        FROM {{documents}}""",
    "selected": """
        SELECT CAST(floor(doc_id / 200) AS BIGINT) AS crawl_id,
               'https://m' || CAST(doc_id % 7 AS STRING) || '.example.com/f/' || CAST(doc_id AS STRING) || '.png' AS url
        FROM {documents} WHERE doc_id % 23 < 11""",
    # a link graph over the captured pages: three links each, one of them off the table
    "link_graph": """
        SELECT p.page_id, p.url AS page_url, CAST(1 AS BIGINT) AS ord, t.url, 'same_domain' AS category, 'anchor' AS source,
               p.page_id % 17 = 0 AS is_navigation, 'content-hub' AS discovery_reason
        FROM {pages} p JOIN {pages} t ON t.page_id = p.page_id - p.page_id % 50 + (p.page_id + 1) % 50
        UNION ALL
        SELECT p.page_id, p.url, CAST(2 AS BIGINT), t.url, 'external', 'anchor', 1 = 0, CAST(NULL AS STRING)
        FROM {pages} p JOIN {pages} t ON t.page_id = p.page_id - p.page_id % 50
        UNION ALL
        SELECT p.page_id, p.url, CAST(3 AS BIGINT), 'https://gone.example.com/' || CAST(p.page_id % 50 AS STRING), 'subdomain',
               'button', 1 = 0, 'interactive-destination' FROM {pages} p
        UNION ALL
        SELECT p.page_id, p.url, CAST(4 AS BIGINT), t.url, 'external', 'anchor', 1 = 0, CAST(NULL AS STRING)
        FROM {pages} p JOIN {pages} t ON t.page_id = p.page_id - p.page_id % 50 + (2 * p.page_id) % 50""",
    # what a crawler of these pages would have logged: redirects of up to seven hops, loops and faults, retries, every class of error
    "crawl_fetches": f"""
        SELECT regexp_replace(p.url, '#.*', '') AS url, 1 AS attempt,
               CAST(CASE WHEN p.page_id % 29 IN (19, 20, 21, 22) THEN NULL WHEN p.page_id % 29 IN (1, 10, 12, 14, 16, 23, 26) THEN 301
                         WHEN p.page_id % 29 IN (2, 11, 13, 15, 24, 25) THEN 302 WHEN p.page_id % 29 = 4 THEN 404 WHEN p.page_id % 29 = 5 THEN 403
                         WHEN p.page_id % 29 = 6 THEN 429 WHEN p.page_id % 29 IN (7, 28) THEN 503 WHEN p.page_id % 29 = 8 THEN 500 ELSE 200 END AS INT) AS status,
               CASE WHEN p.page_id % 29 IN (1, 2, 10, 11, 12, 13, 14, 15, 16) THEN t.url WHEN p.page_id % 29 = 24 THEN 'https://10.0.0.9/x'
                    WHEN p.page_id % 29 = 25 THEN 'mailto:a@example.com' WHEN p.page_id % 29 = 26 THEN p.url END AS location,
               CASE WHEN p.page_id % 29 = 9 THEN 'image/png' WHEN p.page_id % 2 = 0 THEN 'application/xhtml+xml' ELSE 'text/html; charset=utf-8' END AS content_type,
               CAST(CASE WHEN p.page_id % 29 = 18 THEN 6000000 END AS BIGINT) AS content_length, CAST(length(p.html) AS INT) AS body_chars,
               CASE p.page_id % 29 WHEN 19 THEN 'The operation was aborted due to timeout' WHEN 20 THEN 'Blocked: private IP'
                    WHEN 21 THEN 'getaddrinfo ENOTFOUND' WHEN 22 THEN 'odd failure' END AS error,
               CAST(1700000000000 + p.page_id * 250 AS BIGINT) AS at_ms
        FROM {{pages}} p JOIN {{pages}} t ON t.page_id = p.page_id - p.page_id % 50 + (p.page_id + 1) % 50 WHERE p.page_id % 29 <> 27
        UNION ALL
        SELECT regexp_replace(p.url, '#.*', ''), 2, CAST(CASE p.page_id % 29 WHEN 7 THEN 200 WHEN 8 THEN 502 ELSE 302 END AS INT),
               CASE WHEN p.page_id % 29 = 28 THEN t.url END, 'text/html', CAST(NULL AS BIGINT), CAST(length(p.html) AS INT), CAST(NULL AS STRING),
               CAST(1700000002000 + p.page_id * 250 AS BIGINT)
        FROM {{pages}} p JOIN {{pages}} t ON t.page_id = p.page_id - p.page_id % 50 + (p.page_id + 1) % 50 WHERE p.page_id % 29 IN (7, 8, 28)""",
    # logs
    "page_fetches": f"""
        SELECT 'https://h' || CAST(o_custkey % 40 AS STRING) || '.example.com/' || CAST(o_orderkey AS STRING) AS url,
               1 AS attempt,
               CAST({_case('o_orderkey % 9', '200', '200', '200', '404', '403', '429', '503', '500', other='200')} AS INT) AS status,
               {_case('o_orderkey % 5', "'text/html; charset=utf-8'", "'application/xhtml+xml'", "'image/png'", other="'text/html'")}
                 AS content_type,
               CASE WHEN o_orderkey % 10 = 7 THEN CAST(6000000 + o_orderkey % 2 * 6000000 AS BIGINT) END AS content_length,
               CASE WHEN o_orderkey % 12 = 5 THEN '' ELSE '<p>' || o_orderstatus || '</p>' END AS body,
               CASE WHEN o_orderkey % 31 = 3 THEN 'The operation was aborted due to timeout'
                    WHEN o_orderkey % 31 = 4 THEN 'getaddrinfo ENOTFOUND' WHEN o_orderkey % 31 = 5 THEN 'Blocked: private IP'
                    WHEN o_orderkey % 31 = 6 THEN 'odd failure' END AS error
        FROM {{orders}}
        UNION ALL
        SELECT 'https://h' || CAST(o_custkey % 40 AS STRING) || '.example.com/' || CAST(o_orderkey AS STRING) AS url,
               2 AS attempt, CAST(CASE WHEN o_orderkey % 2 = 0 THEN 200 ELSE 502 END AS INT), 'text/html',
               CAST(NULL AS BIGINT), '<p>again</p>', CAST(NULL AS STRING)
        FROM {{orders}} WHERE o_orderkey % 4 <> 1""",
    # captured bodies with what came with them; some pages show an image at a private address
    "page_bodies": f"""
        SELECT page_id, url, CAST(CASE WHEN page_id % 17 = 3 THEN 404 WHEN page_id % 17 = 4 THEN 503 WHEN page_id % 17 = 5 THEN NULL ELSE 200 END AS INT) AS status,
               CASE WHEN page_id % 19 = 2 THEN 'application/pdf' WHEN page_id % 19 = 3 THEN NULL ELSE 'text/html; charset=utf-8' END AS content_type,
               CAST(CASE WHEN page_id % 23 = 7 THEN 11000000 WHEN page_id % 23 = 8 THEN 900 END AS BIGINT) AS content_length,
               CASE WHEN page_id % 29 = 11 THEN '' WHEN page_id % 29 = 12 THEN NULL ELSE {markup_sql()}
                 || CASE WHEN page_id % 9 = 0 THEN '<img src="https://10.0.0.7/p.jpg">' ELSE '' END END AS body,
               CASE WHEN page_id % 17 = 5 THEN 'network down' END AS error
        FROM {{pages}}""",
    "redirects": """
        SELECT 'https://r.example.com/' || CAST(o_orderkey AS STRING) AS url,
               CAST(CASE WHEN o_orderkey % 16 = 0 THEN 200 WHEN o_orderkey % 2 = 0 THEN 301 ELSE 302 END AS INT) AS status,
               CASE WHEN o_orderkey % 37 = 1 THEN NULL WHEN o_orderkey % 41 = 2 THEN 'https://10.0.0.9/x'
                    WHEN o_orderkey % 43 = 3 THEN 'mailto:a@example.com' ELSE '/' || CAST(o_orderkey + 1 AS STRING) END AS location
        FROM {orders}""",
    "hosts": """
        SELECT 'https://h' || CAST(o_custkey % 400 AS STRING) || CASE WHEN o_orderkey % 3 = 0 THEN '.example.com/a'
                 WHEN o_orderkey % 3 = 1 THEN '.example.org:8080/' ELSE '.example.net' END AS url, o_orderkey AS id
        FROM {orders}
        UNION ALL SELECT 'http://192.168.1.' || CAST(o_orderkey % 250 AS STRING) || '/x', o_orderkey FROM {orders}
        WHERE o_orderkey % 50 = 0""",
    "asset_fetches": f"""
        SELECT o_orderkey AS id,
               'https://a.example.com/f/' || CAST(o_orderkey AS STRING) ||
                 {_case('o_orderkey % 6', "'.jpg'", "'.mp4'", "'.php'", "''", other="'.png'")} AS url,
               CAST(CASE WHEN o_orderkey % 19 = 3 THEN 404 ELSE 200 END AS INT) AS status,
               {_case('o_orderkey % 7', "'image/jpeg'", "'video/mp4'", "'text/html'", other="'application/octet-stream'")} AS content_type,
               CASE WHEN o_orderkey % 5 = 0 THEN CAST(floor(o_totalprice * 1000) AS BIGINT) END AS content_length,
               CASE WHEN o_orderkey % 23 = 4 THEN NULL ELSE CAST(floor(o_totalprice * 400) AS BIGINT) END AS bytes,
               CASE WHEN o_orderkey % 8 = 1 THEN 'attachment; filename="clip ' || CAST(o_orderkey % 30 AS STRING) || '.mp4"' END
                 AS disposition
        FROM {{orders}}""",
    "bundle_assets": """
        SELECT CAST(floor(o_orderkey / 150) AS BIGINT) - CASE WHEN CAST(floor(o_orderkey / 150) AS BIGINT) % 7 = 1 THEN 1 ELSE 0 END AS bundle_id, o_orderkey AS ord,
               'https://a.example.com/f/' || CAST(o_orderkey AS STRING) || CASE o_orderkey % 6 WHEN 0 THEN '.jpg' WHEN 1 THEN '.mp4'
                 WHEN 2 THEN '.php' WHEN 3 THEN '' ELSE '.png' END AS url,
               CASE WHEN o_orderkey % 29 = 0 THEN '' WHEN o_orderkey % 5 = 4 THEN 'clip-2.mp4'
                    ELSE 'clip' || CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE CAST(o_orderkey % 4 AS STRING) END || '.mp4' END AS file_name,
               CASE WHEN o_orderkey % 17 = 0 THEN 'exe' ELSE 'mp4' END AS extension
        FROM {orders}""",
    # the supplied events as a crawl-event log and as an access log
    "crawl_events": """
        SELECT crawl_id, ts, event_id, event, {faults} AS data FROM (
        SELECT user_id AS crawl_id, ts, event_id,
               CASE event_type WHEN 'signup' THEN 'crawl_started' WHEN 'view' THEN 'page_processing' WHEN 'click' THEN 'media_found'
                 WHEN 'purchase' THEN CASE WHEN event_id % 40 = 0 THEN 'crawl_complete' ELSE 'page_complete' END
                 ELSE CASE WHEN event_id % 50 = 1 THEN 'crawl_error' WHEN event_id % 5 = 2 THEN 'page_discovered' ELSE 'page_error' END END AS event,
               '{"url":"https://' || CASE WHEN event_id % 67 = 3 AND event_type <> 'click' THEN '10.0.0.8' ELSE 'e.example.com' END || '/' || CAST(event_id AS STRING)
                 || '","originalUrl":"https://e.example.com/","config":{"maxDepth":2,"followExternal":false}'
                 || ',"pageUrl":"https://e.example.com/p","depth":' || CAST(event_id % 3 AS STRING)
                 || ',"category":"external","source":"anchor","fromUrl":"https://e.example.com/from","discoveryReason":null'
                 || ',"pagesDone":' || CAST(event_id % 20 AS STRING) || ',"pagesTotal":' || CAST(event_id % 89 % 30 AS STRING)
                 || ',"mediaCount":' || CAST(event_id % 8 AS STRING) || ',"totalPages":' || CAST(event_id % 20 AS STRING)
                 || ',"pagesWithErrors":0,"totalMedia":' || CAST(event_id % 70 AS STRING)
                 || ',"error":"' || CASE WHEN event_id % 31 = 7 THEN '' ELSE 'server_error' END || '","crawlDurationMs":' || CAST(event_id % 900 AS STRING)
                 || '.5,"media":' || item || ',"results":[{"url":"https://e.example.com/r","depth":0,"title":"t","media":[' || item
                 || '],"error":null,"possibleSpa":false,"pageKind":"hub","discoveredFrom":null,"discoveryReason":null}]}' AS whole
        FROM (SELECT *, '{"url":"https://e.example.com/m.mp4","type":"' ||
                 CASE WHEN event_id % 13 = 2 THEN 'audio' WHEN event_id % 2 = 0 THEN 'video' ELSE 'image' END || '","platform":' ||
                 CASE WHEN event_id % 3 = 0 THEN '"vimeo"' ELSE 'null' END || ',"videoId":null,"title":"t","thumbnailUrl":null,"canonicalUrl":null' ||
                 ',"contentKind":"video","confidence":0.9,"duration":null,"source":"x","downloadable":true,"discoveredFrom":null,"discoveryReason":null}' AS item
        FROM {events}))""",
}

# one bad payload for each rule of the event schemas, by event_id % 61: what is replaced, and by what
FAULTS = [
    ('"depth":', '"depht":'), ('"pagesDone":', '"pagesDone":null,"was":'), ('"pagesTotal":', '"pagesTotal":"7","was":'),
    ('"mediaCount":', '"mediaCount":1.5,"was":'), ('"error":"server_error"', '"error":""'), ('"config":{', '"conf":{'),
    ('"maxDepth":2', '"maxDepth":4'), ('"maxDepth":2', '"maxDepth":true'), ('"followExternal":false', '"followExternal":null'),
    ('"source":"x"', '"source":""'), ('"source":"x"', '"sauce":"x"'), ('"confidence":0.9', '"confidence":1.2'),
    ('"downloadable":true', '"downloadable":"true"'), ('"contentKind":"video"', '"contentKind":"film"'), ('"results":[', '"result":['),
    ('"pageKind":"hub"', '"pageKind":"page"'), ('"possibleSpa":false', '"possibleSpa":0'), ('"crawlDurationMs":', '"crawlDurationMs":-1,"was":'),
    ('"category":"external"', '"category":"other"'), ('"source":"anchor"', '"source":"link"'), ('"fromUrl":"https', '"fromUrl":"ftp'),
    ('"totalPages":', '"totalPages":-3,"was":'), ('"pageUrl":"https://e.example.com/p"', '"pageUrl":"https://localhost/p"'), ('"platform":', '"platfrom":'),
    ('"thumbnailUrl":null', '"thumbnailUrl":"https://intranet/t.jpg"'), ('"url":"https://e.example.com/m.mp4"', '"url":7'),
    ('"originalUrl":"https://e.example.com/"', '"originalUrl":""'), ('"title":"t"', '"title":5'), ('"pagesWithErrors":0', '"pagesWithErrors":0.25'),
    ('"maxDepth":2', '"maxPages":0'), ('"results":[{', '"results":[3,{'),
]
BASES["crawl_events"] = BASES["crawl_events"].replace("{faults}", (
    "CASE WHEN event_id % 97 = 5 THEN '{broken' WHEN event_id % 97 = 6 THEN '[1]' ELSE CASE event_id % 61 "
    + " ".join(f"WHEN {i} THEN replace(whole, '{old}', '{new}')" for i, (old, new) in enumerate(FAULTS)) + " ELSE whole END END"))


def base_sql(name: str, table=lambda t: t) -> str:
    text = BASES[name]
    for t in TABLES:
        text = text.replace("{" + t + "}", table(t))
    return text


def base(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.sql(base_sql(name, lambda t: f"parquet.`{sf_dir}/{t}.parquet`"))


def _text(*parts: str) -> str:
    return " || ".join(parts)


_ID = "CAST(doc_id AS STRING)"
BASES["platform_urls"] = "SELECT " + _case(
    "doc_id % 30",
    _text("'https://youtu.be/a'", _ID), _text("'https://www.youtube.com/watch?list=l&v=b'", _ID, "'&t=1'"),
    _text("'https://m.youtube.com/shorts/c'", _ID), _text("'http://youtube.com/live/d'", _ID, "'?x=1'"),
    _text("'https://youtube.com/clip/e'", _ID), _text("'//www.youtube-nocookie.com/embed/f'", _ID),
    _text("'https://youtube.com/playlist?list=g'", _ID), _text("'https://youtube.com/@h'", _ID),
    _text("'https://youtube.com/channel/i'", _ID), _text("'https://player.vimeo.com/video/'", _ID),
    _text("'https://vimeo.com/'", _ID, "'/x'"), _text("'https://dai.ly/j'", _ID),
    _text("'https://www.dailymotion.com/video/k'", _ID, "'_title'"), _text("'https://clips.twitch.tv/l'", _ID),
    _text("'https://www.twitch.tv/videos/'", _ID), _text("'https://x.com/u/status/'", _ID, "'/'"),
    _text("'https://www.tiktok.com/@u/video/'", _ID), _text("'https://any.example/p/n'", _ID, "'/'"),
    _text("'https://holodex.net/watch/o'", _ID), _text("'https://any.example/channel/p'", _ID),
    _text("'https://holodex.net/multiview/q'", _ID), _text("'https://b23.tv/r'", _ID),
    _text("'https://www.bilibili.com/video/BV'", _ID), _text("'https://www.nicovideo.jp/watch/sm'", _ID),
    _text("'https://scripts.converteai.net/a'", _ID, "'/players/b'", _ID, "'/v4/player.js'"),
    _text("'https://player.converteai.net/a/ab-test/b'", _ID, "'/x'"),
    _text("'https://cdn.vturb.com.br/c'", _ID, "'/main.m3u8'"), _text("'https://plain.example/'", _ID),
    _text("'https://youtu.be/'"), other=_text("'/relative/'", _ID)) + " AS url FROM {documents}"
BASES["file_urls"] = (
    "SELECT doc_id, doc_id % 7 + 1 AS ordinal, " + _text(
        "'https://f.example.com/d/'",
        _case("doc_id % 6", _text("'a%20b'", _ID, "'.jpg'"), "'noext'", _text("'x+y'", _ID, "'.MP4?q=1'"), "'..hidden..png'",
              "'b%C3%A9.webp'", other="'bad%zz.gif'")) + " AS url, "
    + "replace(text, ' ', '/') || CASE WHEN doc_id % 3 = 0 THEN '...' ELSE '.mp4' END AS title, "
    + _case("doc_id % 6", "'image/jpeg'", "'VIDEO/MP4; codecs=x'", "'application/dash+xml'", "'text/html'", "'image/svg+xml'",
            other="'application/octet-stream'") + " AS mime FROM {documents}")
BASES["dns_answers"] = """
    SELECT 'h' || CAST(c_custkey % 400 AS STRING) || CASE WHEN c_custkey % 3 = 0 THEN '.example.com'
             WHEN c_custkey % 3 = 1 THEN '.example.org' ELSE '.example.net' END AS host,
           CASE WHEN c_custkey % 7 = 0 THEN array('10.1.2.3', '93.184.216.34') WHEN c_custkey % 11 = 0 THEN array('fd00::1')
                WHEN c_custkey % 13 = 0 THEN NULL ELSE array('93.184.216.34') END AS addresses
    FROM {customer}"""
BASES["seeds"] = "SELECT doc_id AS id, " + _case(
    "doc_id % 12", _text("'  example'", _ID, "'.com/a '"), "''", "'http://'", "'ftp://x.example.com/'", "'http://localhost:80/'",
    "'intranet'", _text("'https://10.0.0.'", "CAST(doc_id % 200 AS STRING)"), "'http://[::1]/'", "'https://a b.com/'",
    _text("'https://site.example/'", _ID), "'mailto:x@example.com'",
    other=_text("'http://172.20.1.1:8080/?q='", _ID)) + " AS url FROM {documents}"
BASES["player_scripts"] = """
    SELECT 'https://scripts.converteai.net/ab-' || CAST(c_custkey % 3 AS STRING) || '/players/cd-' || CAST(c_custkey % 5 AS STRING)
             || '/v4/player.js' AS src, 'text/javascript' AS content_type,
           CASE WHEN c_custkey % 5 = 4 THEN 'var x={"hls_url":"https://cdn.example.com/' || CAST(c_custkey % 15 AS STRING) || '/a.m3u8"}'
                ELSE 'cfg={cdn:"cdn.example.com",oid:"ab-' || CAST(c_custkey % 3 AS STRING) || '",video:{title:"t",id:"'
                     || CAST(c_custkey % 5 AS STRING) || 'f",cover:"https://img.example.com/c.jpg"}}' END AS body
    FROM {customer}"""
