"""Pages with media markup added, for data sets whose pages carry none.

One SQL expression, valid in Spark SQL and in ANSI engines alike, so that a second engine can build the
very same pages from the same table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# (modulus, remainder or None for every page, markup); {id} stands for the page id
MARKUP = [
    (1, 0, '<img src="/i/{id100}.jpg" alt="pic"><p>Intro <a class="cta" href="/watch/hub-{id}">Watch live now</a> here</p>'),
    (2, 0, '<img srcset="/s/{id}-1x.webp 1x, /s/{id}-2x.webp 2x" data-src="lazy/{id}.png">'),
    (3, 0, '<picture><source type="image/webp" srcset="/pic/{id}"><img src="/pic/{id}.jpg"></picture>'),
    (4, 0, '<video src="/v/{id}.mp4" poster="/v/{id}.jpg"><source src="/v/{id}.webm" type="video/webm"></video>'),
    (10, 0, '<iframe src="https://www.youtube.com/embed/yt{id}"></iframe>'),
    (10, 5, '<iframe src="https://player.vimeo.com/video/{id}"></iframe>'),
    (6, 0, '<div style="color:red;background-image:url(/bg/{id}.gif)">x</div>'),
    (7, 0, '<script type="application/ld+json">{"@type":"VideoObject","contentUrl":"https://media.example.com/j/{id}.mp4",'
           '"thumbnailUrl":"https://media.example.com/j/{id}.png","embedUrl":"https://youtu.be/j{id}"}</script>'),
    (8, 0, '<script>var cfg={file:"/m/{id}.mp4",src:"/m/{id}.m3u8"};play("https://cdn.example.com/m/{id}.webm");</script>'),
    (9, 0, '<div data-hls="https://cdn.example.com/h/{id}.m3u8">hls</div>'),
    (10, 3, '<meta property="og:video" content="/og/{id}"><meta property="og:image" content="/og/{id}.jpg">'),
    (11, 0, '<p><button data-href="/go/{id}">Open</button></p><div onclick="window.location.href=\'\'/play/{id}\'\'">Click</div>'
            '<div data-settings="{&quot;link&quot;:{&quot;url&quot;:&quot;/set/{id}&quot;},&quot;video_url&quot;:'
            '&quot;https://vimeo.com/{id}&quot;}">Set</div>'),
    (12, 0, '<noscript><img src="/ns/{id}.png"></noscript>'),
    (13, 0, '<embed src="/e/{id}" type="video/mp4"><object data="/o/{id}.webm"></object>'),
    (14, 0, '<p><a href="/dl/{id}.mov#t">clip file</a></p><lite-youtube videoid="lite{id}"></lite-youtube>'),
    (15, 0, '<script src="https://scripts.converteai.net/ab-{id3}/players/cd-{id5}/v4/player.js"></script>'),
    (16, 0, '<footer><a href="/legal/{id}">Privacy</a><a href="https://t.me/x{id}">Chat</a></footer>'
            '<p><a href="https://www.youtube.com/watch?v=v{id}">See it</a></p>'),
]


def _sql_text(markup: str) -> str:
    pieces = {"id": "page_id", "id100": "(page_id % 100)", "id3": "(page_id % 3)", "id5": "(page_id % 5)"}
    text = "'" + markup + "'"
    for key, value in pieces.items():
        text = text.replace("{" + key + "}", f"' || CAST({value} AS STRING) || '")
    return text


def markup_sql(extra: str = "''") -> str:
    """SQL text of the enriched html."""
    parts = [
        f"CASE WHEN page_id % {mod} = {rem} THEN {_sql_text(text)} ELSE '' END" if mod > 1 else _sql_text(text)
        for mod, rem, text in MARKUP
    ]
    return "replace(html, '<article>', '<article>' || " + " || ".join(parts) + f" || {extra})"


def enriched(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", "url", F.expr(markup_sql()).alias("html"))


def linked(pages: DataFrame) -> DataFrame:
    """Enriched pages that also link to pages ``id + 1`` and ``2 id`` of the same table."""
    total = pages.agg(F.max("page_id") + 1).scalar()
    ids = pages.select("page_id", "url", "html", ((F.col("page_id") + 1) % total).alias("near_id"),
                       ((F.col("page_id") * 2) % total).alias("far_id"))
    targets = pages.select(F.col("page_id").alias("t_id"), F.col("url").alias("t_url"))
    near = ids.join(targets, F.col("near_id") == F.col("t_id")).withColumnRenamed(
        "t_url", "near_url").drop("t_id")
    both = near.join(targets, F.col("far_id") == F.col("t_id")).withColumnRenamed("t_url", "far_url")
    extra = ("'<p><a href=\"' || near_url || '\">video page</a> <a href=\"' || far_url || '\">more</a></p>'")
    return both.select("page_id", "url", F.expr(markup_sql(extra)).alias("html"))
