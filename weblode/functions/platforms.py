"""Video-platform recognition as one Catalyst expression per platform."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weblode.functions.fixed import PLATFORM_DOMAINS, VTURB_CDN_HOSTS, VTURB_SCRIPT_HOSTS
from weblode.functions.text import built_once, settle
from weblode.functions.urls import bare_host, path_of, query_param, segments_of

INFO = (
    "struct<platform:string,video_id:string,canonical_url:string,kind:string,thumbnail_url:string,confidence:double>"
)
ALL_DOMAINS = [d for domains in PLATFORM_DOMAINS.values() for d in domains]
ORDER = [
    "youtube", "vimeo", "dailymotion", "twitch", "twitter", "tiktok", "instagram", "holodex", "bilibili",
    "niconico", "vturb",
]


def is_platform_domain(url: Column) -> Column:
    full = F.when(url.startswith("//"), F.concat(F.lit("https:"), url)).otherwise(url)
    return F.coalesce(bare_host(full).isin(ALL_DOMAINS), F.lit(False))


def _info(platform: str, video_id: Column, canonical: Column, kind: str, confidence, thumb: Column | None = None):
    conf = confidence if isinstance(confidence, Column) else F.lit(float(confidence))
    return F.struct(
        F.lit(platform).alias("platform"), video_id.alias("video_id"), canonical.alias("canonical_url"),
        F.lit(kind).alias("kind"), (F.lit(None).cast("string") if thumb is None else thumb).alias("thumbnail_url"),
        conf.alias("confidence"),
    )


def _found(text: Column) -> Column:
    return F.when(text != "", text)


def _text(template: str, *cols: Column) -> Column:
    """'a{}b' with columns in place of the braces."""
    parts = template.split("{}")
    out = [F.lit(parts[0])]
    for col, lit in zip(cols, parts[1:]):
        out += [col, F.lit(lit)]
    return F.concat(*out)


def _rules(strict: bool) -> dict[str, list[tuple[Column, Column]]]:
    """Per platform, the (test, result) branches in the order they are tried."""
    host, path, url = F.col("_ph"), F.col("_pp"), F.col("_pu")
    first, second, third = (F.get(F.col("_ps"), i) for i in range(3))
    v, lst = query_param(url, "v"), query_param(url, "list")
    yt = host.isin(PLATFORM_DOMAINS["youtube"])
    yt_thumb = lambda x: _text("https://img.youtube.com/vi/{}/mqdefault.jpg", x)
    watch = "https://www.youtube.com/watch?v={}"
    trimmed = F.regexp_replace(path, "/+$", "")
    digits = lambda word: _found(F.regexp_extract(path, f"/{word}/([0-9]+)", 1))
    gram = _found(F.regexp_extract(path, "/(?:reel|p)/([A-Za-z0-9_-]+)", 1))
    dm_id = F.substring_index(second, "_", 1)
    dm_thumb = "https://www.dailymotion.com/thumbnail/video/{}"

    def on(platform: str) -> Column:
        return host.isin(PLATFORM_DOMAINS[platform]) if strict else F.lit(True)

    def yt_path(word: str) -> Column:
        return yt & (first == word) & second.isNotNull()

    return {
        "youtube": [
            ((host == "youtu.be") & first.isNotNull(),
             _info("youtube", first, _text(watch, first), "video", 0.99, yt_thumb(first))),
            ((host == "youtu.be"), F.lit(None).cast(INFO)),
            (yt_path("shorts"),
             _info("youtube", second, _text("https://www.youtube.com/shorts/{}", second), "short", 0.98, yt_thumb(second))),
            (yt_path("live"),
             _info("youtube", second, _text("https://www.youtube.com/live/{}", second), "live", 0.97, yt_thumb(second))),
            (yt_path("clip"), _info("youtube", second, _text("https://www.youtube.com/clip/{}", second), "clip", 0.94)),
            (yt_path("embed"), _info("youtube", second, _text(watch, second), "video", 0.97, yt_thumb(second))),
            (yt & v.isNotNull(), _info("youtube", v, _text(watch, v), "video", 0.98, yt_thumb(v))),
            (yt & lst.isNotNull() & first.isin("playlist", "watch"),
             _info("youtube", lst, _text("https://www.youtube.com/playlist?list={}", lst), "playlist", 0.88)),
            (yt & first.startswith("@"),
             _info("youtube", first, _text("https://www.youtube.com/{}", first), "channel", 0.85)),
            (yt_path("channel"),
             _info("youtube", second, _text("https://www.youtube.com/channel/{}", second), "channel", 0.85)),
        ],
        "vimeo": [
            ((host == "player.vimeo.com") & (first == "video") & second.isNotNull(),
             _info("vimeo", second, _text("https://vimeo.com/{}", second), "video", 0.97,
                   _text("https://vumbnail.com/{}.jpg", second))),
            ((host == "vimeo.com") & first.rlike("^[0-9]+$"),
             _info("vimeo", first, _text("https://vimeo.com/{}", first), "video", 0.96,
                   _text("https://vumbnail.com/{}.jpg", first))),
        ],
        "dailymotion": [
            ((host == "dai.ly") & first.isNotNull(),
             _info("dailymotion", first, _text("https://www.dailymotion.com/video/{}", first), "video", 0.96,
                   _text(dm_thumb, first))),
            ((host == "dailymotion.com") & (first == "video") & (dm_id != ""),
             _info("dailymotion", dm_id, _text("https://www.dailymotion.com/video/{}", dm_id), "video", 0.95,
                   _text(dm_thumb, dm_id))),
        ],
        "twitch": [
            ((host == "clips.twitch.tv") & first.isNotNull(),
             _info("twitch", first, _text("https://clips.twitch.tv/{}", first), "clip", 0.95)),
            ((host == "twitch.tv") & (first == "videos") & second.isNotNull(),
             _info("twitch", second, _text("https://www.twitch.tv/videos/{}", second), "video", 0.95)),
        ],
        "twitter": [
            (on("twitter") & digits("status").isNotNull(),
             _info("twitter", digits("status"), _text("https://{}/{}", host, trimmed), "video", 0.9)),
        ],
        "tiktok": [
            (on("tiktok") & digits("video").isNotNull(),
             _info("tiktok", digits("video"), _text("https://www.tiktok.com{}", trimmed), "video", 0.94)),
        ],
        "instagram": [
            (on("instagram") & gram.isNotNull(),
             _info("instagram", gram, _text("https://www.instagram.com{}/", trimmed), "video", 0.92)),
        ],
        "holodex": [
            (on("holodex") & (first == word) & second.isNotNull(),
             _info("holodex", second, _text(f"https://holodex.net/{word}/{{}}", second), kind, conf))
            for word, kind, conf in (("watch", "video", 0.96), ("channel", "channel", 0.88),
                                     ("multiview", "playlist", 0.84))
        ],
        "bilibili": [
            ((host == "b23.tv") & first.isNotNull(),
             _info("bilibili", first, _text("https://b23.tv/{}", first), "video", 0.88)),
            ((host == "bilibili.com") & (first == "video") & second.isNotNull(),
             _info("bilibili", second, _text("https://www.bilibili.com/video/{}", second), "video", 0.92)),
        ],
        "niconico": [
            (on("niconico") & (first == "watch") & second.isNotNull(),
             _info("niconico", second, _text("https://www.nicovideo.jp/watch/{}", second), "video", 0.91)),
        ],
        "vturb": [
            (host.isin(VTURB_SCRIPT_HOSTS) & (second == "players") & third.isNotNull(),
             _info("vturb", third, _text("https://scripts.converteai.net/{}/players/{}/embed.html", first, third),
                   "video", F.when(F.array_contains("_ps", "player.js"), F.lit(0.9)).otherwise(F.lit(0.95)))),
            (host.isin(VTURB_SCRIPT_HOSTS) & (second == "ab-test") & third.isNotNull(),
             _info("vturb", third, url, "video", 0.78)),
            (host.isin(VTURB_CDN_HOSTS) & path.rlike(r"(?i)\.(m3u8|mp4|webm|mpd)$"),
             _info("vturb", F.coalesce(first, F.lit("unknown")), url, "video", 0.96)),
        ],
    }


@built_once
def _branches(strict: bool) -> list[Column]:
    rules, found = _rules(strict), []
    for name in ORDER:
        branch = None
        for test, result in rules[name]:
            branch = F.when(test, result) if branch is None else branch.when(test, result)
        found.append(branch)
    return found


def with_platform(df: DataFrame, url: str, out: str, mode: str = "compat") -> DataFrame:
    """Add ``out``: what video a URL points at, null for none; the first platform in the fixed order wins.

    ``mode="compat"`` leaves the path-only platforms unchecked for host; ``mode="strict"`` checks them all.
    """
    if mode not in ("compat", "strict"):
        raise ValueError("mode is 'compat' or 'strict'")
    full = F.when(F.col(url).startswith("//"), F.concat(F.lit("https:"), F.col(url))).otherwise(F.col(url))
    df = df.withColumn("_pu", full)
    df = df.withColumns({"_ph": bare_host(F.col("_pu")), "_pp": path_of(F.col("_pu")), "_ps": segments_of(F.col("_pu"))})
    found = _branches(mode == "strict")
    df = settle(df, **{out: F.when(F.col("_ph") != "", F.coalesce(*found))})
    return df.drop("_pu", "_ph", "_pp", "_ps")
