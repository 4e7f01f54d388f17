"""Embed discovery: eleven extractors, first row per embed key wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weblode.config import Limits
from weblode.functions.files import looks_like_video
from weblode.functions.fixed import (
    EMBED_DATA_ATTRS, OG_EMBED_PROPS, PLATFORM_URL, SCRIPT_URL_TAIL, SETTINGS_EMBED_KEY, STRUCTURED_SCRIPT_HINT,
    TWITTER_EMBED_PROPS, VIDEO_URL,
)
from weblode.functions.jsonld import settings_urls, video_nodes
from weblode.functions.platforms import with_platform
from weblode.functions.text import (
    at_most, attr, attr_names, attr_tokens, attr_values, built_once, present, settle, unescape_settings, utf16_length,
)
from weblode.functions.urls import is_http, with_resolved
from weblode.operators.tokens import elements, raw_body

# mode of a row: what the URL may become
ANY, DIRECT_VIDEO, IMAGE, PLATFORM_ONLY, PLATFORM_CANONICAL = "any", "direct", "image", "platform", "canonical"
ROW = ("array<struct<step:int,b:int,c:int,raw:string,mode:string,source:string,p_reason:string,d_reason:string,"
       "floor:double,poster:string,absolute:boolean>>")


def _row(step: int, raw: Column, mode, source, p_reason: str, d_reason: str | None = None, floor: float = 0.0, b=0, c=0,
         poster: Column | None = None, absolute: bool = False) -> Column:
    as_col = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.struct(
        F.lit(step).alias("step"), as_col(b).alias("b"), as_col(c).alias("c"), raw.alias("raw"),
        as_col(mode).alias("mode"), as_col(source).alias("source"), F.lit(p_reason).alias("p_reason"),
        F.lit(d_reason or p_reason).alias("d_reason"), F.lit(float(floor)).alias("floor"),
        (F.lit(None).cast("string") if poster is None else poster).alias("poster"), F.lit(absolute).alias("absolute"))


def _watch(video_id: Column) -> Column:
    return F.concat(F.lit("https://www.youtube.com/watch?v="), video_id)


@built_once
def _embed_rows(max_script: int | None) -> Column:
    name, tag = F.col("name"), F.col("tag")
    none = F.array().cast(ROW)
    body = F.when(name == "script", raw_body(tag))
    frame = F.coalesce(attr("src"), attr("data-src"), attr("data-lazy-src"))
    file_src = F.coalesce(attr("src"), attr("data-src"))
    parts = attr_tokens(F.col("video_tag"))
    outer_poster = F.get(attr_values(parts), F.array_position(attr_names(parts), "poster").cast("int") - 1)
    box = F.coalesce(attr("src"), attr("data"))
    widget = F.array_contains(F.split(attr("class"), r"\s+"), "elementor-widget-video") | (
        attr("data-widget_type") == "video.default")
    raw = attr("data-settings")
    found = settings_urls(unescape_settings(raw), SETTINGS_EMBED_KEY)
    light = (
        ((name == "amp-youtube") & attr("data-videoid").isNotNull()) | ((name == "lite-youtube") & attr("videoid").isNotNull())
        | attr("data-youtube-id").isNotNull() | (F.contains(attr("class"), F.lit("youtube")) & attr("data-video-id").isNotNull()))
    light_id = F.coalesce(attr("data-videoid"), attr("videoid"), attr("data-youtube-id"), attr("data-video-id"))

    def data_row(n: str, i: int) -> Column:
        if n in ("data-video-id", "data-youtube-id"):
            return _row(6, _watch(present(attr(n))), PLATFORM_CANONICAL, "data_attr", "youtube-id-attribute", floor=0.9, b=i)
        return _row(6, attr(n), ANY, "data_attr", "media-attribute", b=i)

    def json_ld(node: Column, k: Column) -> Column:
        rows = [_row(9, node[p], ANY, "json_ld", "json-ld-video", floor=0.96, b=k, c=i, absolute=True)
                for i, p in enumerate(("content_url", "embed_url", "url"))]
        return F.array(*rows, _row(9, node["thumbnail"], IMAGE, "json_ld", "json-ld-thumbnail", b=k, c=3, absolute=True))

    inline = attr("src").isNull() & at_most(utf16_length(body), max_script)
    clean = lambda u: F.regexp_replace(u, SCRIPT_URL_TAIL, "")
    states = F.transform(F.regexp_extract_all(body, F.lit(PLATFORM_URL), F.lit(0)), lambda u, k: _row(
        10, clean(u), PLATFORM_CANONICAL, "inline_script", "structured-player-state", floor=0.82, c=k, absolute=True))
    files = F.transform(F.regexp_extract_all(body, F.lit(VIDEO_URL), F.lit(0)), lambda u, k: _row(
        12, F.when(~u.rlike(r"\.js\.map|node_modules"), clean(u)), DIRECT_VIDEO, "inline_script", "inline-direct-video",
        c=k, absolute=True))
    src = attr("src")
    player = F.array(_row(
        11, F.when(F.contains(src, F.lit("converteai")) | F.contains(src, F.lit("vturb")), src), PLATFORM_CANONICAL,
        "inline_script", "vturb-player-script", floor=0.86, absolute=True))

    def meta(field: str, props: list[str], step: int, source: str, reason: str) -> Column:
        wanted = F.filter(F.transform("meta", lambda m: F.struct(
            F.array_position(F.array(*[F.lit(p) for p in props]), m.prop).cast("int").alias("i"), m.prop.alias("p"),
            m[field].alias("u"))), lambda m: m.i > 0)
        return F.transform(wanted, lambda m: F.when(m.p == "og:image", _row(
            step, m.u, IMAGE, source, "og-image", b=m.i)).otherwise(_row(step, m.u, ANY, source, reason, b=m.i)))

    per_tag = (
        F.when(name == "iframe", F.array(_row(1, frame, ANY, "iframe", "iframe-embed", "direct-iframe")))
        .when(name == "video", F.array(
            _row(2, file_src, DIRECT_VIDEO, "video_tag", "html5-video", b=0, poster=attr("poster")),
            _row(2, attr("poster"), IMAGE, "video_tag", "video-poster", b=2)))
        .when((name == "source") & F.col("video").isNotNull(), F.array(_row(
            2, file_src, DIRECT_VIDEO, "video_tag", "html5-video-source", b=1, c=F.col("pos"), poster=outer_poster)))
        .when(((name == "embed") & src.isNotNull()) | ((name == "object") & attr("data").isNotNull()), F.array(_row(
            3, box, ANY, F.when(name == "embed", "embed_tag").otherwise("object_tag"), "object-embed", "direct-embed")))
        .when((name == "amp-vimeo") & (attr("data-videoid") != ""), F.array(_row(
            5, F.concat(F.lit("https://player.vimeo.com/video/"), attr("data-videoid")), PLATFORM_CANONICAL, "data_attr",
            "light-vimeo-player", floor=0.9, b=1)))
        .when(name == "script", F.concat(
            F.when(attr("type") == "application/ld+json", F.flatten(F.transform(video_nodes(body), json_ld))).otherwise(none),
            F.when(inline & body.rlike(STRUCTURED_SCRIPT_HINT), states).otherwise(none),
            F.when(src.isNotNull(), player).otherwise(none),
            F.when(inline, files).otherwise(none)))
        .when(name == "#meta", F.concat(
            meta("by_property", OG_EMBED_PROPS, 7, "og_meta", "og-video"),
            meta("by_name", TWITTER_EMBED_PROPS, 8, "twitter_meta", "twitter-card")))
        .otherwise(none)
    )
    shared = [
        F.when(widget & (raw != ""), F.transform(found, lambda s, k: _row(
            4, s.value, ANY, "data_attr", "elementor-video-widget", floor=0.94, c=k))).otherwise(none),
        F.when(light & (light_id != ""), F.array(_row(
            5, _watch(light_id), PLATFORM_CANONICAL, "data_attr", "light-youtube-player", floor=0.92, b=0))).otherwise(none),
        F.when(F.exists("names", lambda n: n.startswith("data-")), F.array(*[
            data_row(n, i) for i, n in enumerate(EMBED_DATA_ATTRS)])).otherwise(none),
    ]
    return F.filter(F.concat(per_tag, *shared), lambda r: r.raw != "")


def embed_rows(els: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Candidate URLs of every extractor, unresolved. Narrow."""
    at = F.when(F.col("step") == 2, F.coalesce("video", "pos")).when(F.col("step").isin(7, 8), 0).otherwise(F.col("pos"))
    rows = els.select("page_id", "page_url", "pos", "video", F.inline_outer(_embed_rows(limits.max_script_chars)))
    return rows.filter(F.col("raw").isNotNull()).withColumn("a", at)


def discover_embeds(pages: DataFrame, mode: str = "compat", limits: Limits = Limits(), els: DataFrame | None = None):
    """Embeds of every page in discovery order, one per embed key."""
    rows = embed_rows(elements(pages) if els is None else els, limits)
    rows = with_resolved(rows, "raw", "page_url", "full")
    rows = with_resolved(rows, "poster", "page_url", "thumb")
    # sources read as absolute keep their text; an own scheme is required of them
    rows = settle(rows, url=F.when(F.col("absolute"), F.when(
        F.col("raw").rlike("^(?:[a-zA-Z][a-zA-Z0-9+.-]*:|//)"), F.col("raw"))).otherwise(F.col("full")))
    rows = rows.filter(is_http(F.col("url")) | (F.col("absolute") & F.col("url").startswith("//")))
    rows = with_platform(rows, "url", "info", mode)
    kind = F.col("mode")
    hosted = F.col("info").isNotNull() & kind.isin(ANY, PLATFORM_ONLY, PLATFORM_CANONICAL)
    direct = (kind == DIRECT_VIDEO) | ((kind == ANY) & looks_like_video(F.col("url")))
    shape = F.when(kind == IMAGE, "image").when(hosted, "platform").when(direct, "direct")
    rows = settle(rows, shape=shape).filter(F.col("shape").isNotNull())
    is_platform = F.col("shape") == "platform"
    url = F.when(is_platform & (kind == PLATFORM_CANONICAL), F.col("info.canonical_url")).otherwise(F.col("url"))
    direct_conf = F.when(F.col("shape") == "direct", F.lit(0.92)).otherwise(F.lit(0.9))
    shaped = rows.select(
        "page_id", "page_url", "step", "a", "b", "c", url.alias("url"),
        F.when(F.col("shape") == "image", "image").otherwise("video").alias("type"),
        F.when(is_platform, F.col("info.platform")).when(F.col("shape") == "direct", "direct").alias("platform"),
        F.col("info.video_id").alias("_vid"), is_platform.alias("_hosted"),
        F.when(is_platform, F.col("info.thumbnail_url")).when(is_http(F.col("thumb")), F.col("thumb")).alias("thumbnail_url"),
        F.when(is_platform, F.col("info.canonical_url")).otherwise(F.col("url")).alias("canonical_url"),
        F.when(is_platform, F.col("info.kind")).when(F.col("shape") == "direct", "video").alias("content_kind"),
        F.when(is_platform, F.greatest(F.col("info.confidence"), F.col("floor"))).otherwise(direct_conf).alias("confidence"),
        "source", (~is_platform).alias("downloadable"),
        F.when(is_platform | (F.col("shape") == "image"), F.col("p_reason")).otherwise(F.col("d_reason")).alias("discovery_reason"))
    order = ["step", "a", "b", "c"]
    placed = shaped.withColumn("key", F.col("canonical_url")).repartition("page_id")
    first = W.partitionBy("page_id", "key").orderBy(*order)
    kept = placed.withColumn("_n", F.row_number().over(first)).filter("_n = 1")
    return kept.select(
        "page_id", "page_url", F.row_number().over(W.partitionBy("page_id").orderBy(*order)).alias("ord"), "key", "url",
        "type", "platform", F.when(F.col("_hosted"), F.col("_vid")).alias("video_id"), "thumbnail_url", "canonical_url",
        "content_kind", "confidence", "source", "downloadable", "discovery_reason")
