"""Media extraction: seventeen kinds of markup to one deduplicated asset table.

Every element yields an array of references in one pass over the pages; only those references — a
small share of the HTML — are shuffled, once, by page. First-wins rules become total orders.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weblode.config import Limits
from weblode.functions.files import (
    extension_from_mime, file_name_from_url, looks_like_video, media_type, sanitize_file_name, video_extension,
)
from weblode.functions.fixed import (
    CSS_BACKGROUND, JS_SPACE, META_VIDEO_PROPS, PLAYER_AB_PATH, PLAYER_CDN, PLAYER_CONTENT_TYPES, PLAYER_COVER,
    PLAYER_INLINE_HINT, PLAYER_INLINE_SRC, PLAYER_LEGACY, PLAYER_LEGACY_STATIC, PLAYER_LEGACY_VIDEO, PLAYER_OID,
    PLAYER_PATH, PLAYER_SCRIPT_SRC, PLAYER_VIDEO, SCRIPT_FILE, SCRIPT_JSON_KEY, SCRIPT_SOURCE, SCRIPT_SRC, SRC_ATTRS,
    SRCSET_ATTRS, VIDEO_DATA_ATTRS, VIDEO_URL,
)
from weblode.functions.jsonld import video_nodes
from weblode.functions.text import (
    at_most, attr, attr_names, attr_tokens, attr_values, built_once, present, settle, trim_space, utf16_length,
)
from weblode.functions.urls import (
    bare_host, is_http, is_media_extension, path_of, query_param, strip_fragment, url_extension, with_resolved,
)
from weblode.operators.tokens import elements, raw_body, tokens_of, with_attributes
from weblode.sources.stages import written

# order of the sources; the first reference to a URL in this order wins
RANK = {name: i for i, name in enumerate([
    "img", "video", "source", "a", "noscript", "picture", "style", "style block", "iframe", "embed", "object",
    "meta", "og:image", "json-ld", "script", "data", "player",
])}
REFS = "array<struct<rank:int,b:int,c:int,url:string,tag:string,ext:string>>"


def _ref(rank, url: Column, tag, ext: Column | None = None, b=0, c=0) -> Column:
    as_col = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.struct(
        as_col(rank).alias("rank"), as_col(b).alias("b"), as_col(c).alias("c"), url.alias("url"),
        as_col(tag).alias("tag"), (F.lit(None).cast("string") if ext is None else ext).alias("ext"))


def _srcset(value: Column) -> Column:
    """First token of each comma-separated entry."""
    entry = F.transform(F.split(value, ","), lambda e: F.regexp_extract(trim_space(e), f"^([^{JS_SPACE}]*)", 1))
    return F.filter(entry, lambda u: u != "")


def _many(rank: str, urls: Column, tag, b: int, ext=None) -> Column:
    return F.transform(urls, lambda u, k: _ref(RANK[rank], u, tag, None if ext is None else ext(u), b, k))


def youtube_id(url: Column) -> Column:
    host, path = bare_host(url), path_of(url)
    found = (
        F.when(host.isin("youtube.com", "youtube-nocookie.com") & path.startswith("/embed/"),
               F.regexp_extract(path, "^/embed/([^/]*)", 1))
        .when((host == "youtube.com") & url.rlike(r"^[^?#]*\?(?:[^#]*&)?v="), F.coalesce(query_param(url, "v"), F.lit("")))
        .when(host == "youtu.be", F.regexp_extract(path, "^/([^/]*)", 1)))
    return F.when(found != "", found)


def vimeo_id(url: Column) -> Column:
    host, path = bare_host(url), path_of(url)
    found = (
        F.when((host == "player.vimeo.com") & path.startswith("/video/"), F.regexp_extract(path, "^/video/([^/]*)", 1))
        .when(host == "vimeo.com", F.regexp_extract(path, "^/([0-9]+)", 1)))
    return F.when(found != "", found)


def _full(url: Column) -> Column:
    return F.when(url.startswith("//"), F.concat(F.lit("https:"), url)).otherwise(url)


def hosted_elsewhere(url: Column) -> Column:
    """A player page of the two platforms whose pages are not files."""
    return youtube_id(_full(url)).isNotNull() | vimeo_id(_full(url)).isNotNull()


def _pairs(rank: str, text: Column, pattern: str, tag, b: int, url_group: int, ext_group: int, key_group: int = 0):
    """One reference per match of a script pattern, extension (and key) taken from the match."""
    parts = F.arrays_zip(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(url_group)).alias("u"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(ext_group)).alias("e"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(key_group)).alias("k"),
    )
    return F.transform(parts, lambda m, i: _ref(
        RANK[rank], m.u, F.concat(F.lit("script["), m.k, F.lit("]")) if key_group else tag, F.lower(m.e), b, i))


def _script_refs(text: Column) -> Column:
    direct = F.filter(
        F.regexp_extract_all(text, F.lit(VIDEO_URL), F.lit(0)),
        lambda u: ~F.contains(u, F.lit(".js.map")) & ~F.contains(u, F.lit("node_modules")))
    return F.concat(
        _many("script", direct, "script", 0, video_extension),
        _pairs("script", text, SCRIPT_FILE, "script[jwplayer]", 1, 1, 2),
        _pairs("script", text, SCRIPT_SOURCE, "script[jwplayer]", 2, 1, 2),
        _pairs("script", text, SCRIPT_SRC, "script[player]", 3, 1, 2),
        _pairs("script", text, SCRIPT_JSON_KEY, None, 4, 2, 3, 1),
    )


def _json_ld_refs(text: Column) -> Column:
    """Members of each video node in order; pages of the two player hosts are no files."""
    def of(node: Column, k: Column) -> Column:
        members = F.array(*[
            F.struct(F.lit(t).alias("t"), node[p].alias("u")) for p, t in (
                ("content_url", "contentUrl"), ("embed_url", "embedUrl"), ("url", "url"), ("thumbnail", "thumbnailUrl"))
        ])
        web = F.filter(members, lambda m: m.u.startswith("http") & ((m.t == "thumbnailUrl") | ~hosted_elsewhere(m.u)))
        return F.transform(web, lambda m, i: _ref(
            RANK["json-ld"], m.u, F.concat(F.lit("json-ld["), m.t, F.lit("]")),
            F.when(m.t != "thumbnailUrl", F.coalesce(video_extension(m.u), F.lit("mp4"))), k, i))

    return F.flatten(F.transform(video_nodes(text), of))


def _noscript_images(body: Column) -> Column:
    images = F.filter(tokens_of(body), lambda t: t.rlike(r"(?i)^<img[\s/>]"))

    def src(tag: Column) -> Column:
        parts = attr_tokens(tag)
        return F.get(attr_values(parts), F.array_position(attr_names(parts), "src").cast("int") - 1)

    return F.filter(F.transform(images, src), lambda u: u != "")


def _position(values: list[str], name: Column) -> Column:
    return F.array_position(F.array(*[F.lit(v) for v in values]), name).cast("int")


@built_once
def _attribute_refs(max_script: int | None) -> Column:
    """References carried by one attribute (or one raw-text body) of an element."""
    el, name, value = F.col("name"), F.col("an"), F.col("av")
    none = F.array().cast(REFS)
    in_src, in_set = _position(SRC_ATTRS, name), _position(SRCSET_ATTRS, name)
    label = F.concat(F.lit("["), name, F.lit("]"))
    mime = extension_from_mime(F.coalesce(F.col("type"), F.lit("")))

    def main(rank: str, ext=None) -> Column:
        """Lazy source attributes, then source-set attributes."""
        tag = F.concat(F.lit(rank), label)
        return F.when(in_src > 0, F.array(_ref(RANK[rank], value, tag, ext, in_src))).when(
            in_set > 0, F.transform(_srcset(value), lambda u, k: _ref(RANK[rank], u, tag, None, in_set + 10, k))
        ).otherwise(none)

    pic = RANK["picture"]
    source_in_picture = F.when(in_set > 0, F.transform(_srcset(value), lambda u, k: _ref(
        pic, u, F.concat(F.lit("picture source"), label), mime, in_set, k))).when(
        in_src > 0, F.array(_ref(pic, value, F.concat(F.lit("picture source"), label), mime, in_src + 10))).otherwise(none)
    img_tag = F.concat(F.lit("picture img"), label)
    img_in_picture = F.when(in_src > 0, F.array(_ref(pic, value, img_tag, None, in_src))).when(
        in_set > 0, F.transform(_srcset(value), lambda u, k: _ref(pic, u, img_tag, None, in_set + 10, k))).otherwise(none)
    css = F.filter(F.transform(F.regexp_extract_all(value, F.lit(CSS_BACKGROUND), F.lit(1)), trim_space),
                   lambda u: (u != "") & ~u.startswith("data:"))
    yt, vm = youtube_id(_full(value)), vimeo_id(_full(value))
    thumb = F.when(yt.isNotNull(), F.concat(F.lit("https://img.youtube.com/vi/"), yt, F.lit("/maxresdefault.jpg"))).when(
        vm.isNotNull(), F.concat(F.lit("https://vumbnail.com/"), vm, F.lit(".jpg")))
    frame = (name == "src") | ((name == "data-src") & ~F.col("has_src"))
    image = name == "og:image"
    body = name == BODY
    loose, inside = ~F.col("in_picture"), F.col("picture").isNotNull()
    element = (
        F.when(el == "img", F.concat(F.when(loose, main("img")).otherwise(none),
                                     F.when(F.col("lead_image"), img_in_picture).otherwise(none)))
        .when((el == "video") & (name == "poster"), F.array(_ref(RANK["video"], value, "video[poster]", None, 9)))
        .when(el == "video", F.filter(main("video"), lambda r: r.b < 9))
        .when(el == "source", F.concat(F.when(loose, main("source", mime)).otherwise(none),
                                       F.when(inside, source_in_picture).otherwise(none)))
        .when((el == "a") & (name == "href"), F.array(_ref(RANK["a"], value, "a[href]")))
        .when((el == "noscript") & body, _many("noscript", _noscript_images(value), "noscript img[src]", 0))
        .when((el == "style") & body, _many("style block", css, "css[background-image]", 0))
        .when((el == "iframe") & frame, F.array(_ref(RANK["iframe"], thumb, "iframe[src]", F.lit("jpg"))))
        .when((el == "embed") & (name == "src"), F.array(_ref(RANK["embed"], value, "embed[src]", mime)))
        .when((el == "object") & (name == "data"), F.array(_ref(RANK["object"], value, "object[data]", mime)))
        .when((el == "#meta") & (image | ~hosted_elsewhere(value)), F.array(_ref(
            F.when(image, RANK["og:image"]).otherwise(RANK["meta"]), value, F.concat(F.lit("meta"), label),
            F.when(~image, "mp4"), _position(META_VIDEO_PROPS, name))))
        .when((el == "script") & body, F.concat(
            F.when(F.col("type") == "application/ld+json", _json_ld_refs(value)).otherwise(none),
            F.when(~F.col("has_src") & at_most(utf16_length(value), max_script), _script_refs(value)).otherwise(none)))
        .otherwise(none)
    )
    shared = (
        F.when((name == "style") & ~body, _many("style", css, "css[background-image]", 0))
        .when(name.isin(VIDEO_DATA_ATTRS) & (looks_like_video(value) | value.startswith("http")), F.array(_ref(
            RANK["data"], value, label, video_extension(value), _position(VIDEO_DATA_ATTRS, name))))
        .otherwise(none)
    )
    return F.concat(element, shared)


BODY = "#body"


def attribute_rows(els: DataFrame) -> DataFrame:
    """One row per attribute of an element; a raw-text body and the page's meta values come as attributes too."""
    pair = "array<struct<an:string,av:string>>"
    pairs = F.filter(
        F.transform("names", lambda n, i: F.struct(
            F.when(F.array_position("names", n) == i + 1, n).alias("an"), F.get("values", i).alias("av"))),
        lambda p: p.an.isNotNull() & (p.av != ""))
    raw = F.col("name").isin("script", "style", "noscript")
    rows = (
        F.when(F.col("name") == "#meta", F.filter(
            F.transform("meta", lambda m: F.struct(m.prop.alias("an"), m.by_property.alias("av"))), lambda p: p.av != ""))
        .when(raw, F.array_append(pairs, F.struct(F.lit(BODY).alias("an"), raw_body(F.col("tag")).alias("av"))))
        .otherwise(pairs)
    ).cast(pair)
    return els.select(
        "page_id", "page_url", "pos", "name", "in_picture", "picture", "lead_image", attr("type").alias("type"),
        F.array_contains("names", "src").alias("has_src"), F.inline_outer(rows)).filter(F.col("av").isNotNull())


def raw_refs(els: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Unresolved media references of every element: one row each, in no particular order. Narrow.

    (rank, a, a2, b, c) is the order the sources are read in: source, element, part, list position.
    """
    rows = attribute_rows(els).select(
        "page_id", "page_url", "pos", "name", "picture", F.inline_outer(_attribute_refs(limits.max_script_chars)))
    of_picture = F.col("rank") == RANK["picture"]
    image = of_picture & (F.col("name") == "img")
    return rows.filter(F.col("url").isNotNull()).select(
        "page_id", "page_url", "rank", F.when(of_picture, F.col("picture")).otherwise(F.col("pos")).alias("a"),
        F.when(image, 2_000_000_000).when(of_picture, F.col("pos")).otherwise(0).alias("a2"), "b", "c", "url", "tag", "ext")


def resolve_refs(refs: DataFrame) -> DataFrame:
    """Absolute http(s) URLs; anchors only when they point at a media file."""
    done = with_resolved(refs, "url", "page_url", "full").filter(is_http(F.col("full")))
    anchor = F.col("rank") == RANK["a"]
    return done.filter(~anchor | is_media_extension(url_extension(F.col("full"))))


def dedup_assets(refs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """First reference per URL, then the extension rule, then names; a per-page bound only if ``limits`` has one.

    All windows are keyed by page, so one exchange by ``page_id`` serves them; a page is bounded by its
    admitted size.
    """
    order = ["rank", "a", "a2", "b", "c"]
    first = W.partitionBy("page_id", "key").orderBy(*order)
    # placed by page before the (page, url) window so that both windows share this one exchange
    placed = refs.select("page_id", *order, "full", "tag", "ext", strip_fragment(F.col("full")).alias("key"))
    placed = placed.repartition("page_id")
    unique = placed.withColumn("_n", F.row_number().over(first)).filter("_n = 1")
    own = F.col("own_ext")
    fitting = settle(unique, own_ext=url_extension(F.col("full")))
    fitting = fitting.withColumn("inferred", ~is_media_extension(own) & F.col("ext").isNotNull())
    fitting = fitting.filter(is_media_extension(own) | is_media_extension(F.col("ext")))
    fitting = fitting.withColumn("extension", F.when(F.col("inferred"), F.col("ext")).otherwise(own))
    ranked = fitting.withColumn("ord", F.row_number().over(W.partitionBy("page_id").orderBy(*order)))
    ranked = ranked.filter(at_most(F.col("ord"), limits.max_assets))
    numbered = F.concat(F.lit("media-"), F.col("ord").cast("string"), F.lit("."), F.col("extension"))
    raw_name = F.when(F.col("inferred"), numbered).otherwise(file_name_from_url(F.col("full"), F.col("ord")))
    return ranked.select(
        "page_id", "ord", F.col("full").alias("url"), media_type(F.col("extension")).alias("type"),
        sanitize_file_name(raw_name, numbered).alias("file_name"), "extension", F.col("tag").alias("source_tag"))


def extract_media(pages: DataFrame, player_scripts: DataFrame | None = None, limits: Limits = Limits(), els: DataFrame | None = None) -> DataFrame:
    """Assets of every page: page_id, ord, url, type, file_name, extension, source_tag. ``els``: a stored ``elements`` table of the pages.

    With ``player_scripts`` the elements are read twice, so they are stored first and the HTML is read once.
    """
    if els is None:
        els = elements(pages) if player_scripts is None else written(elements(pages), "elements")
    refs = raw_refs(els, limits)
    if player_scripts is not None:
        videos = player_videos(pages, player_scripts, limits, els)
        refs = refs.unionByName(videos.select(
            "page_id", "page_url", F.lit(RANK["player"]).alias("rank"), F.col("ref_order").alias("a"), F.lit(0).alias("a2"),
            F.col("video_order").alias("b"), F.lit(0).alias("c"), F.col("video_url").alias("url"),
            F.concat(F.lit("vturb["), F.col("player_id"), F.lit("]")).alias("tag"),
            video_extension(F.col("video_url")).alias("ext")))
    return dedup_assets(resolve_refs(refs), limits)


def page_links(pages: DataFrame) -> DataFrame:
    """Distinct http(s) links of each page without fragment, with the order of first appearance."""
    anchors = elements_named(pages, "a").select("page_id", "page_url", "pos", attr("href").alias("href"))
    full = with_resolved(anchors.filter(F.col("href") != ""), "href", "page_url", "full").filter(is_http(F.col("full")))
    return full.groupBy("page_id", strip_fragment(F.col("full")).alias("url")).agg(F.min("pos").alias("pos"))


def elements_named(pages: DataFrame, name: str) -> DataFrame:
    """Start tags of one name with their attributes, for jobs that need no ancestry. Narrow."""
    tags = pages.select("page_id", F.col("url").alias("page_url"), F.posexplode_outer(
        tokens_of(F.col("html"))).alias("pos", "tag"))
    return with_attributes(tags.filter(F.col("tag").rlike(rf"(?i)^<{name}[\s/>]")), "tag")


# ---- player scripts --------------------------------------------------------------------------------


def script_refs(els: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Player-script references of each page: tag src, the two scripts an iframe implies, inline strings."""
    name = F.col("name")
    text = F.when(attr("src").isNull() & at_most(utf16_length(raw_body(F.col("tag"))), limits.max_script_chars),
                  raw_body(F.col("tag")))
    strings = F.when(text.rlike(PLAYER_INLINE_HINT), F.regexp_extract_all(text, F.lit(PLAYER_INLINE_SRC), F.lit(1)))
    frame = F.coalesce(attr("src"), attr("data-src"))
    item = "array<struct<part:int,url:string>>"
    found = (
        F.when((name == "script") & present(attr("src")).isNotNull(), F.array(F.struct(F.lit(1), attr("src"))).cast(item))
        .when((name == "iframe") & (frame != ""), F.array(F.struct(F.lit(2), frame)).cast(item))
        .when(name == "script", F.transform(strings, lambda u: F.struct(F.lit(3).alias("part"), u.alias("url"))).cast(item))
    )
    rows = els.filter(name.isin("script", "iframe")).select(
        "page_id", "page_url", "pos", F.posexplode_outer(found).alias("k", "r")).filter(F.col("r").isNotNull())
    rows = rows.select("page_id", "page_url", "pos", "k", "r.part", F.col("r.url").alias("raw"))
    rows = with_resolved(rows, "raw", "page_url", "full")
    src = F.when(F.col("part") == 3, F.col("raw")).otherwise(F.col("full"))
    rows = rows.withColumn("src", src).filter((F.col("part") == 3) | F.col("src").rlike(PLAYER_SCRIPT_SRC))
    by_path = F.regexp_extract("src", PLAYER_PATH, 1) != ""
    pattern_ok = by_path | ((F.col("part") != 2) & (F.regexp_extract("src", PLAYER_AB_PATH, 1) != ""))
    rows = rows.filter(pattern_ok).withColumns({
        "account_id": F.when(by_path, F.regexp_extract("src", PLAYER_PATH, 1)).otherwise(
            F.regexp_extract("src", PLAYER_AB_PATH, 1)),
        "player_id": F.when(by_path, F.regexp_extract("src", PLAYER_PATH, 2)).otherwise(
            F.regexp_extract("src", PLAYER_AB_PATH, 2)),
    })
    root = F.regexp_replace("src", r"/(embed\.html|player\.js).*$", "")
    scripts = F.when(F.col("part") == 2, F.array(F.concat(root, F.lit("/v4/player.js")), F.concat(root, F.lit("/player.js")))
                     ).otherwise(F.array("src"))
    rows = rows.select("page_id", "page_url", "account_id", "player_id", "part", "pos", "k",
                       F.posexplode(scripts).alias("j", "src"))
    return rows.groupBy("page_id", "page_url", "account_id", "player_id", "src").agg(
        F.min(F.struct("part", "pos", "k", "j")).alias("at"))


def parse_player_scripts(scripts: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Videos named by each captured player script: script_url, videos array<struct<url,thumbnail>>."""
    body = F.col("body")
    ok = (
        F.lower("content_type").rlike(PLAYER_CONTENT_TYPES) & (body != "")
        & at_most(utf16_length(body), limits.max_player_script_chars)
    )
    cdn, oid, vid = (F.regexp_extract(body, p, 1) for p in (PLAYER_CDN, PLAYER_OID, PLAYER_VIDEO))
    cover = present(F.regexp_extract(body, PLAYER_COVER, 1))
    video = "array<struct<url:string,thumbnail:string>>"
    built = F.array(F.struct(
        F.concat(F.lit("https://"), cdn, F.lit("/"), oid, F.lit("/"), vid, F.lit("/main.m3u8")).alias("url"),
        cover.alias("thumbnail"))).cast(video)
    legacy = F.array_distinct(F.filter(
        F.concat(*[F.regexp_extract_all(body, F.lit(p), F.lit(1)) for p in PLAYER_LEGACY]),
        lambda u: ~u.rlike(PLAYER_LEGACY_STATIC) & u.rlike(PLAYER_LEGACY_VIDEO)))
    listed = F.transform(legacy, lambda u: F.struct(u.alias("url"), F.lit(None).cast("string").alias("thumbnail"))).cast(video)
    full = (cdn != "") & (oid != "") & (vid != "")
    return scripts.filter(ok).select(
        F.col("src").alias("script_url"), F.when(full, built).otherwise(listed).alias("videos"))


def player_videos(pages: DataFrame, player_scripts: DataFrame, limits: Limits = Limits(), els: DataFrame | None = None):
    """Videos behind the player scripts of each page, first script per video URL.

    ``player_scripts(src, content_type, body)`` stands in for fetching. The join side is chosen by the engine
    from run-time sizes; a script shared by a large share of pages is split by adaptive skew handling.
    """
    refs = script_refs(elements(pages) if els is None else els, limits)
    # one body per script address, whatever number of captures there are
    bodies = player_scripts.groupBy("src").agg(F.min(F.struct("content_type", "body")).alias("f")).select("src", "f.*")
    joined = refs.join(parse_player_scripts(bodies, limits), F.col("src") == F.col("script_url"))
    rows = joined.select("page_id", "page_url", "account_id", "player_id", "src", "at",
                         F.posexplode("videos").alias("video_order", "v"))
    rows = rows.select("*", F.col("v.url").alias("video_url"), F.col("v.thumbnail").alias("thumbnail")).drop("v")
    first = W.partitionBy("page_id", "video_url").orderBy("at", "video_order")
    kept = rows.withColumn("_n", F.row_number().over(first)).filter("_n = 1")
    order = W.partitionBy("page_id").orderBy("at", "video_order")
    return kept.withColumn("ref_order", F.row_number().over(order)).select(
        "page_id", "page_url", "account_id", "player_id", F.col("src").alias("script_url"), "video_url", "thumbnail",
        "ref_order", "video_order")


__all__ = ["extract_media", "raw_refs", "resolve_refs", "dedup_assets", "page_links", "script_refs", "player_videos",
           "parse_player_scripts"]
