"""Queries over crawl results: facets, search, filters, pages, selections, labels."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weblode.functions.files import sanitize_file_name
from weblode.functions.fixed import KIND_LABELS, PAGE_KIND_LABELS, PLATFORM_LABELS, RESULT_REASON_LABELS
from weblode.functions.text import at_most
from weblode.functions.urls import is_media_extension, public_url_error


@dataclass(frozen=True)
class MediaFilter:
    """Conjunction of the result filters; "all" leaves one out."""

    query: str = ""
    availability: str = "all"  # all | downloadable | link_only
    type: str = "all"  # all | image | video
    platform: str = "all"  # a platform, or "none" for media without one
    content_kind: str = "all"
    page_kind: str = "all"
    confidence: str = "all"  # all | high | medium | low
    show_empty_pages: bool = False


def flatten_media(report: DataFrame) -> DataFrame:
    """Nested page results to media rows."""
    return report.select("crawl_id", "claim", F.col("url").alias("page_url"), F.inline("media"))


def count_by_type(media: DataFrame, *by: str) -> DataFrame:
    image = F.col("type") == "image"
    return media.groupBy(*by).agg(
        F.count_if(image).alias("images"), F.count_if(~image).alias("videos"), F.count("*").alias("total"))


def facets(media: DataFrame) -> DataFrame:
    """Distinct platforms and content kinds in use."""
    pairs = F.array(F.struct(F.lit("platform").alias("facet"), F.col("platform").alias("value")),
                    F.struct(F.lit("content_kind").alias("facet"), F.col("content_kind").alias("value")))
    return media.select(F.inline(pairs)).filter(F.col("value") != "").distinct()


def page_kind_facet(page_results: DataFrame) -> DataFrame:
    """Page kinds of each crawl in the order they first appear."""
    seen = page_results.groupBy("crawl_id", "page_kind").agg(F.min("claim").alias("first_claim"))
    order = W.partitionBy("crawl_id").orderBy("first_claim")
    return seen.select("crawl_id", "page_kind", F.row_number().over(order).alias("ord"))


def folded_contains(text: Column, needle: str) -> Column:
    """Substring test that ignores case and accents."""
    if not needle:
        return F.lit(True)
    return F.contains(F.collate(text, "UNICODE_CI_AI"), F.collate(F.lit(needle), "UNICODE_CI_AI"))


def joined_text(*names: str) -> Column:
    """Fields joined by single spaces, a missing one counting as empty."""
    return F.concat_ws(" ", *[F.coalesce(F.col(n).cast("string"), F.lit("")) for n in names])


def page_matches(needle: str) -> Column:
    return folded_contains(joined_text("title", "url", "discovered_from", "discovery_reason", "page_kind"), needle)


def media_matches(needle: str) -> Column:
    return folded_contains(joined_text(
        "media_title", "media_url", "canonical_url", "platform", "source", "media_reason", "content_kind"), needle)


def confidence_at_least(tier: str) -> Column:
    """Nested tiers; media without a confidence only shows under "all"."""
    floors = {"high": 0.9, "medium": 0.75, "low": 0.5}
    return F.lit(True) if tier == "all" else F.coalesce(F.col("confidence") >= floors[tier], F.lit(False))


def media_condition(f: MediaFilter) -> Column:
    keep = confidence_at_least(f.confidence)
    if f.availability == "downloadable":
        keep = keep & F.col("downloadable")
    elif f.availability == "link_only":
        keep = keep & ~F.col("downloadable")
    if f.type != "all":
        keep = keep & (F.col("type") == f.type)
    if f.platform != "all":
        keep = keep & (F.coalesce("platform", F.lit("none")) == f.platform)
    if f.content_kind != "all":
        keep = keep & (F.coalesce("content_kind", F.lit("none")) == f.content_kind)
    return keep


def filter_media(page_results: DataFrame, media: DataFrame, f: MediaFilter = MediaFilter()) -> DataFrame:
    """Visible media: the filters, and the query matching either its page or itself."""
    needle = f.query.strip()
    pages = page_results
    if f.page_kind != "all":
        pages = pages.filter(F.col("page_kind") == f.page_kind)
    pages = pages.select("crawl_id", "claim", page_matches(needle).alias("page_matches"))
    rows = media.filter(media_condition(f)).withColumns({
        "media_title": F.col("title"), "media_url": F.col("url"), "media_reason": F.col("discovery_reason")})
    rows = rows.withColumn("self_matches", media_matches(needle)).drop("media_title", "media_url", "media_reason")
    joined = rows.join(pages, ["crawl_id", "claim"])
    return joined.filter(F.col("page_matches") | F.col("self_matches")).drop("page_matches", "self_matches")


def page_entries(page_results: DataFrame, visible: DataFrame, f: MediaFilter = MediaFilter()) -> DataFrame:
    """Pages to list, in order: pages with visible media first, then by depth."""
    counts = visible.groupBy("crawl_id", "claim").agg(
        F.count("*").alias("visible"), F.count_if("downloadable").alias("downloadable"))
    rows = page_results.withColumn("page_matches", page_matches(f.query.strip()))
    if f.page_kind != "all":
        rows = rows.filter(F.col("page_kind") == f.page_kind)
    rows = rows.join(counts, ["crawl_id", "claim"], "left").fillna(0, ["visible", "downloadable"])
    shown = F.col("visible") > 0
    if f.show_empty_pages:
        shown = shown | F.col("page_matches")
    order = W.partitionBy("crawl_id").orderBy(F.desc(F.col("visible") > 0), "depth", "claim")
    return rows.filter(shown).select(
        "crawl_id", "claim", "url", "depth", "page_kind", "visible", "downloadable",
        F.row_number().over(order).alias("entry"))


def gallery_page(assets: DataFrame, group: str, page: int = 1, size: int = 24, type_: str = "all") -> DataFrame:
    """The first ``page`` screens of ``size`` assets per group."""
    rows = assets if type_ == "all" else assets.filter(F.col("type") == type_)
    shown = rows.withColumn("shown", F.row_number().over(W.partitionBy(group).orderBy("ord", "url")))
    return shown.filter(F.col("shown") <= page * size)


# ---- selections: frames of (crawl_id, url) ------------------------------------------------------------


def prune_selection(selected: DataFrame, visible: DataFrame, keys: list[str]) -> DataFrame:
    """Drop what is no longer visible."""
    return selected.join(visible.select(*keys), keys, "left_semi")


def toggle(selected: DataFrame, items: DataFrame, keys: list[str]) -> DataFrame:
    """Flip each item on its own."""
    items = items.select(*keys).distinct()
    return selected.join(items, keys, "left_anti").unionByName(items.join(selected, keys, "left_anti"))


def toggle_group(selected: DataFrame, items: DataFrame, keys: list[str], group: str) -> DataFrame:
    """Per group: take all items out when every one is selected, else put all in."""
    items = items.select(*keys).distinct()
    missing = items.join(selected, keys, "left_anti").select(group).distinct()
    added = items.join(missing, group, "left_semi")
    full = items.join(missing, group, "left_anti")
    return selected.join(full, keys, "left_anti").unionByName(added.join(selected, keys, "left_anti"))


def assets_for_bundle(visible: DataFrame, selected: DataFrame | None = None, limit: int | None = None, title_chars: int = 80) -> DataFrame:
    """Downloadable visible media as bundle rows, numbered in each crawl; at most ``limit`` of them if it is set.

    Crawls with a selection give only what it names. A name is the first ``title_chars`` of
    the title; without title or id it is a hash of the URL.
    """
    rows = visible.filter("downloadable")
    if selected is not None:
        keys = ["crawl_id", "url"]
        with_any = rows.join(selected.select("crawl_id").distinct(), "crawl_id", "left_semi")
        rows = rows.join(selected.select("crawl_id").distinct(), "crawl_id", "left_anti").unionByName(
            with_any.join(selected.select(*keys), keys, "left_semi").select(*rows.columns))
    own = F.regexp_extract("url", r"\.([A-Za-z0-9_]{2,5})(?:[?#]|$)", 1)
    ext = F.when(own != "", own).when(F.col("type") == "video", "mp4").otherwise("jpg")
    safe = F.substring(F.regexp_replace("title", r"[/\\<>:\"|?*]+", "_"), 1, title_chars)
    stem = F.when(F.col("title") != "", safe).otherwise(F.concat(
        F.lit("media-"), F.coalesce("video_id", F.substring(F.md5("url"), 1, 16))))
    rows = rows.withColumn("extension", ext).withColumn("file_name", sanitize_file_name(
        F.concat(stem, F.lit("."), F.col("extension")), F.lit("download")))
    valid = rows.filter(is_media_extension(F.col("extension")) & (F.col("extension") == F.lower("extension"))
                        & public_url_error(F.col("url"), F.col("url")).isNull())
    order = W.partitionBy("crawl_id").orderBy("claim", "ord")
    return valid.withColumn("bundle_ord", F.row_number().over(order)).filter(
        at_most(F.col("bundle_ord"), limit)).select(
        "crawl_id", "bundle_ord", "url", F.upper("type").alias("type"), "file_name", "extension",
        F.col("source").alias("source_tag"))


# ---- display -------------------------------------------------------------------------------------------


def _label(value: Column, table: dict[str, str], other: Column) -> Column:
    """Look-up in a small constant table."""
    names = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.coalesce(F.try_element_at(names, value), other)


def platform_label(platform: Column) -> Column:
    first = F.upper(F.substring(platform, 1, 1))
    return _label(platform, PLATFORM_LABELS, F.concat(first, F.substr(platform, F.lit(2))))


def kind_label(kind: Column) -> Column:
    return _label(kind, KIND_LABELS, F.lit(None).cast("string"))


def page_kind_label(kind: Column) -> Column:
    return _label(kind, PAGE_KIND_LABELS, F.lit(None).cast("string"))


def reason_label(reason: Column, table: dict[str, str] = RESULT_REASON_LABELS) -> Column:
    return _label(reason, table, F.replace(reason, F.lit("-"), F.lit(" ")))


def display_fields(media: DataFrame) -> DataFrame:
    """Labels, confidence in percent, the URL to open and the picture to show."""
    return media.withColumns({
        "platform_label": platform_label(F.col("platform")), "kind_label": kind_label(F.col("content_kind")),
        "reason_label": reason_label(F.col("discovery_reason")),
        "confidence_percent": F.floor(F.col("confidence") * 100 + F.lit(0.5)).cast("int"),
        "external_url": F.coalesce("canonical_url", "url"),
        "shown_thumbnail": F.coalesce("thumbnail_url", F.when(F.col("type") != "video", F.col("url"))),
    })


def stat_value(filtered: Column, total: Column) -> Column:
    return F.when(filtered == total, total.cast("string")).otherwise(
        F.concat(filtered.cast("string"), F.lit("/"), total.cast("string")))


__all__ = ["MediaFilter", "flatten_media", "count_by_type", "facets", "page_kind_facet", "filter_media", "page_entries",
           "gallery_page", "prune_selection", "toggle", "toggle_group", "assets_for_bundle", "display_fields", "stat_value",
           "platform_label", "kind_label", "page_kind_label", "reason_label"]
