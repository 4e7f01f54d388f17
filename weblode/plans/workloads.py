"""The registered queries: every operator over the whole supplied tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weblode.config import CrawlConfig, ShallowConfig
from weblode.functions.files import (
    content_disposition, extension_from_mime, file_name_from_url, is_allowed_content_type, media_type, sanitize_file_name,
)
from weblode.functions.platforms import is_platform_domain, with_platform
from weblode.functions.text import settle
from weblode.functions.urls import (
    canonical_url, compact_url, host_of, is_private_host, is_subdomain, same_domain, strip_fragment, truncate_url,
    url_extension, with_resolved,
)
from weblode.operators import admission, analyse, crawl, embeds, fetchlog, links, media, results, tokens
from weblode.plans.bases import base
from weblode.plans.enrich import enriched, linked
from weblode.sources.pages import follow_assets, read_assets, scan_pages, spread, stream_pages
from weblode.sources.stages import stage_folder, written
from weblode.streaming import events, limiter

CRAWL = CrawlConfig(follow_external=True)
SHALLOW = ShallowConfig(same_host_only=False)
FILTER = results.MediaFilter(query="FÜR", availability="downloadable", confidence="low", show_empty_pages=True)
DAY_MS = 86_400_000


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(scan_pages(spark, f"{sf_dir}/pages.parquet"), "page_id")


def _rich(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enriched(_pages(spark, sf_dir))


# ---- html ----------------------------------------------------------------------------------------------


def page_links(spark, sf_dir):
    return media.page_links(_pages(spark, sf_dir))


def page_facts(spark, sf_dir):
    return tokens.page_facts(_pages(spark, sf_dir))


def tag_counts(spark, sf_dir):
    tags = tokens.tag_table(_rich(spark, sf_dir))
    return tags.groupBy("name", "kind").agg(F.count("*").alias("n"), F.countDistinct("page_id").alias("pages"))


def tags_inside(spark, sf_dir):
    tags = tokens.with_inside(tokens.tag_table(_rich(spark, sf_dir)), "nav", "header", "footer")
    opened = tags.filter((F.col("name") == "a") & (F.col("kind") == "open"))
    return opened.groupBy("page_id").agg(F.count_if("inside").alias("inside"), F.count_if(~F.col("inside")).alias("outside"))


def url_normalise(spark, sf_dir):
    rows = with_resolved(_pages(spark, sf_dir).select("page_id", "url").withColumn("b", F.col("url")), "url", "b", "full")
    u, home = F.col("full"), F.lit("https://example.com/")
    return rows.select(
        "page_id", canonical_url(u).alias("crawl_key"), strip_fragment(u).alias("dedup_key"), host_of(u).alias("host"),
        url_extension(u).alias("extension"), compact_url(u).alias("compact"), truncate_url(u).alias("short"),
        is_private_host(host_of(u)).alias("private"), is_subdomain(u, F.lit("https://www.example.com")).alias("subdomain"),
        same_domain(u, home).alias("same"), is_platform_domain(u).alias("platform_domain"))


def extract_media(spark, sf_dir):
    return media.extract_media(_rich(spark, sf_dir), base(spark, sf_dir, "player_scripts"))


def streamed_assets(spark, sf_dir):
    """The flagship over pages that arrive as a stream, read back from its sink."""
    folder = f"{stage_folder(spark)}/streamed-{uuid.uuid4().hex}"
    _rich(spark, sf_dir).repartition(4, "page_id").write.parquet(f"{folder}/pages")
    scripts = written(base(spark, sf_dir, "player_scripts"), "player-scripts")
    follow_assets(stream_pages(spark, f"{folder}/pages", 2), lambda pages: media.extract_media(pages, scripts), f"{folder}/assets", f"{folder}/checkpoint").awaitTermination()
    return read_assets(spark, f"{folder}/assets").drop("batch")


def analyse_pages(spark, sf_dir):
    return analyse.analyse_pages(base(spark, sf_dir, "page_bodies"), base(spark, sf_dir, "player_scripts"))[1]


def analysed_assets(spark, sf_dir):
    return analyse.analyse_pages(base(spark, sf_dir, "page_bodies"), base(spark, sf_dir, "player_scripts"))[0]


def media_by_source(spark, sf_dir):
    return extract_media(spark, sf_dir).groupBy("source_tag", "type", "extension").agg(
        F.count("*").alias("assets"), F.countDistinct("page_id").alias("pages"))


def player_videos(spark, sf_dir):
    pages = _rich(spark, sf_dir)
    scripts = base(spark, sf_dir, "player_scripts")
    return media.player_videos(pages, scripts).select(
        "page_id", "account_id", "player_id", "script_url", "video_url", "thumbnail")


def discover_links(spark, sf_dir):
    return links.discover_links(_rich(spark, sf_dir)).drop("page_url")


def link_priorities(spark, sf_dir):
    found = links.discover_links(_rich(spark, sf_dir))
    return found.groupBy("category", "source", "priority", "is_navigation").agg(F.count("*").alias("links"))


def possible_spa(spark, sf_dir):
    pages = _pages(spark, sf_dir)
    return links.possible_spa(pages, links.discover_links(pages)).select("page_id", "title", "link_count", "possible_spa")


def discover_embeds(spark, sf_dir):
    return embeds.discover_embeds(_rich(spark, sf_dir)).drop("page_url", "key")


def classify_platform(spark, sf_dir):
    rows = with_platform(base(spark, sf_dir, "platform_urls"), "url", "info")
    return rows.select("url", "info.*")


def classify_platform_strict(spark, sf_dir):
    rows = with_platform(base(spark, sf_dir, "platform_urls"), "url", "info", "strict")
    return rows.groupBy("info.platform", "info.kind").agg(F.count("*").alias("n"))


def file_names(spark, sf_dir):
    docs = base(spark, sf_dir, "file_urls")
    u, n = F.col("url"), F.col("ordinal")
    raw = file_name_from_url(u, n)
    return docs.select(
        "doc_id", sanitize_file_name(raw, F.lit("download")).alias("file_name"),
        sanitize_file_name(F.col("title"), F.lit("download")).alias("safe_title"),
        media_type(url_extension(u)).alias("type"), extension_from_mime(F.col("mime")).alias("mime_extension"),
        is_allowed_content_type(F.col("mime")).alias("allowed"))


def content_dispositions(spark, sf_dir):
    docs = base(spark, sf_dir, "file_urls")
    return docs.select("doc_id", content_disposition(F.col("title")).alias("header"))


# ---- crawl -----------------------------------------------------------------------------------------------


def _graph(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    pages = _pages(spark, sf_dir).select("page_id", "url")
    seeds = pages.select(F.col("page_id").alias("crawl_id"), "url")
    edges = with_resolved(base(spark, sf_dir, "link_graph").withColumn("b", F.col("page_url")), "url", "b", "full")
    edges = edges.withColumn("key", canonical_url(F.col("full"))).drop("b", "full")
    return pages, seeds, edges


def deep_crawl(spark, sf_dir):
    pages, seeds, edges = _graph(spark, sf_dir)
    found = crawl.deep_crawl(seeds, pages, edges, CRAWL)
    return found.select("crawl_id", "depth", "claim", "claimed", "page_id", "category", "discovery_reason")


def discovery_edges(spark, sf_dir):
    pages, seeds, edges = _graph(spark, sf_dir)
    return crawl.discovery_edges(crawl.deep_crawl(seeds, pages, edges, CRAWL)).groupBy(
        "crawl_id", "depth", "category", "source", "discovery_reason").agg(F.count("*").alias("edges"))


def fetch_outcomes(spark, sf_dir):
    return fetchlog.fetch_outcomes(base(spark, sf_dir, "crawl_fetches"))


def deep_crawl_logged(spark, sf_dir):
    pages, seeds, edges = _graph(spark, sf_dir)
    found = fetchlog.deep_crawl_logged(seeds, pages, edges, base(spark, sf_dir, "crawl_fetches"), CRAWL)
    return found.select("crawl_id", "depth", "claim", "claimed", "page_id", "url", "final_url", "hops", "attempt", "error", "discovery_reason")


def _logged_results(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    pages, seeds, edges = _graph(spark, sf_dir)
    found = fetchlog.deep_crawl_logged(seeds, pages, edges, base(spark, sf_dir, "crawl_fetches"), CRAWL)
    stats = crawl.link_stats(edges.withColumn("interactive", F.col("source") != "anchor"))
    nothing = found.select("crawl_id", "page_id", "claim").limit(0)
    return found, crawl.classify_pages(crawl.crawled_pages(found), nothing, stats, tokens.page_facts(_pages(spark, sf_dir)))


def classify_pages_logged(spark, sf_dir):
    return _logged_results(spark, sf_dir)[1].drop("discovered_from")


def crawl_summary_logged(spark, sf_dir):
    return crawl.crawl_summary(_logged_results(spark, sf_dir)[1])


def crawl_events_logged(spark, sf_dir):
    """Errors and ends of the logged crawls as events."""
    found, page_results = _logged_results(spark, sf_dir)
    shown = found.select("crawl_id", "depth", "claim", F.lit(1).alias("ord"), F.col("url").alias("page_url"), *[F.lit(None).cast("string").alias(m) for m in crawl.MEDIA if m != "url"], "url").limit(0)
    log = crawl.emit_crawl_events(found, page_results, shown, CRAWL).filter("event IN ('page_error', 'crawl_complete')")
    return _members(log, {
        "url": "url", "error": "error", "total_pages": "totalPages", "with_errors": "pagesWithErrors", "duration": "crawlDurationMs"}, "depth", "a")


#: Members of the events' payloads that the queries show, as texts.
_SHOWN = ("url STRING, category STRING, source STRING, fromUrl STRING, discoveryReason STRING, pagesDone STRING, pagesTotal STRING, mediaCount STRING, "
          "error STRING, pageUrl STRING, media STRUCT<url:STRING,platform:STRING>, originalUrl STRING, totalPages STRING, pagesWithErrors STRING, "
          "totalMedia STRING, config STRUCT<maxPages:STRING,followExternal:STRING>, crawlDurationMs STRING, "
          "results ARRAY<STRUCT<url:STRING,pageKind:STRING,mediaCount:STRING>>")


def _members(log: DataFrame, fields: dict[str, str], *seq: str) -> DataFrame:
    """Events with members of their payloads, which are parsed once a row and not once a member."""
    def member(path: str):
        return F.get(F.col("_d.results"), 0)[path.split(".")[1]] if path.startswith("results[0].") else F.col(f"_d.{path}")

    parsed = settle(log, _d=F.from_json("data", _SHOWN))
    return parsed.select("crawl_id", *[F.col(f"seq.{k}").alias(k) for k in seq], "event", *[member(path).alias(name) for name, path in fields.items()])


def stages(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Links, assets and embeds of the linked pages, each written for the steps that follow."""
    pages = written(linked(_pages(spark, sf_dir)), "pages")
    els = written(tokens.elements(pages, text=True), "elements")  # the HTML is read once for all three
    made = {"pages": pages, "links": written(links.discover_links(pages, els=els), "links"),
            "assets": written(media.extract_media(pages, base(spark, sf_dir, "player_scripts"), els=els), "assets"),
            "embeds": written(embeds.discover_embeds(pages, els=els), "embeds")}
    made["media"] = written(
        crawl.merge_page_media(made["assets"], made["embeds"], made["links"], pages, CRAWL), "media")
    return made


def _crawled(spark, sf_dir) -> tuple[dict[str, DataFrame], DataFrame]:
    s = stages(spark, sf_dir)
    seeds = s["pages"].select(F.col("page_id").alias("crawl_id"), "url")
    return s, crawl.deep_crawl(seeds, s["pages"], s["links"], CRAWL)


def _results(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    s, crawled = _crawled(spark, sf_dir)
    visited = crawl.crawled_pages(crawled)
    kept = crawl.dedup_media_across_pages(visited, s["media"])
    page_results = crawl.classify_pages(visited, kept, crawl.link_stats(s["links"]), tokens.page_facts(s["pages"]))
    return crawled, page_results, kept


def merge_page_media(spark, sf_dir):
    return stages(spark, sf_dir)["media"].drop("key")


def dedup_media_across_pages(spark, sf_dir):
    _, _, kept = _results(spark, sf_dir)
    return kept.select("crawl_id", "claim", "page_id", "ord", "key")


def classify_pages(spark, sf_dir):
    return _results(spark, sf_dir)[1].drop("discovered_from")


def crawl_summary(spark, sf_dir):
    return crawl.crawl_summary(_results(spark, sf_dir)[1])


def emit_crawl_events(spark, sf_dir):
    crawled, page_results, kept = _results(spark, sf_dir)
    log = crawl.emit_crawl_events(crawled, page_results, kept, CRAWL)
    fields = {
        "url": "url", "category": "category", "source": "source", "from_url": "fromUrl", "reason": "discoveryReason", "pages_done": "pagesDone",
        "pages_total": "pagesTotal", "media_count": "mediaCount", "error": "error", "page_url": "pageUrl", "media_url": "media.url",
        "media_platform": "media.platform", "original_url": "originalUrl", "total_pages": "totalPages", "with_errors": "pagesWithErrors",
        "total_media": "totalMedia", "max_pages": "config.maxPages", "external": "config.followExternal", "first_url": "results[0].url",
        "first_kind": "results[0].pageKind", "first_media": "results[0].mediaCount"}
    return _members(log, fields, "depth", "stage", "a", "b", "c")


def crawl_event_counts(spark, sf_dir):
    crawled, page_results, kept = _results(spark, sf_dir)
    log = crawl.emit_crawl_events(crawled, page_results, kept, CRAWL)
    return log.groupBy("crawl_id", "event").agg(F.count("*").alias("n"))


def crawl_report(spark, sf_dir):
    _, page_results, kept = _results(spark, sf_dir)
    flat = results.flatten_media(crawl.crawl_report(page_results, kept))
    return flat.groupBy("crawl_id", "claim", "page_url").agg(F.count("*").alias("media"))


def shallow_crawl(spark, sf_dir):
    s = stages(spark, sf_dir)
    seeds = s["pages"].select(F.col("page_id").alias("crawl_id"), "url")
    scanned, assets = crawl.shallow_crawl(seeds, s["pages"], media.page_links(s["pages"]), s["assets"], SHALLOW)
    found = assets.groupBy("crawl_id", "claim").agg(F.count("*").alias("assets"), F.min("asset_ord").alias("first_asset"))
    return scanned.join(found, ["crawl_id", "claim"], "left").fillna(0, ["assets"]).select(
        "crawl_id", "depth", "claim", "url", "page_id", "assets", "first_asset")


# ---- results -------------------------------------------------------------------------------------------------


def _shown(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    return base(spark, sf_dir, "page_results"), base(spark, sf_dir, "media")


def media_counts(spark, sf_dir):
    return results.count_by_type(_shown(spark, sf_dir)[1], "crawl_id")


def media_facets(spark, sf_dir):
    return results.facets(_shown(spark, sf_dir)[1])


def page_kind_facet(spark, sf_dir):
    return results.page_kind_facet(_shown(spark, sf_dir)[0])


def search_media(spark, sf_dir):
    pages, rows = _shown(spark, sf_dir)
    return results.filter_media(pages, rows, results.MediaFilter(query="FÜR")).select("crawl_id", "claim", "ord", "url")


def filter_media(spark, sf_dir):
    pages, rows = _shown(spark, sf_dir)
    f = results.MediaFilter(availability="link_only", type="video", platform="peertube", confidence="medium", page_kind="hub")
    return results.filter_media(pages, rows, f).select("crawl_id", "claim", "ord", "url", "confidence")


def page_entries(spark, sf_dir):
    pages, rows = _shown(spark, sf_dir)
    return results.page_entries(pages, results.filter_media(pages, rows, FILTER), FILTER)


def selection_ops(spark, sf_dir):
    pages, rows = _shown(spark, sf_dir)
    chosen, keys = base(spark, sf_dir, "selected"), ["crawl_id", "url"]
    visible = results.filter_media(pages, rows, results.MediaFilter(availability="downloadable"))
    pruned = results.prune_selection(chosen, visible, keys)
    parts = {
        "pruned": pruned,
        "toggled": results.toggle(pruned, visible.filter("type = 'image'"), keys),
        "group": results.toggle_group(pruned, visible.filter("url LIKE '%.png'"), keys, "crawl_id"),
    }
    out = None
    for name, df in parts.items():
        part = df.select(F.lit(name).alias("op"), *keys)
        out = part if out is None else out.unionByName(part)
    return out


def assets_for_bundle(spark, sf_dir):
    pages, rows = _shown(spark, sf_dir)
    visible = results.filter_media(pages, rows, results.MediaFilter())
    titled = visible.withColumn("title", F.concat(F.lit("t:"), F.col("video_id")))
    return results.assets_for_bundle(titled, base(spark, sf_dir, "selected"))


def display_fields(spark, sf_dir):
    _, rows = _shown(spark, sf_dir)
    return results.display_fields(rows).select(
        "url", "platform_label", "kind_label", "reason_label", "confidence_percent", "external_url", "shown_thumbnail")


def gallery_page(spark, sf_dir):
    _, rows = _shown(spark, sf_dir)
    return results.gallery_page(rows, "crawl_id", 1, 24, "video").select("crawl_id", "ord", "url", "shown")


# ---- admission ---------------------------------------------------------------------------------------------------


def admit_pages_analyse(spark, sf_dir):
    rows = admission.admit_pages(base(spark, sf_dir, "page_fetches"), "analyse")
    return rows.groupBy("error_code", "status").agg(F.count("*").alias("n"))


def admit_pages_crawl(spark, sf_dir):
    return admission.admit_pages(base(spark, sf_dir, "page_fetches"), "crawl").select("url", "attempt", "error_code")


def resolve_retries(spark, sf_dir):
    return admission.resolve_retries(base(spark, sf_dir, "page_fetches")).select("url", "attempt", "status")


def resolve_redirects(spark, sf_dir):
    table = base(spark, sf_dir, "redirects")
    return admission.resolve_redirects(table.select("url"), table)


def host_safety(spark, sf_dir):
    return admission.host_safety(base(spark, sf_dir, "hosts"), base(spark, sf_dir, "dns_answers")).select("id", "url", "verdict")


def validate_seeds(spark, sf_dir):
    return admission.validate_seeds(base(spark, sf_dir, "seeds")).select("id", "seed_url", "error_code")


def admit_assets(spark, sf_dir):
    return admission.admit_assets(base(spark, sf_dir, "asset_fetches")).select("id", "error_code", "file_name")


def bundle_entries(spark, sf_dir):
    return admission.bundle_manifest(base(spark, sf_dir, "bundle_assets"), base(spark, sf_dir, "asset_fetches"))[0]


def bundle_status(spark, sf_dir):
    return admission.bundle_manifest(base(spark, sf_dir, "bundle_assets"), base(spark, sf_dir, "asset_fetches"))[1]


# ---- events --------------------------------------------------------------------------------------------------------


def parse_events(spark, sf_dir):
    return events.parse_events(base(spark, sf_dir, "crawl_events")).select("crawl_id", "event_id", "event", "valid", "reason")


def crawl_progress(spark, sf_dir):
    return events.crawl_progress(base(spark, sf_dir, "crawl_events"))


def crawl_status(spark, sf_dir):
    return events.crawl_status(base(spark, sf_dir, "crawl_events"))


def activity_tail(spark, sf_dir):
    return events.activity_tail(events.activity_log(base(spark, sf_dir, "crawl_events")))


def _requests(events: DataFrame) -> DataFrame:
    # the stored times carry no zone; read as UTC whatever the session's zone is
    utc = F.concat(F.col("ts").cast("timestamp_ntz").cast("string"), F.lit("Z")).cast("timestamp")
    return events.select(F.col("user_id").cast("string").alias("client"), F.unix_millis(utc).alias("at_ms"), F.col("event_id").alias("request_id"))


def rate_limit(spark, sf_dir):
    return limiter.rate_limit(_requests(spark.read.parquet(f"{sf_dir}/events.parquet")), DAY_MS, 2)


def rate_limit_busy(spark, sf_dir):
    """One client makes half of all requests; windows of an hour."""
    log = _requests(spark.read.parquet(f"{sf_dir}/events.parquet"))
    busy = log.withColumn("client", F.when(F.col("request_id") % 2 == 0, "busy").otherwise(F.col("client")))
    return limiter.rate_limit(busy, 3_600_000, 3)


def _ended(stream: DataFrame, name: str) -> DataFrame:
    """Run a stream over what is there and read what it put out."""
    spark = stream.sparkSession
    folder = f"{stage_folder(spark)}/{name}-{uuid.uuid4().hex}"
    stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").outputMode("append").trigger(
        availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def rate_limit_stream(spark, sf_dir):
    """The limiter as a stream with a state for each open window."""
    folder = f"{stage_folder(spark)}/requests-{uuid.uuid4().hex}"
    log = _requests(spark.read.parquet(f"{sf_dir}/events.parquet"))
    log.write.parquet(folder)
    return _ended(limiter.rate_limit_stream(spark.readStream.schema(log.schema).parquet(folder), DAY_MS, 2), "limiter")


def activity_tail_stream(spark, sf_dir):
    """The activity log followed as a stream of JSON files; the tail is what its changes add up to."""
    folder = f"{stage_folder(spark)}/events-{uuid.uuid4().hex}"
    base(spark, sf_dir, "crawl_events").select(
        "crawl_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("ts"), "event", "data").write.json(folder)
    return events.current_tail(_ended(events.tail_changes(events.read_crawl_events(spark, folder)), "tail"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        page_links, page_facts, tag_counts, tags_inside, url_normalise, extract_media, streamed_assets, analyse_pages, analysed_assets, media_by_source, player_videos,
        discover_links, link_priorities, possible_spa, discover_embeds, classify_platform, classify_platform_strict,
        file_names, content_dispositions, deep_crawl, discovery_edges, fetch_outcomes, deep_crawl_logged, classify_pages_logged,
        crawl_summary_logged, crawl_events_logged, merge_page_media, dedup_media_across_pages,
        classify_pages, crawl_summary, emit_crawl_events, crawl_event_counts, crawl_report, shallow_crawl, media_counts, media_facets,
        page_kind_facet, search_media, filter_media, page_entries, selection_ops, assets_for_bundle, display_fields,
        gallery_page, admit_pages_analyse, admit_pages_crawl, resolve_retries, resolve_redirects, host_safety,
        validate_seeds, admit_assets, bundle_entries, bundle_status, parse_events, crawl_progress, crawl_status,
        activity_tail, rate_limit, rate_limit_busy, rate_limit_stream, activity_tail_stream)
}
