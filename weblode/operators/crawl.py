"""Bounded breadth-first crawls over captured pages, many crawls in one job.

Links, media and page facts are computed once for the corpus; a crawl is then at most three joins of a
narrow frontier with the link table. Every group a window sees is one crawl or one (crawl, URL), and a crawl
holds at most ``max_pages`` pages. A page that many crawls reach makes its join key hot; those joins carry no
hint, so adaptive skew handling can split them.
"""

from __future__ import annotations

import re
from dataclasses import asdict
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weblode.config import CrawlConfig, ShallowConfig
from weblode.functions.text import at_most
from weblode.functions.platforms import is_platform_domain, with_platform
from weblode.functions.urls import canonical_url, host_of, strip_fragment, with_resolved
from weblode.sources.stages import written


def absolute(df: DataFrame, url: str, out: str) -> DataFrame:
    return with_resolved(df.withColumn("_self", F.col(url)), url, "_self", out).drop("_self")


def page_index(pages: DataFrame, key=canonical_url) -> DataFrame:
    """One captured page per crawl key: the first by id, so copies of a page collapse map-side."""
    keyed = absolute(pages.select("page_id", "url"), "url", "full").select("page_id", key(F.col("full")).alias("key"))
    return keyed.groupBy("key").agg(F.min("page_id").alias("page_id"))


def followable(links: DataFrame, config: CrawlConfig = CrawlConfig()) -> DataFrame:
    """Links a crawl may queue, visited pages aside."""
    category = F.col("category")
    allowed = [
        name for name, on in (("same_domain", config.follow_same_domain), ("subdomain", config.follow_subdomains),
                              ("external", config.follow_external)) if on]
    keep = category.isin(allowed) & ~is_platform_domain(F.col("url"))
    if config.skip_navigation:
        keep = keep & ~F.col("is_navigation")
    return links.filter(keep)


def claim_budget(queue: DataFrame, max_pages: int) -> DataFrame:
    """Number the queue of each crawl behind the pages already done and mark what fits the budget.

    ``queue`` needs crawl_id, done, parent_claim, link_ord.
    """
    per_crawl = W.partitionBy("crawl_id")
    order = per_crawl.orderBy("parent_claim", "link_ord")
    return queue.withColumns({
        "claim": F.col("done") + F.row_number().over(order),
        "queued": F.count("*").over(per_crawl),
    }).withColumn("claimed", F.col("claim") <= max_pages)


def deep_crawl(seeds: DataFrame, pages: DataFrame, links: DataFrame, config: CrawlConfig = CrawlConfig()) -> DataFrame:
    """All queued pages of every crawl: seeds(crawl_id, url) in, one row per (crawl, page) out.

    ``claimed`` rows were visited, in ``claim`` order; the others fell to the page budget and never return.
    ``page_id`` is null where no capture of the page exists.
    """
    index = page_index(pages)
    narrow = followable(links, config).select(
        F.col("page_id").alias("from_id"), F.col("page_url").alias("discovered_from"), F.col("ord").alias("link_ord"),
        "url", "key", "category", "source", "discovery_reason")
    roots = absolute(seeds.select("crawl_id", "url"), "url", "full").withColumn("key", canonical_url(F.col("full")))
    nothing = F.lit(None).cast("string")
    level = roots.join(index, "key", "left").select(
        "crawl_id", F.lit(0).alias("depth"), F.lit(1).cast("long").alias("claim"), F.lit(True).alias("claimed"),
        F.lit(1).cast("long").alias("done"), "url", "key", nothing.alias("category"), nothing.alias("source"),
        nothing.alias("discovered_from"), nothing.alias("discovery_reason"), "page_id",
        F.lit(1).cast("long").alias("queued"))
    levels = [written(level, "crawl-0")]
    for depth in range(1, config.max_depth + 1):
        frontier = levels[-1].filter("claimed AND page_id IS NOT NULL").select(
            "crawl_id", "done", F.col("claim").alias("parent_claim"), F.col("page_id").alias("from_id"))
        reached = frontier.join(narrow, "from_id")
        first = W.partitionBy("crawl_id", "key").orderBy("parent_claim", "link_ord")
        fresh = reached.withColumn("_n", F.row_number().over(first)).filter("_n = 1")
        visited = reduce(DataFrame.unionByName, [lv.select("crawl_id", "key") for lv in levels])
        fresh = fresh.join(visited, ["crawl_id", "key"], "left_anti")
        queue = claim_budget(fresh, config.max_pages).join(index, "key", "left")
        level = queue.select(
            "crawl_id", F.lit(depth).alias("depth"), "claim", "claimed",
            F.least(F.col("done") + F.col("queued"), F.lit(config.max_pages)).cast("long").alias("done"), "url", "key",
            "category", "source", "discovered_from", "discovery_reason", "page_id", "queued")
        levels.append(written(level, f"crawl-{depth}"))
    return reduce(DataFrame.unionByName, levels)


def crawled_pages(crawl: DataFrame) -> DataFrame:
    """Visited pages with their error: that of a crawl over a fetch log, or ``unreachable`` where no capture is known."""
    missing = F.when(F.col("page_id").isNull(), "unreachable")
    error = F.coalesce("error", missing) if "error" in crawl.columns else missing
    return crawl.filter("claimed").select(
        "crawl_id", "depth", "claim", "url", "page_id", "discovered_from", "discovery_reason", error.alias("error"),
        *(["at_ms"] if "at_ms" in crawl.columns else []))


def discovery_edges(crawl: DataFrame) -> DataFrame:
    """What was queued, from where and why."""
    return crawl.filter("depth > 0").select(
        "crawl_id", "url", "category", "depth", "source", F.col("discovered_from").alias("from_url"), "discovery_reason")


# ---- media of pages ---------------------------------------------------------------------------------

MEDIA = [
    "url", "type", "platform", "video_id", "title", "thumbnail_url", "canonical_url", "content_kind", "confidence",
    "duration", "source", "downloadable", "discovered_from", "discovery_reason",
]


def merge_page_media(assets: DataFrame, embeds: DataFrame, links: DataFrame, pages: DataFrame,
                     config: CrawlConfig = CrawlConfig(), mode: str = "compat") -> DataFrame:
    """Assets, then embeds, then content links to video platforms; first per key within a page."""
    none = F.lit(None).cast("string")
    image = F.col("type") == "IMAGE"
    urls = pages.select("page_id", F.col("url").alias("discovered_from"))
    from_assets = assets.select(
        "page_id", F.lit(0).alias("part"), "ord", F.col("url").alias("key"), "url",
        F.when(image, "image").otherwise("video").alias("type"), none.alias("platform"), none.alias("video_id"),
        F.col("file_name").alias("title"), F.when(image, F.col("url")).alias("thumbnail_url"),
        F.col("url").alias("canonical_url"), F.when(~image, "video").alias("content_kind"), F.lit(0.92).alias("confidence"),
        none.alias("duration"), F.col("source_tag").alias("source"), F.lit(True).alias("downloadable"),
        F.lit("dom-extracted-asset").alias("discovery_reason"))
    from_embeds = embeds.select(
        "page_id", F.lit(1).alias("part"), "ord", "key", "url", "type", "platform", "video_id", none.alias("title"),
        "thumbnail_url", "canonical_url", "content_kind", "confidence", none.alias("duration"), "source", "downloadable",
        "discovery_reason")
    parts = [from_assets, from_embeds]
    if config.follow_video_platforms:
        hosted = with_platform(links.filter("category = 'video_platform' AND NOT is_navigation"), "url", "info", mode)
        parts.append(hosted.filter("info IS NOT NULL").select(
            "page_id", F.lit(2).alias("part"), "ord", F.col("info.canonical_url").alias("key"),
            F.col("info.canonical_url").alias("url"), F.lit("video").alias("type"), F.col("info.platform"),
            F.col("info.video_id"), F.when(F.col("anchor_text") != "", F.col("anchor_text")).alias("title"),
            F.col("info.thumbnail_url"), F.col("info.canonical_url").alias("canonical_url"),
            F.col("info.kind").alias("content_kind"), F.col("info.confidence"), none.alias("duration"),
            F.lit("link").alias("source"), F.lit(False).alias("downloadable"), "discovery_reason"))
    # placed by page once; both windows below use that placement
    rows = reduce(DataFrame.unionByName, parts).repartition("page_id")
    first = W.partitionBy("page_id", "key").orderBy("part", "ord")
    kept = rows.withColumn("_n", F.row_number().over(first)).filter("_n = 1")
    kept = kept.withColumn("ord", F.row_number().over(W.partitionBy("page_id").orderBy("part", "ord")))
    return kept.join(urls, "page_id").select("page_id", "ord", "key", *MEDIA)


def dedup_media_across_pages(crawl_pages: DataFrame, media: DataFrame) -> DataFrame:
    """Media of each crawl: the first page, in claim order, to show a key keeps it."""
    reached = crawl_pages.filter("page_id IS NOT NULL").select(
        "crawl_id", "depth", "claim", F.col("url").alias("page_url"), "page_id")
    first = W.partitionBy("crawl_id", "key").orderBy("claim", "ord")
    return reached.join(media, "page_id").withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")


def link_stats(links: DataFrame) -> DataFrame:
    """Counts per page that decide what kind of page it is."""
    own = F.col("category").isin("same_domain", "subdomain")
    hub = F.col("discovery_reason").isin("content-hub", "interactive-destination", "data-settings-link")
    content = ~F.col("is_navigation")
    return links.groupBy("page_id").agg(
        F.count_if(own & hub).alias("hub_links"), F.count_if(F.col("interactive") & content).alias("interactive_links"),
        F.count_if(content).alias("content_links"),
        F.count_if((F.col("category") == "video_platform") & content).alias("platform_links"),
        F.count("*").alias("link_count"))


def classify_pages(crawl_pages: DataFrame, media: DataFrame, stats: DataFrame, facts: DataFrame) -> DataFrame:
    """Page results of each crawl: title, media count, possible_spa and page kind.

    Pages without a capture have no facts, links or media; they pass beside the joins, so they never meet on their null id.
    """
    found = media.groupBy("crawl_id", "page_id", "claim").agg(F.count("*").alias("media_count"))
    per_page = facts.select("page_id", "title", "text_length").join(stats, "page_id", "left")
    captured = crawl_pages.filter("page_id IS NOT NULL").join(per_page, "page_id", "left").join(found, ["crawl_id", "page_id", "claim"], "left")
    rows = captured.unionByName(crawl_pages.filter("page_id IS NULL"), allowMissingColumns=True)
    counts = ["hub_links", "interactive_links", "content_links", "platform_links", "link_count", "media_count"]
    rows = rows.fillna(0, counts)
    ok = F.col("error").isNull()
    spa = F.coalesce(ok & (F.col("text_length") < 500) & (F.col("link_count") < 3), F.lit(False))
    return rows.select(
        "crawl_id", "claim", "url", "depth", "page_id", F.when(ok, F.col("title")).alias("title"), "media_count", "error", spa.alias("possible_spa"),
        F.when(~ok, "unknown").otherwise(page_kind(spa)).alias("page_kind"), "discovered_from", "discovery_reason",
        *(["at_ms"] if "at_ms" in crawl_pages.columns else []))


def page_kind(spa: Column) -> Column:
    root = F.col("depth") == 0
    return (
        F.when(is_platform_domain(F.col("url")), "platform")
        .when((F.col("media_count") > 0) | (F.col("platform_links") > 0), "media")
        .when((F.col("hub_links") >= 3) | (spa & (F.col("interactive_links") >= 2)), "hub")
        .when((F.col("interactive_links") > 0) | (F.col("content_links") >= 5), F.when(root, "landing").otherwise("listing"))
        .otherwise(F.when(root, "landing").otherwise("unknown"))
    )


def crawl_summary(page_results: DataFrame) -> DataFrame:
    """Totals per crawl; with fetch times, also the time from the first page's answer to the last one's."""
    timed = [(F.max("at_ms") - F.min("at_ms")).alias("duration_ms")] if "at_ms" in page_results.columns else []
    return page_results.groupBy("crawl_id").agg(
        F.count("*").alias("pages_crawled"), F.count_if(F.col("error").isNotNull()).alias("pages_with_errors"),
        F.sum("media_count").alias("total_media"), F.min_by("url", "claim").alias("original_url"), *timed)


def crawl_report(page_results: DataFrame, media: DataFrame) -> DataFrame:
    """Page results with their media nested in order; a page's media is bounded by its asset cap and size."""
    nested = media.groupBy("crawl_id", "claim").agg(
        F.array_sort(F.collect_list(F.struct("ord", *MEDIA))).alias("media"))
    return page_results.join(nested, ["crawl_id", "claim"], "left").withColumn(
        "media", F.coalesce("media", F.array().cast(nested.schema["media"].dataType)))


def emit_crawl_events(crawl: DataFrame, page_results: DataFrame, media: DataFrame,
                      config: CrawlConfig = CrawlConfig()) -> DataFrame:
    """The crawl as an ordered log of named JSON events: crawl_id, seq (sortable struct), event, data.

    ``crawl_complete`` comes after the deepest page and lists the page results of the crawl, at most its page budget; its duration is
    null unless the results have the times of a fetch log.
    """
    def event(df: DataFrame, name: str, stage: int, at: list, **fields) -> DataFrame:
        a, b, c = (at + [F.lit(0)] * 3)[:3]
        return df.select(
            "crawl_id", F.struct(F.col("_depth").cast("int").alias("depth"),
                                 F.lit(stage).alias("stage"), a.cast("long").alias("a"), b.cast("long").alias("b"),
                                 c.cast("long").alias("c")).alias("seq"),
            F.lit(name).alias("event"),
            F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()]), {"ignoreNullFields": "false"}).alias("data"))

    c = F.col
    seeds = crawl.filter("depth = 0").withColumn("_depth", F.lit(-1))
    queued = crawl.filter("depth > 0").withColumn("_depth", c("depth"))
    claimed = queued.filter("claimed")
    results = page_results.withColumn("_depth", c("depth"))
    found = media.withColumn("_depth", c("depth"))
    summary = crawl_summary(page_results).withColumn("_depth", F.lit(config.max_depth + 1))
    duration = c("duration_ms") if "duration_ms" in summary.columns else F.lit(None)
    listed = page_results.groupBy("crawl_id").agg(F.array_sort(F.collect_list(F.struct(
        "claim", "url", "depth", "title", c("media_count").alias("mediaCount"), "error", c("possible_spa").alias("possibleSpa"),
        c("page_kind").alias("pageKind"), c("discovery_reason").alias("discoveryReason")))).alias("results"))
    summary = summary.join(listed, "crawl_id")
    settings = F.struct(*[F.lit(v).alias(re.sub("_(.)", lambda m: m[1].upper(), k)) for k, v in asdict(config).items()])
    parts = [
        event(seeds, "crawl_started", 0, [], url=c("url"), config=settings),
        event(queued, "page_discovered", 1, [c("claim")], url=c("url"), category=c("category"), depth=c("depth"),
              source=c("source"), fromUrl=c("discovered_from"), discoveryReason=c("discovery_reason")),
        event(claimed, "page_processing", 2, [c("claim"), F.lit(0)], url=c("url"), depth=c("depth"),
              pagesDone=c("claim"), pagesTotal=c("done")),
        event(found, "media_found", 2, [c("claim"), F.lit(1), c("ord")], pageUrl=c("page_url"),
              media=F.struct(*MEDIA)),
        event(results.filter("error IS NOT NULL"), "page_error", 2, [c("claim"), F.lit(2)], url=c("url"), error=c("error"),
              depth=c("depth")),
        event(results.filter("depth > 0"), "page_complete", 2, [c("claim"), F.lit(3)], url=c("url"),
              mediaCount=c("media_count"), depth=c("depth")),
        event(summary, "crawl_complete", 3, [], originalUrl=c("original_url"), totalPages=c("pages_crawled"),
              pagesWithErrors=c("pages_with_errors"), totalMedia=c("total_media"), results=F.transform(
                  "results", lambda r: r.dropFields("claim")), crawlDurationMs=duration.cast("long")),
    ]
    return reduce(DataFrame.unionByName, parts)


# ---- shallow crawl -------------------------------------------------------------------------------------


def shallow_crawl(seeds: DataFrame, pages: DataFrame, page_links: DataFrame, assets: DataFrame,
                  config: ShallowConfig = ShallowConfig()) -> tuple[DataFrame, DataFrame]:
    """Same-host crawl of the analysis job: (scanned pages, assets) of every seed.

    Pages are scanned in batches; a batch starts only while the crawl holds fewer assets than the cap.
    """
    index = page_index(pages, strip_fragment)
    links = page_links.select(F.col("page_id").alias("from_id"), F.col("url").alias("key"), F.col("pos").alias("link_ord"))
    roots = absolute(seeds.select("crawl_id", "url"), "url", "full").withColumn("key", strip_fragment(F.col("full")))
    level = roots.join(index, "key").select(
        "crawl_id", F.lit(0).alias("depth"), F.lit(1).cast("long").alias("claim"), F.lit(True).alias("scanned"),
        F.lit(1).cast("long").alias("done"), "key", "page_id", host_of(F.col("full")).alias("host"))
    levels = [written(level, "shallow-0")]
    for depth in range(1, config.max_depth + 1):
        frontier = levels[-1].filter("scanned AND page_id IS NOT NULL").select(
            "crawl_id", "host", "done", F.col("claim").alias("parent_claim"), F.col("page_id").alias("from_id"))
        reached = frontier.join(links, "from_id")
        if config.same_host_only:
            reached = reached.filter(host_of(F.col("key")) == F.col("host"))
        first = W.partitionBy("crawl_id", "key").orderBy("parent_claim", "link_ord")
        fresh = reached.withColumn("_n", F.row_number().over(first)).filter("_n = 1")
        visited = reduce(DataFrame.unionByName, [lv.select("crawl_id", "key") for lv in levels])
        queue = claim_budget(fresh.join(visited, ["crawl_id", "key"], "left_anti"), config.max_pages)
        queue = queue.join(index, "key", "left").withColumn(
            "batch", F.floor((F.col("claim") - F.col("done") - 1) / config.batch))
        open_ = _open_batches(queue.filter("claimed"), levels, assets, config)
        scanned = queue.join(open_, ["crawl_id", "batch"], "left").withColumn(
            "scanned", F.col("claimed") & F.coalesce("open", F.lit(False)))
        per_crawl = W.partitionBy("crawl_id")
        level = scanned.select(
            "crawl_id", F.lit(depth).alias("depth"), "claim", "scanned",
            (F.col("done") + F.count_if("scanned").over(per_crawl)).cast("long").alias("done"), "key", "page_id", "host")
        levels.append(written(level, f"shallow-{depth}"))
    scanned = reduce(DataFrame.unionByName, levels).filter("scanned").select(
        "crawl_id", "depth", "claim", F.col("key").alias("url"), "page_id")
    first = W.partitionBy("crawl_id", "url").orderBy("claim", "ord")
    rows = scanned.drop("url").filter("page_id IS NOT NULL").join(assets, "page_id")
    unique = rows.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")
    placed = unique.withColumn("asset_ord", F.row_number().over(W.partitionBy("crawl_id").orderBy("claim", "ord")))
    return scanned, placed.filter(at_most(F.col("asset_ord"), config.max_assets))


def _open_batches(claimed: DataFrame, levels: list[DataFrame], assets: DataFrame, config: ShallowConfig) -> DataFrame:
    """Batches that start below the asset cap, given everything scanned before them."""
    before = reduce(DataFrame.unionByName, [
        lv.filter("scanned").select("crawl_id", "claim", "page_id", F.lit(-1).cast("long").alias("batch")) for lv in levels])
    now = claimed.select("crawl_id", "claim", "page_id", F.col("batch").cast("long").alias("batch"))
    every = before.unionByName(now)
    first = W.partitionBy("crawl_id", "url").orderBy("claim")
    new = every.join(assets.select("page_id", "url"), "page_id").withColumn("_n", F.row_number().over(first))
    gains = new.filter("_n = 1").groupBy("crawl_id", "batch").agg(F.count("*").alias("gain"))
    batches = every.select("crawl_id", "batch").distinct().join(gains, ["crawl_id", "batch"], "left")
    so_far = W.partitionBy("crawl_id").orderBy("batch").rowsBetween(W.unboundedPreceding, -1)
    return batches.withColumn("open", at_most(F.coalesce(F.sum("gain").over(so_far), F.lit(0)) + 1, config.max_assets)).filter(
        "batch >= 0").select("crawl_id", "batch", "open")

