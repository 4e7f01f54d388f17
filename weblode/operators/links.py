"""Link discovery: four collectors, filters, scoring, best candidate per canonical URL.

Candidates are made where the page was scanned; one exchange by page carries the surviving rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weblode.config import Limits
from weblode.functions.fixed import (
    BUTTON_URL_ATTRS, CTA_WORDS, HUB_WORDS, LEGAL_WORDS, ONCLICK_URLS, SETTINGS_LINK_KEY, SHARE_DOMAINS, SHARE_PATHS,
    SHARE_WORDS,
)
from weblode.functions.jsonld import settings_urls
from weblode.functions.platforms import with_platform
from weblode.functions.text import (
    at_most, attr, attr_names, attr_tokens, attr_values, built_once, has_word, present, settle, trim_space,
    unescape_settings, utf16_length,
)
from weblode.functions.urls import (
    bare_host, canonical_url, is_filtered_url, is_subdomain, same_domain, with_resolved,
)
from weblode.operators.tokens import elements, page_facts

INTERACTIVE = ["button", "data_settings", "onclick"]
FOUND = "array<struct<collector:int,b:int,c:int,raw:string,source:string,path:string>>"


def _or_empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


@built_once
def _label() -> Column:
    parts = attr_tokens(F.col("alt_tag"))
    alt = F.get(attr_values(parts), F.array_position(attr_names(parts), "alt").cast("int") - 1)
    return F.substring(F.coalesce(
        present(F.col("own_text")), present(trim_space(attr("aria-label"))), present(trim_space(attr("title"))),
        present(trim_space(alt)), F.lit("")), 1, 200)


@built_once
def _found(limits: Limits) -> Column:
    """Targets named by one element, per collector."""
    def row(collector: int, raw: Column, source, b=0, c=0, path=None) -> Column:
        as_col = lambda v: v if isinstance(v, Column) else F.lit(v)
        return F.struct(
            F.lit(collector).alias("collector"), as_col(b).alias("b"), as_col(c).alias("c"), raw.alias("raw"),
            as_col(source).alias("source"), (F.lit(None).cast("string") if path is None else path).alias("path"))

    none = F.array().cast(FOUND)
    is_button = (F.col("name") == "button") | (attr("role") == "button")
    kind = F.when(F.coalesce(is_button, F.lit(False)), "button").otherwise("data_attr")
    anchor = F.when((F.col("name") == "a") & (attr("href") != ""), F.array(row(0, attr("href"), "anchor"))).otherwise(none)
    data = F.filter(F.array(*[row(1, attr(n), kind, i) for i, n in enumerate(BUTTON_URL_ATTRS)]), lambda r: r.raw != "")
    click = attr("onclick")
    calls = [_calls(click, p, i, row) for i, p in enumerate(ONCLICK_URLS)]
    clicks = F.when((click != "") & at_most(utf16_length(click), limits.max_onclick_chars),
                    F.filter(F.concat(*calls), lambda r: r.raw != "")).otherwise(none)
    raw = attr("data-settings")
    leaf = F.filter(
        settings_urls(unescape_settings(raw), SETTINGS_LINK_KEY),
        lambda s: at_most(F.length(s.value), limits.max_setting_value_chars) & s.value.rlike("^(?:https?://|/)"))
    settings = F.when((raw != "") & at_most(utf16_length(raw), limits.max_settings_chars), F.transform(
        leaf, lambda s, k: row(3, s.value, "data_settings", 0, k, s.path))).otherwise(none)
    return F.concat(anchor, data, clicks, settings)


def _calls(click: Column, pattern: str, i: int, row) -> Column:
    return F.transform(
        F.regexp_extract_all(click, F.lit(pattern), F.lit(1)), lambda u, k: row(2, trim_space(u), "onclick", i, k))


def link_candidates(pages: DataFrame, limits: Limits = Limits(), els: DataFrame | None = None) -> DataFrame:
    """Every link target of every page with its label and context, unresolved. Narrow."""
    els = (elements(pages, text=True) if els is None else els).filter(F.col("own_text").isNotNull())
    els = els.withColumns({"label": _label(), "found": _found(limits)})
    context = F.substring(F.concat_ws(
        " ", *[present(c) for c in (F.col("label"), attr("class"), attr("data-widget_type"), attr("data-element_type"),
                                    F.col("parent_text"))]), 1, 350)
    rows = els.select(
        "page_id", "page_url", "pos", F.col("label").alias("anchor_text"), context.alias("context"),
        (F.col("nav") | F.col("near_ad")).alias("is_navigation"), F.inline_outer("found"))
    return rows.filter(F.col("raw").isNotNull())


def _category(url: str, base: str) -> Column:
    return (
        F.when(F.col("platform").isNotNull(), "video_platform")
        .when(same_domain(F.col(url), F.col(base)), "same_domain")
        .when(is_subdomain(F.col(url), F.col(base)), "subdomain")
        .otherwise("external")
    )


def _priority() -> Column:
    own = F.col("category").isin("same_domain", "subdomain")
    hub, cta, nav = F.col("hub"), F.col("cta"), F.col("is_navigation")
    active = F.col("source").isin(INTERACTIVE)
    return (
        F.when(F.col("category") == "video_platform", F.when(~nav & (hub | active), 1).otherwise(2))
        .when((F.col("category") == "same_domain") & hub, F.when(active | cta, 1).otherwise(2))
        .when(own & active & ~nav, 2)
        .when(own & ~nav, 3)
        .when((F.col("category") == "external") & hub, 4)
        .when(nav, 5)
        .otherwise(6)
    )


def _reason() -> Column:
    path = F.col("path")
    return (
        F.when(F.col("collector") == 1, "interactive-destination")
        .when(F.col("collector") == 2, "onclick-navigation")
        .when(F.col("collector") == 3,
              F.when(path.rlike("(?i)youtube|vimeo|video|embed"), "player-config")
              .when(path.rlike("(?i)link|url|href|target"), "data-settings-link").otherwise("data-settings"))
        .when(F.col("raw_platform").isNotNull(), "platform-reference")
        .when(F.col("plain_hub"), "content-hub")
    )


def score_links(candidates: DataFrame, mode: str = "compat") -> DataFrame:
    """Resolve, filter and score candidates. Narrow."""
    full = with_resolved(candidates, "raw", "page_url", "url")
    context = F.when(F.col("path").isNotNull(), F.trim(F.concat_ws(" ", "context", "path"))).otherwise(F.col("context"))
    kept = settle(
        full, keep=~is_filtered_url(F.col("url")) & ~has_word(F.col("anchor_text"), LEGAL_WORDS),
        full_context=context)
    share = (
        bare_host(F.col("url")).isin(SHARE_DOMAINS) | has_word(F.col("full_context"), SHARE_WORDS)
        | F.col("url").rlike(SHARE_PATHS))
    kept = kept.filter(F.col("keep")).filter(~share)
    kept = with_platform(kept, "url", "platform", mode)
    kept = with_platform(kept, "raw", "raw_platform", mode)
    kept = settle(
        kept, hub=has_word(F.col("full_context"), HUB_WORDS), cta=has_word(F.col("full_context"), CTA_WORDS),
        plain_hub=has_word(F.col("context"), HUB_WORDS), category=_category("url", "page_url"),
        key=canonical_url(F.col("url")))
    return kept.select(
        "page_id", "page_url", "collector", "pos", "b", "c", "key", "url", "category", "anchor_text",
        F.col("full_context").alias("context"), "is_navigation", "source", (F.col("collector") > 0).alias("interactive"),
        _reason().alias("discovery_reason"), _priority().alias("priority"))


def best_links(scored: DataFrame) -> DataFrame:
    """Best candidate per page and canonical URL, in priority order, first-seen order inside a priority."""
    seq = ["collector", "pos", "b", "c"]
    by_key = W.partitionBy("page_id", "key")
    best = by_key.orderBy("priority", F.desc("interactive"), F.desc(F.length("context")), *seq)
    placed = scored.repartition("page_id")
    ranked = placed.withColumns({"_n": F.row_number().over(best), "seen": F.min(F.struct(*seq)).over(by_key)})
    out = ranked.filter("_n = 1").withColumn(
        "ord", F.row_number().over(W.partitionBy("page_id").orderBy("priority", "seen")))
    return out.select(
        "page_id", "page_url", "ord", "url", "key", "category", "anchor_text", "context", "is_navigation", "source",
        "interactive", "discovery_reason", "priority")


def discover_links(pages: DataFrame, mode: str = "compat", limits: Limits = Limits(), els: DataFrame | None = None) -> DataFrame:
    """Ranked links of every page; ``page_url`` is where each was discovered. ``els``: a stored ``elements(pages, text=True)``."""
    return best_links(score_links(link_candidates(pages, limits, els), mode))


def possible_spa(pages: DataFrame, links: DataFrame) -> DataFrame:
    """Pages with little text and few links, likely drawn by script."""
    counts = links.groupBy("page_id").agg(F.count("*").alias("link_count"))
    facts = page_facts(pages).join(counts, "page_id", "left").withColumn("link_count", F.coalesce("link_count", F.lit(0)))
    return facts.withColumn("possible_spa", (F.col("text_length") < 500) & (F.col("link_count") < 3))
