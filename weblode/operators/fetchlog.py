"""Crawls over a log of captured responses: redirects, retries and error classes decide what a crawl sees.

``fetches(url, attempt, status, location, content_type, content_length, body_chars, error, at_ms)`` has a row for every response: the
URL asked for without its fragment, 1 or 2 for the attempt, and either an ``error`` message or a status. What becomes of a URL
depends on the log alone, so it is worked out once for all crawls; a crawl step then joins its claimed pages to one narrow row each.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weblode.config import CrawlConfig, Limits
from weblode.functions.fixed import REDIRECT_STATUS
from weblode.functions.skew import looked_up
from weblode.functions.urls import canonical_url, host_of, is_http, is_private_host, strip_fragment, with_resolved
from weblode.operators.admission import error_class
from weblode.operators.crawl import absolute, claim_budget, followable, page_index
from weblode.sources.stages import written

RESPONSE = ["status", "location", "content_type", "content_length", "body_chars", "error", "at_ms"]


def responses_by_try(fetches: DataFrame) -> DataFrame:
    """One response for each (try, url): the first try sees first attempts, the second the last attempt that the log has.

    Repeated rows of one attempt leave the smallest; rows without a URL go.
    """
    rows = fetches.dropna(subset=["url"]).select(strip_fragment(F.col("url")).alias("url"), F.coalesce("attempt", F.lit(1)).alias("attempt"), *RESPONSE)
    both = rows.withColumn("try", F.explode(F.when(F.col("attempt") == 1, F.array(F.lit(1), F.lit(2))).when(F.col("attempt") == 2, F.array(F.lit(2)))))
    best = both.groupBy("try", "url").agg(F.min(F.struct((-F.col("attempt")).alias("late"), *RESPONSE)).alias("r"))
    return best.select("try", "url", *[F.col(f"r.{c}").alias(c) for c in RESPONSE])


def _redirects(status: Column, error: Column) -> Column:
    return F.coalesce(error.isNull() & status.isin(REDIRECT_STATUS), F.lit(False))


def redirect_closure(responses: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Where every redirect ends: (try, url, final_url, hops, fault), by pointer doubling.

    A row first points one hop ahead. Each round it takes over the pointer of the row it points to, so a round doubles the hops
    seen and three rounds pass the limit of five. A chain of more than ``max_redirects`` hops, and so every loop, is ``too_many_redirects``;
    so is a fault that only the response past the limit would show. The rounds join redirects with redirects only.
    """
    found = responses.filter(_redirects(F.col("status"), F.col("error"))).select("try", "url", "location")
    found = with_resolved(found, "location", "url", "next")
    fault = (
        F.when(F.coalesce("location", F.lit("")) == "", "missing_location")
        .when(F.col("next").isNull() | ~is_http(F.col("next")), "invalid_url")
        .when(is_private_host(host_of(F.col("next"))), "private_host"))
    rows = found.withColumn("fault", fault).select(
        "try", "url", F.when(F.col("fault").isNull(), strip_fragment(F.col("next"))).alias("to"),
        F.col("fault").isNull().cast("int").alias("hops"), "fault")
    seen = 1
    while seen <= limits.max_redirects:
        rows = written(rows, "redirect-closure")
        ahead = rows.select("try", F.col("url").alias("to"), F.col("to").alias("far"), F.col("hops").alias("more"), F.col("fault").alias("then"))
        step = looked_up(rows, ahead, ["try", "to"])
        met = F.col("more").isNotNull()
        rows = step.select(
            "try", "url", F.when(met, F.col("far")).otherwise(F.col("to")).alias("to"),
            (F.col("hops") + F.coalesce("more", F.lit(0))).alias("hops"), F.coalesce("fault", "then").alias("fault"))
        seen *= 2
    past = (F.col("hops") > limits.max_redirects) | (F.col("fault").isNotNull() & (F.col("hops") >= limits.max_redirects))
    fault = F.when(past, "too_many_redirects").otherwise(F.col("fault"))
    return rows.select("try", "url", F.when(fault.isNull(), F.col("to")).alias("final_url"),
                       F.least("hops", F.lit(limits.max_redirects)).alias("hops"), fault.alias("fault"))


def _message(limits: Limits) -> Column:
    """What a fetch that ended in a response complains of; null for a page that may be read."""
    kind = F.coalesce("content_type", F.lit(""))
    html = F.contains(kind, F.lit("text/html")) | F.contains(kind, F.lit("application/xhtml"))
    large = (F.col("content_length") > limits.max_crawl_html_chars) | (F.col("body_chars") > limits.max_crawl_html_chars)
    return (
        F.when(F.col("error").isNotNull(), F.col("error"))
        .when(F.col("status").isNull(), "fetch failed")
        .when(~F.col("status").between(200, 299), F.concat(F.lit("HTTP "), F.col("status").cast("string")))
        .when(~html, F.concat(F.lit("Not HTML: "), kind))
        .when(large, "Response too large"))


def fetch_outcomes(fetches: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """What asking for each logged URL comes to: (url, attempt, final_url, hops, error, fault, at_ms), one row a URL.

    Redirects are followed first. A fetch that ends in HTTP 5xx is made once more from the start, and the second outcome counts.
    ``error`` is one of the nine classes of a failed page, null for a page that may be read; ``fault`` names a redirect's fault.
    A chain that leaves the log is ``unreachable``.
    """
    responses = written(responses_by_try(fetches), "responses")
    ended = written(responses.select(
        "try", "url", _redirects(F.col("status"), F.col("error")).alias("moved"), _message(limits).alias("message"), "at_ms"), "responses")
    ways = written(redirect_closure(responses, limits), "redirects")
    finals = ended.filter("NOT moved").select("try", F.col("url").alias("final_url"), "message", "at_ms")
    landed = looked_up(ways, finals.withColumn("known", F.lit(True)), ["try", "final_url"]).withColumn(
        "message", F.when(F.col("fault").isNotNull(), F.col("fault")).when(F.col("known").isNull(), "unreachable").otherwise(F.col("message")))
    direct = finals.select("try", F.col("final_url").alias("url"), "final_url", F.lit(0).alias("hops"), F.lit(None).cast("string").alias("fault"), "message", "at_ms")
    every = direct.unionByName(landed.drop("known"))
    row = F.struct("final_url", "hops", "fault", "message", "at_ms")
    tries = every.groupBy("url").agg(F.max(F.when(F.col("try") == 1, row)).alias("a"), F.max(F.when(F.col("try") == 2, row)).alias("b"))
    again = F.coalesce(F.startswith(F.col("a.message"), F.lit("HTTP 5")), F.col("a").isNull())
    chosen = tries.withColumn("r", F.when(again, F.col("b")).otherwise(F.col("a")))
    return chosen.select("url", F.when(again, 2).otherwise(1).alias("attempt"), "r.final_url", "r.hops", error_class(F.col("r.message")).alias("error"),
                         "r.fault", "r.at_ms")


def deep_crawl_logged(seeds: DataFrame, pages: DataFrame, links: DataFrame, fetches: DataFrame, config: CrawlConfig = CrawlConfig(),
                      limits: Limits = Limits(), mark_targets: bool = True) -> DataFrame:
    """All queued pages of every crawl, with what became of each fetch: seeds(crawl_id, url) in, one row per (crawl, page) out.

    As ``deep_crawl``, but a claimed page is the one its redirects end at, and a page whose fetch failed carries its error class and
    gives no links. ``claimed`` rows have ``final_url``, ``hops``, ``attempt``, ``error`` and ``at_ms``; ``page_id`` is the capture of
    the final URL, and a page that may be read but was not captured is ``unreachable``, as is one that the log does not know.

    A page counts as visited under the key it was asked for and, with ``mark_targets``, under the key it was redirected to.
    """
    index = written(page_index(pages), "crawl-index")
    outcomes = written(fetch_outcomes(fetches, limits).withColumnRenamed("url", "asked"), "outcomes")
    narrow = written(followable(links, config).select(
        F.col("page_id").alias("from_id"), F.col("page_url").alias("discovered_from"), F.col("ord").alias("link_ord"),
        "url", "key", "category", "source", "discovery_reason"), "crawl-links")
    text = F.lit(None).cast("string")
    roots = absolute(seeds.select("crawl_id", "url"), "url", "full")
    queue = roots.select(
        "crawl_id", F.lit(0).alias("depth"), F.lit(1).cast("long").alias("claim"), F.lit(True).alias("claimed"),
        F.lit(1).cast("long").alias("done"), "url", "full", canonical_url(F.col("full")).alias("key"), text.alias("category"), text.alias("source"),
        text.alias("discovered_from"), text.alias("discovery_reason"), F.lit(1).cast("long").alias("queued"))
    levels = [written(_fetched(written(queue, "crawl-queue"), outcomes, index), "crawl-0")]
    for depth in range(1, config.max_depth + 1):
        frontier = levels[-1].filter("claimed AND error IS NULL").select(
            "crawl_id", "done", F.col("claim").alias("parent_claim"), F.col("page_id").alias("from_id"))
        reached = frontier.join(narrow, "from_id")
        first = W.partitionBy("crawl_id", "key").orderBy("parent_claim", "link_ord")
        fresh = reached.withColumn("_n", F.row_number().over(first)).filter("_n = 1")
        visited = [lv.select("crawl_id", "key") for lv in levels]
        if mark_targets:
            visited += [lv.filter("final_key <> key").select("crawl_id", F.col("final_key").alias("key")) for lv in levels]
        fresh = fresh.join(reduce(DataFrame.unionByName, visited), ["crawl_id", "key"], "left_anti")
        queue = absolute(claim_budget(fresh, config.max_pages), "url", "full").select(
            "crawl_id", F.lit(depth).alias("depth"), "claim", "claimed",
            F.least(F.col("done") + F.col("queued"), F.lit(config.max_pages)).cast("long").alias("done"), "url", "full", "key", "category",
            "source", "discovered_from", "discovery_reason", "queued")
        levels.append(written(_fetched(written(queue, f"crawl-queue-{depth}"), outcomes, index), f"crawl-{depth}"))
    return reduce(DataFrame.unionByName, levels)


def _fetched(queue: DataFrame, outcomes: DataFrame, index: DataFrame) -> DataFrame:
    """The queue with the outcome of each claimed page and the capture it leads to."""
    rows = queue.withColumn("asked", F.when(F.col("claimed"), strip_fragment(F.col("full")))).drop("full")
    seen = looked_up(rows, outcomes, ["asked"])
    error = F.when(F.col("claimed"), F.when(F.col("attempt").isNull(), "unreachable").otherwise(F.col("error")))
    seen = seen.withColumn("error", error)
    good = F.col("claimed") & F.col("error").isNull()
    keyed = written(seen.withColumn("final_key", F.when(good, canonical_url(F.col("final_url")))), "crawl-fetched")
    found = looked_up(keyed, index.select(F.col("key").alias("final_key"), "page_id"), ["final_key"])
    return found.withColumn("error", F.when(good & F.col("page_id").isNull(), "unreachable").otherwise(F.col("error"))).drop("asked")
