"""Admission over captured logs: pages, retries, redirects, hosts, seeds, downloads, bundles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weblode.config import Limits
from weblode.functions.files import disposition_name, file_name_from_url, is_allowed_content_type, sanitize_file_name
from weblode.functions.fixed import REDIRECT_STATUS
from weblode.functions.text import settle, utf16_length
from weblode.functions.urls import (
    host_of, is_http, is_media_extension, is_private_host, public_url_error, url_extension, with_resolved, with_scheme,
)
from weblode.sources.stages import written


def _ok(status: Column) -> Column:
    return F.coalesce(status.between(200, 299), F.lit(False))


def admit_pages(fetches: DataFrame, rules: str = "analyse", limits: Limits = Limits()) -> DataFrame:
    """Add ``error_code`` (null when admitted) to a log of page fetches.

    ``fetches(url, status, content_type, content_length, body, error)``; ``rules`` is "analyse" or "crawl".
    """
    kind = F.coalesce("content_type", F.lit(""))
    size = utf16_length(F.col("body"))
    if rules == "analyse":
        html = F.contains(kind, F.lit("text/html")) | F.contains(kind, F.lit("application/xhtml+xml"))
        return fetches.withColumn("error_code", F.when(F.col("error").isNotNull() | ~_ok(F.col("status")), "FETCH_FAILED")
                                  .when(~html, "NOT_HTML")
                                  .when(F.col("content_length") > limits.max_html_chars, "HTML_TOO_LARGE")
                                  .when(F.coalesce("body", F.lit("")) == "", "FETCH_FAILED")
                                  .when(size > limits.max_html_chars, "HTML_TOO_LARGE"))
    if rules != "crawl":
        raise ValueError("rules is 'analyse' or 'crawl'")
    html = F.contains(kind, F.lit("text/html")) | F.contains(kind, F.lit("application/xhtml"))
    message = (
        F.when(F.col("error").isNotNull(), F.col("error"))
        .when(~_ok(F.col("status")), F.concat(F.lit("HTTP "), F.col("status").cast("string")))
        .when(~html, F.concat(F.lit("Not HTML: "), kind))
        .when((F.col("content_length") > limits.max_crawl_html_chars) | (size > limits.max_crawl_html_chars),
              "Response too large")
    )
    return fetches.withColumn("error_code", error_class(message))


def error_class(message: Column) -> Column:
    """Class of a crawl failure by its message; the tests run in this order."""
    return (
        F.when(message.isNull(), F.lit(None).cast("string"))
        .when(message.rlike("(?i)timeout|aborterror"), "timeout")
        .when(message.rlike("HTTP 40[13]"), "auth_required")
        .when(message.rlike("HTTP 429"), "rate_limited")
        .when(message.rlike("HTTP 5"), "server_error")
        .when(message.rlike("(?i)not html"), "not_html")
        .when(message.rlike("(?i)too large"), "too_large")
        .when(message.rlike("(?i)blocked"), "blocked")
        .when(message.rlike("(?i)enotfound|unreachable|fetch failed"), "unreachable")
        .otherwise("unknown_error")
    )


def resolve_retries(fetches: DataFrame) -> DataFrame:
    """The attempt that counts: the second only after a first that ended in HTTP 5xx.

    Only failed first attempts and their retries are matched up; every other row passes where it is.
    """
    failed = F.coalesce(F.col("error").isNull() & F.col("status").between(500, 599), F.lit(False))
    first, second = fetches.filter("attempt = 1"), fetches.filter("attempt = 2")
    retried = second.join(first.filter(failed).select("url"), "url", "left_semi")
    lost = first.filter(failed).join(second.select("url"), "url", "left_anti")
    return first.filter(~failed).unionByName(retried).unionByName(lost)


def resolve_redirects(requests: DataFrame, responses: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Follow redirects of requests(url) over responses(url, status, location): resolved_url, hops, error_code.

    A redirect's target and its fault depend on the response alone, so both are worked out once per response and written as a
    stage table; the hops are then joins on bare addresses. At most ``max_redirects`` hops, so a loop ends in
    ``too_many_redirects``. Finished rows get a key of their own and do not meet in one partition.
    """
    table = responses.filter(F.col("status").isin(REDIRECT_STATUS)).groupBy(F.col("url").alias("at")).agg(
        F.min(F.struct("status", "location")).alias("r")).select("at", F.col("r.location").alias("location"))
    targets = with_resolved(table, "location", "at", "next")
    fault = (
        F.when(F.coalesce("location", F.lit("")) == "", "missing_location")
        .when(~is_http(F.col("next")), "invalid_url")
        .when(is_private_host(host_of(F.col("next"))), "private_host"))
    steps = written(targets.select("at", "next", fault.alias("fault")), "redirects").withColumn("found", F.lit(True))
    rows = requests.select("url", F.col("url").alias("current"), F.lit(0).alias("hops"),
                           F.lit(None).cast("string").alias("error_code"), F.lit(True).alias("live"))
    for hop in range(limits.max_redirects + 1):
        key = F.when(F.col("live"), F.col("current")).otherwise(F.concat(F.lit(" "), F.col("url")))
        step = rows.withColumn("at", key).join(steps, "at", "left")
        more = F.coalesce("found", F.lit(False))
        fault = F.lit("too_many_redirects") if hop == limits.max_redirects else F.col("fault")
        moved = more & fault.isNull()
        rows = step.select(
            "url", F.when(moved, F.col("next")).otherwise(F.col("current")).alias("current"),
            (F.col("hops") + moved.cast("int")).alias("hops"), F.when(more, fault).otherwise(F.col("error_code")).alias("error_code"),
            moved.alias("live"))
    return rows.select("url", F.when(F.col("error_code").isNull(), F.col("current")).alias("resolved_url"), "hops",
                       "error_code")


def host_safety(requests: DataFrame, dns_answers: DataFrame) -> DataFrame:
    """Add ``host`` and ``verdict``: ok, private_host or unresolved, for requests(url, …).

    Answers are reduced to one row per host first, so a host asked for by a large share of rows costs one.
    """
    private = F.exists(F.coalesce("addresses", F.array().cast("array<string>")), is_private_host)
    known = dns_answers.groupBy("host").agg(
        F.max(private).alias("private"), F.max(F.size(F.coalesce("addresses", F.array().cast("array<string>")))).alias("n"))
    rows = settle(requests, host=host_of(F.col("url")))
    joined = rows.join(known, "host", "left")
    verdict = (
        F.when(is_private_host(F.col("host")), "private_host")
        .when(F.coalesce("n", F.lit(0)) == 0, "unresolved").when(F.col("private"), "private_host").otherwise("ok"))
    return joined.withColumn("verdict", verdict).drop("private", "n")


def validate_seeds(seeds: DataFrame) -> DataFrame:
    """Add ``seed_url`` (trimmed, with scheme) and ``error_code`` (null when the seed is public) to seeds(url)."""
    rows = seeds.withColumn("seed_url", with_scheme(F.col("url"))).withColumn("_base", F.lit(""))
    rows = with_resolved(rows, "seed_url", "_base", "_parsed")
    return rows.withColumn("error_code", public_url_error(F.col("seed_url"), F.col("_parsed"))).drop("_base", "_parsed")


def admit_assets(fetches: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Add ``error_code`` and ``file_name`` to asset_fetches(url, status, content_type, content_length, bytes, disposition)."""
    ext = url_extension(F.col("url"))
    code = (
        F.when(ext.isNotNull() & ~is_media_extension(ext), "INVALID_MEDIA_TYPE")
        .when(~_ok(F.col("status")), "DOWNLOAD_FAILED")
        .when(~is_allowed_content_type(F.col("content_type")), "INVALID_MEDIA_TYPE")
        .when(F.col("content_length") > limits.max_file_bytes, "FILE_TOO_LARGE")
        .when(F.col("bytes").isNull(), "DOWNLOAD_FAILED")
        .when(F.col("bytes") > limits.max_file_bytes, "FILE_TOO_LARGE")
    )
    name = F.coalesce(disposition_name(F.col("disposition")), file_name_from_url(F.col("url"), F.lit(1)))
    return fetches.withColumn("error_code", code).withColumn("file_name", F.when(F.col("error_code").isNull(), name))


def _unique_names(names: Column) -> Column:
    """Names of one bundle in order, later duplicates numbered before the extension. At most 200 names."""
    def step(used: Column, name: Column) -> Column:
        ext = F.regexp_extract(name, r"(?s)^.+(\.[^.]*)$", 1)
        base = F.substring(name, F.lit(1), F.length(name) - F.length(ext))
        tries = F.transform(F.sequence(F.lit(2), F.size(used) + 2),
                            lambda k: F.concat(base, F.lit("-"), k.cast("string"), ext))
        free = F.get(F.filter(tries, lambda t: ~F.array_contains(used, t)), 0)
        return F.array_append(used, F.when(F.array_contains(used, name), free).otherwise(name))

    return F.aggregate(names, F.array().cast("array<string>"), step)


def bundle_manifest(assets: DataFrame, fetches: DataFrame, limits: Limits = Limits()) -> tuple[DataFrame, DataFrame]:
    """(entries, bundles) for assets(bundle_id, ord, url, file_name, extension).

    Bundles over the asset limit are refused whole, counted map-side before anything is gathered, so the
    naming step never sees a group larger than the limit.
    """
    sizes = assets.groupBy("bundle_id").agg(F.count("*").alias("asked"))
    fitting = assets.join(sizes.filter(F.col("asked") <= limits.max_bundle_assets), "bundle_id", "left_semi")
    complete = fitting.filter((F.col("url") != "") & (F.col("extension") != "") & (F.col("file_name") != "")
                              & is_media_extension(F.col("extension")))
    ok = (
        _ok(F.col("status")) & F.col("bytes").isNotNull() & is_allowed_content_type(F.col("content_type"))
        & ~F.coalesce(F.col("content_length") > limits.max_file_bytes, F.lit(False)))
    captured = fetches.filter(ok).groupBy("url").agg(F.max("bytes").alias("bytes"))
    admitted = complete.join(captured, "url").withColumn(
        "wanted", sanitize_file_name(F.col("file_name"), F.concat(F.lit("media."), F.col("extension"))))
    per_bundle = admitted.groupBy("bundle_id").agg(
        F.array_sort(F.collect_list(F.struct("ord", "wanted", "url", "bytes"))).alias("rows"))
    named = per_bundle.withColumn("names", _unique_names(F.transform("rows", lambda r: r.wanted)))
    entries = named.select("bundle_id", F.posexplode("rows").alias("i", "r"), "names").select(
        "bundle_id", F.col("r.ord").alias("ord"), F.col("r.url").alias("url"), F.get("names", F.col("i")).alias("name"),
        F.col("r.bytes").alias("bytes"))
    upto = W.partitionBy("bundle_id").orderBy("ord").rowsBetween(W.unboundedPreceding, 0)
    entries = entries.withColumn("running_bytes", F.sum("bytes").over(upto))
    entries = entries.withColumn("over_limit", F.col("running_bytes") > limits.max_bundle_bytes)
    totals = entries.groupBy("bundle_id").agg(
        F.count("*").alias("entries"), F.sum("bytes").alias("total_bytes"), F.max("bytes").alias("largest"))
    bundles = sizes.join(totals, "bundle_id", "left").fillna(0, ["entries", "total_bytes", "largest"]).withColumn(
        "error_code",
        F.when(F.col("asked") > limits.max_bundle_assets, "TOO_MANY_ASSETS")
        .when(F.col("entries") == 0, "DOWNLOAD_FAILED")
        .when(F.col("largest") > limits.max_file_bytes, "FILE_TOO_LARGE")
        .when(F.col("total_bytes") > limits.max_bundle_bytes, "ZIP_TOO_LARGE")).drop("largest")
    return entries, bundles
