"""URL filters: dated list entries as validity intervals, joined as of the fetch time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weblode.functions.urls import host_of, path_of
from weblode.sources.stages import written

#: Seconds of a time bucket: intervals and captures meet on (rule, bucket), so a busy rule is dealt out over time.
BUCKET = 30 * 86400


def rule_keys(url: Column) -> Column:
    """The rules that could hold for a URL: its host, every parent domain, and host with path (no slash at the end)."""
    labels = F.split(host_of(url), r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    page = F.concat(host_of(url), F.regexp_replace(path_of(url), "/+$", ""))
    keys = F.filter(F.array_distinct(F.concat(domains, F.array(page))), lambda k: k != "")
    return F.when(host_of(url) != "", keys).otherwise(F.array().cast("array<string>"))


def intervals(changes: DataFrame) -> DataFrame:
    """``changes(list, rule, verdict, action, at)`` to validity intervals [since, until) of what was on the lists.

    ``action`` is ``add`` or ``remove``, ``at`` seconds since 1970. An entry holds from its change to the next change of the same
    rule on the same list; of changes at the same second an add counts after a remove, and repeated changes are one. Changes
    with a null list, rule, action or time, or another action, are left out; an entry that was not followed has no end.
    """
    clean = changes.selectExpr("cast(list as string) as list", "cast(rule as string) as rule", "cast(verdict as string) as verdict",
                               "cast(action as string) as action", "cast(at as long) as at")
    clean = clean.filter("list is not null and rule is not null and at is not null and action in ('add', 'remove')")
    last = clean.groupBy("list", "rule", "at").agg(F.max(F.struct((F.col("action") == "add").alias("on"), "verdict")).alias("state"))
    until = F.lead("at").over(Window.partitionBy("list", "rule").orderBy("at"))
    return last.withColumn("until", until).filter("state.on").select(
        "list", "rule", F.col("state.verdict").alias("verdict"), F.col("at").alias("since"), "until")


def filter_urls(captures: DataFrame, changes: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """``captures(page_id, url, fetched_at, ...)`` to one row per input row: page_id, url, fetched_at, n_active, rule, list, verdict, kept.

    Every capture is held against the entries that were active at its fetch time, ``since <= fetched_at < until``. The longest rule
    decides, between equal rules ``allow`` before ``block``, then the first list by code point; ``n_active`` counts all active entries.
    ``kept`` is false where the verdict is ``block``; other verdicts than these two are treated as neither.

    Rules and captures are joined on (rule, time bucket): no interval meets a capture of another bucket, and a domain with a third of
    all captures is dealt over buckets, then split by adaptive execution. Captures with a null url or time match nothing and are
    kept. Repeated captures each get their row; an empty list keeps everything; an empty table gives no rows; other columns are ignored.
    """
    rows = written(captures.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("fetched_at").cast("long").alias("fetched_at"),
        F.monotonically_increasing_id().alias("row")), "url-captures")
    horizon = rows.agg(F.max("fetched_at")).first()[0] or 0
    at = F.floor(F.col("fetched_at") / bucket)
    asked = rows.filter("url is not null and fetched_at is not null").select("row", "fetched_at", at.alias("bucket"), F.explode(rule_keys(F.col("url"))).alias("rule"))
    valid = intervals(changes).filter(F.col("since") <= horizon)
    held = valid.withColumn("bucket", F.explode(F.sequence(
        F.floor(F.col("since") / bucket), F.floor(F.least(F.coalesce("until", F.lit(horizon)), F.lit(horizon)) / bucket))))
    hits = asked.join(held, ["rule", "bucket"]).filter("since <= fetched_at and (until is null or fetched_at < until)")
    code = F.transform(F.split("list", ""), lambda c: -F.ascii(c))
    found = hits.groupBy("row").agg(
        F.count("*").alias("n_active"),
        F.max(F.struct(F.length("rule").alias("size"), (F.col("verdict") == "allow").alias("allow"), code.alias("code"), "rule", "list", "verdict")).alias("best"))
    verdict = F.col("best.verdict")
    return rows.join(found, "row", "left").select(
        "page_id", "url", "fetched_at", F.coalesce("n_active", F.lit(0)).cast("long").alias("n_active"), F.col("best.rule").alias("rule"),
        F.col("best.list").alias("list"), verdict.alias("verdict"), F.coalesce(verdict != "block", F.lit(True)).alias("kept"))
