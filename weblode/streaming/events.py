"""Crawl events: parsing, progress, activity log and status, over streams and tables alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from weblode.functions.fixed import LOG_REASON_LABELS, LOG_SOURCE_LABELS
from weblode.functions.text import settle
from weblode.operators.results import reason_label
from weblode.streaming.limiter import ROCKS_DB
from weblode.streaming.schemas import fault_of

EVENTS = "crawl_id BIGINT, ts TIMESTAMP, event STRING, data STRING"
MAX_LOG = 50

# the members that progress, status and log rows read, of all kinds
_READ = ("url STRING, category STRING, depth INT, source STRING, fromUrl STRING, discoveryReason STRING, pagesDone INT, pagesTotal INT, pageUrl STRING, "
         "media STRUCT<url:STRING,type:STRING,platform:STRING,confidence:DOUBLE,source:STRING>, mediaCount INT, error STRING, originalUrl STRING, "
         "totalPages INT, pagesWithErrors INT, totalMedia INT")


def read_crawl_events(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """Follow a folder of JSON event lines as a stream."""
    reader = spark.readStream.schema(EVENTS)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.json(path)


def parse_events(events: DataFrame) -> DataFrame:
    """Add the parsed struct ``d``, ``valid`` and ``reason``: what the payload's schema has against it, null for a valid row.

    Malformed rows stay, for a side output. The payload is parsed and checked once a row, each behind ``settle``.
    """
    parsed = settle(events, _payload=F.try_parse_json("data"))
    rows = settle(parsed, d=F.from_json("data", _READ), reason=fault_of(F.col("event"), F.col("_payload"))).drop("_payload")
    return rows.withColumn("valid", F.col("reason").isNull())


def crawl_progress(events: DataFrame) -> DataFrame:
    """Latest progress and media count per crawl (a streaming aggregation in update mode)."""
    rows = parse_events(events).filter("valid")
    step = F.when(F.col("event") == "page_processing", F.struct("ts", F.col("d.pagesDone"), F.col("d.pagesTotal")))
    agg = rows.groupBy("crawl_id").agg(
        F.max(step).alias("last"), F.count_if(F.col("event") == "media_found").alias("media_found"))
    done = F.coalesce("last.pagesDone", F.lit(0))
    total = F.coalesce("last.pagesTotal", F.lit(0))
    return agg.select(
        "crawl_id", done.alias("pages_done"), total.alias("pages_total"), "media_found",
        F.when(total > 0, F.floor(done * 100.0 / total + 0.5)).otherwise(0).cast("int").alias("percent"))


def _status(event: Column) -> Column:
    return F.when(event == "crawl_started", "crawling").when(event == "crawl_complete", "complete").when(
        event == "crawl_error", "error")


def crawl_status(events: DataFrame) -> DataFrame:
    """Latest status per crawl, with totals once complete."""
    rows = parse_events(events).filter("valid").withColumn("status", _status(F.col("event"))).filter("status IS NOT NULL")
    last = F.max(F.struct("ts", "status", F.col("d.totalPages"), F.col("d.totalMedia"), F.col("d.error"))).alias("s")
    return rows.groupBy("crawl_id").agg(last).select(
        "crawl_id", "s.status", F.col("s.totalPages").alias("total_pages"), F.col("s.totalMedia").alias("total_media"),
        "s.error")


def activity_log(events: DataFrame) -> DataFrame:
    """One readable log row per event that has one. Stateless, so it runs as a stream as it is."""
    rows = parse_events(events).filter("valid")
    event, d = F.col("event"), F.col("d")
    names = F.create_map(*[F.lit(x) for p in LOG_SOURCE_LABELS.items() for x in p])
    reason = F.coalesce(
        F.when(d.discoveryReason != "", F.concat(F.lit(" • "), reason_label(d.discoveryReason, LOG_REASON_LABELS))), F.lit(""))
    discovered = F.concat(
        F.lit("Página descoberta via "), F.coalesce(F.try_element_at(names, d.source), F.lit("origem")), F.lit(" (depth "),
        d.depth.cast("string"), F.lit(")"), reason)
    message = (
        F.when(event == "page_discovered", discovered)
        .when(event == "page_processing", "Analisando página...")
        .when(event == "media_found", F.concat(F.coalesce(d.media.platform, d.media.type), F.lit(" encontrado")))
        .when(event == "page_complete", F.concat(d.mediaCount.cast("string"), F.lit(" mídia(s) encontrada(s)")))
        .when(event == "page_error", F.concat(F.lit("Erro: "), d.error)))
    kind = (
        F.when(event == "page_discovered", "discovered").when(event == "page_processing", "processing")
        .when(event == "media_found", "media_found").when(event == "page_complete", "complete")
        .when(event == "page_error", "error"))
    out = rows.select("crawl_id", "ts", kind.alias("type"), F.coalesce("d.url", "d.pageUrl").alias("url"),
                      message.alias("message"))
    return out.filter("type IS NOT NULL")


def activity_tail(log: DataFrame, size: int = MAX_LOG) -> DataFrame:
    """Newest rows per crawl; the limit is applied before the exchange as well as after it."""
    order = W.partitionBy("crawl_id").orderBy(F.desc("ts"), "type", "url", "message")
    return log.withColumn("recent", F.row_number().over(order)).filter(F.col("recent") <= size)


TAIL = "crawl_id bigint, ts_us bigint, type string, url string, message string, change string"
KEPT = "ts_us bigint, type string, url string, message string"


def _tail_processor(size: int, idle_ms: int):
    class Tail(StatefulProcessor):
        """The newest rows of one crawl."""

        def init(self, handle) -> None:
            self.handle = handle
            self.kept = handle.getListState("tail", KEPT)

        def handleInputRows(self, key, rows, timerValues):
            from collections import Counter

            import pandas as pd

            def order(row):  # as activity_tail: newest first, then by the texts, nulls as Spark has them
                return (row[0] is None, -(row[0] or 0), *((text is not None, text or "") for text in row[1:]))

            before = [tuple(row) for row in self.kept.get()]
            now = before
            for pdf in rows:
                columns = [[None if pd.isna(v) else v for v in pdf[c]] for c in ("ts_us", "type", "url", "message")]
                fresh = [(None if t is None else int(t), *texts) for t, *texts in zip(*columns)]
                now = sorted([*now, *fresh], key=order)[:size]
            self.kept.put(now)
            newest = max((row[0] for row in now if row[0] is not None), default=0)
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(newest // 1000 + idle_ms)
            came, went = Counter(now) - Counter(before), Counter(before) - Counter(now)
            changes = [(*row, "in") for row in came.elements()] + [(*row, "out") for row in went.elements()]
            yield pd.DataFrame({
                "crawl_id": pd.array([key[0]] * len(changes), "Int64"), "ts_us": pd.array([c[0] for c in changes], "Int64"),
                **{name: pd.array([c[i] for c in changes], object) for i, name in enumerate(("type", "url", "message", "change"), 1)}})

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            self.kept.clear()
            return iter(())

        def close(self) -> None:
            pass

    return Tail


def tail_changes(events: DataFrame, size: int = MAX_LOG, idle_ms: int = 86_400_000, late: str = "1 hour") -> DataFrame:
    """The activity tail of every crawl as a stream of changes: rows that come ``in`` and rows that go ``out``, appended and never rewritten.

    The state is a list of ``size`` rows a crawl at most. The watermark follows the events' own times, ``late`` behind the newest; once it
    is ``idle_ms`` past a crawl's newest row, a timer removes that crawl's state. ``current_tail`` adds the changes up. A row older
    than all of a full tail changes nothing and is not put out.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS_DB)
    log = activity_log(events.withWatermark("ts", late)).select("crawl_id", "ts", F.unix_micros("ts").alias("ts_us"), "type", "url", "message")
    changes = log.groupBy("crawl_id").transformWithStateInPandas(
        statefulProcessor=_tail_processor(size, idle_ms)(), outputStructType=TAIL, outputMode="Append", timeMode="EventTime")
    return changes.select("crawl_id", F.timestamp_micros("ts_us").alias("ts"), "type", "url", "message", "change")


def current_tail(changes: DataFrame) -> DataFrame:
    """The tail that all changes so far leave, whatever their order."""
    rows = ["crawl_id", "ts", "type", "url", "message"]
    left = changes.groupBy(*rows).agg(F.sum(F.when(F.col("change") == "in", 1).otherwise(-1)).cast("int").alias("n")).filter("n > 0")
    return left.select(*rows, F.explode(F.sequence(F.lit(1), F.col("n"))).alias("_copy")).drop("_copy")
