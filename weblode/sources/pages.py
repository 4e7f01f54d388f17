"""Captured pages: scanning, spreading small inputs, writing results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

PAGES = T.StructType([
    T.StructField("page_id", T.LongType()),
    T.StructField("url", T.StringType()),
    T.StructField("html", T.StringType()),
])


def spread(df: DataFrame, key: str) -> DataFrame:
    """Use every core when a scan has fewer splits than the cluster has slots.

    A table of many files or row groups is left exactly as scanned, so nothing large is ever moved;
    a small one is hashed by ``key`` and later steps keyed by it need no further exchange.
    """
    slots = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(slots, key) if df.rdd.getNumPartitions() < slots else df


def scan_pages(spark: SparkSession, path: str) -> DataFrame:
    """Batch scan with a fixed schema; column pruning and filters reach the files."""
    return spark.read.schema(PAGES).parquet(path)


def stream_pages(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """The same table followed as a stream of newly captured files."""
    reader = spark.readStream.schema(PAGES)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def write_assets(assets: DataFrame, path: str) -> None:
    """Partitioned by type and extension: 24 known values, so the directory count is bounded."""
    assets.write.mode("overwrite").partitionBy("type", "extension").parquet(path)


def read_assets(spark: SparkSession, path: str) -> DataFrame:
    """What ``write_assets`` or ``follow_assets`` has written, with type and extension from the folder names."""
    return spark.read.parquet(path)


def follow_assets(pages: DataFrame, extract: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Extract a stream of captured pages into a folder of assets, exactly once.

    Every micro-batch owns the folder ``batch=<id>`` and replaces it whole, so a batch that is run again after a failure leaves the very same
    files and none of an earlier try. ``once`` ends the query when all pages that are there have been read.
    """
    def write(batch: DataFrame, epoch: int) -> None:
        write_assets(extract(batch), f"{path}/batch={epoch}")

    writer = pages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def write_clustered_pages(pages: DataFrame, table: str, buckets: int) -> None:
    """Store pages bucketed by page_id: page-keyed windows and joins over it then need no exchange."""
    pages.write.mode("overwrite").bucketBy(buckets, "page_id").sortBy("page_id").saveAsTable(table)


def write_crawl_report(report: DataFrame, path: str) -> None:
    """Nested crawl results as JSON lines."""
    report.write.mode("overwrite").json(path)


def analysis(assets: DataFrame, pages: DataFrame) -> DataFrame:
    """Per page: its URL, how many assets were found, and the assets in order as an array."""
    item = F.struct("ord", "url", "type", "file_name", "extension", "source_tag")
    per_page = assets.groupBy("page_id").agg(
        F.count("*").alias("total_found"), F.array_sort(F.collect_list(item)).alias("assets"))
    joined = pages.select("page_id", F.col("url").alias("page_url")).join(per_page, "page_id", "left")
    return joined.withColumn("total_found", F.coalesce("total_found", F.lit(0)))
