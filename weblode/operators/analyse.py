"""The analysis of captured pages: admission and extraction in one pass over the bodies."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from weblode.config import Limits
from weblode.functions.fixed import ANALYSE_CODES
from weblode.functions.urls import public_url_error
from weblode.operators.admission import admit_pages
from weblode.operators.media import extract_media
from weblode.operators.tokens import elements
from weblode.sources.stages import written


def analyse_pages(fetches: DataFrame, player_scripts: DataFrame | None = None, limits: Limits = Limits(),
                  seen: Observation | None = None) -> tuple[DataFrame, DataFrame]:
    """(assets, pages) of a log ``fetches(page_id, url, status, content_type, content_length, body, error)``.

    ``assets`` are those of ``extract_media`` for admitted pages, with ``is_public``: an asset at a private or unusable address is
    flagged, and fails nothing else. ``pages`` has one row per fetch: ``error_code`` (null when admitted), ``total_found``, ``public_found``.

    A body is judged and, if admitted, cut into elements where it is scanned; that one pass is stored, refused pages as a row of their
    own, and both results read the store. A refused body is never tokenised. ``seen`` observes how many pages each code refused.
    """
    judged = admit_pages(fetches, "analyse", limits)
    if seen is not None:
        codes = [F.count_if(F.col("error_code") == code).alias(code) for code in ANALYSE_CODES]
        judged = judged.observe(seen, F.count(F.lit(1)).alias("pages"), F.count_if(F.col("error_code").isNull()).alias("admitted"), *codes)
    rows = judged.select("page_id", "url", "error_code", F.when(F.col("error_code").isNull(), F.col("body")).alias("html"))
    els = written(elements(rows, outer=["error_code"]), "analysed")
    assets = extract_media(rows, player_scripts, limits, els.filter("pos IS NOT NULL").drop("error_code"))
    assets = written(assets.withColumn("is_public", public_url_error(F.col("url"), F.col("url")).isNull()), "analysed-assets")
    counts = assets.groupBy("page_id").agg(F.count("*").alias("total_found"), F.count_if("is_public").alias("public_found"))
    pages = els.groupBy("page_id", F.col("page_url").alias("url"), "error_code").agg(F.count("*").alias("_n")).drop("_n")
    return assets, pages.join(counts, "page_id", "left").fillna(0, ["total_found", "public_found"])
