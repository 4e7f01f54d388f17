"""Registered queries of the operators in this subpackage, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weblode.functions.urls import host_of
from weblode.llm.exact import exact_groups
from weblode.llm.extract import extract_text
from weblode.llm.infill import fill_in_middle, restored
from weblode.llm.jaccard import jaccard_components
from weblode.llm.language import held_out, learn, predict
from weblode.llm.lines import dedup_lines, dedup_passages
from weblode.llm.mixing import mixture
from weblode.llm.pieces import encode
from weblode.llm.quality import quality_measures
from weblode.llm.sharding import place
from weblode.llm.superminhash import near_duplicates
from weblode.llm.urlfilter import filter_urls, rule_keys
from weblode.llm.whiten import fit, identity_error, whiten

SHARDS = [f"shard-{i:03d}" for i in range(100)]
DAY = 86_400
FIRST_DAY = 1_704_067_200


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_lookup_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document on one of 100 shards, and where it would be were the last shard taken away."""
    placed = place(_documents(spark, sf_dir).select("doc_id"), "doc_id", SHARDS).withColumnsRenamed({"_shard": "shard", "_slot": "slot"})
    fewer = place(placed, "doc_id", SHARDS[:-1]).withColumnRenamed("_shard", "shard_after_removal")
    return fewer.select("doc_id", "slot", "shard", "shard_after_removal")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    found = predict(docs, learn(docs.filter(~held_out(F.col("doc_id")))))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def _digit(text, at: int, n: int):
    """A number from ``n`` hex digits of the MD5 of a text."""
    return F.conv(F.substring(F.md5(text), at, n), 16, 10).cast("long")


def url_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as captures of one year, the second drawn from the page_id."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return pages.withColumn("fetched_at", FIRST_DAY + _digit(F.col("page_id").cast("string"), 1, 7) % (365 * DAY))


def url_changes(captures: DataFrame) -> DataFrame:
    """Dated list entries for the rules that the captured URLs could fall under: most are blocked for a while, some pages allowed."""
    rules = captures.select(F.explode(rule_keys(F.col("url"))).alias("rule")).distinct().filter(F.contains("rule", F.lit(".")))
    page = F.contains("rule", F.lit("/"))
    since = FIRST_DAY + _digit(F.col("rule"), 1, 7) % (300 * DAY)
    removed = since + DAY + _digit(F.col("rule"), 8, 6) % (60 * DAY)
    again = removed + DAY + _digit(F.col("rule"), 14, 6) % (60 * DAY)
    kind = _digit(F.col("rule"), 20, 2)
    listed = rules.filter(F.when(page, kind % 4 == 0).otherwise(kind % 8 != 0)).select(
        "rule", F.when(page & (kind % 8 == 0), "allow").otherwise("block").alias("verdict"), since.alias("since"), removed.alias("removed"),
        again.alias("again"), kind.alias("kind"))
    entry = lambda action, at: F.struct(F.lit(action).alias("action"), at.alias("at"))
    steps = F.array(
        entry("add", F.col("since")), F.when(F.col("kind") % 3 != 0, entry("remove", F.col("removed"))), F.when(F.col("kind") % 3 == 2, entry("add", F.col("again"))))
    return listed.select(F.concat(F.col("verdict"), F.lit("-list")).alias("list"), "rule", "verdict", F.explode(F.filter(steps, lambda x: x.isNotNull())).alias("step")).select(
        "list", "rule", "verdict", "step.action", "step.at")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    captures = url_captures(spark, sf_dir)
    found = filter_urls(captures, url_changes(captures))
    return found.select("page_id", "url", host_of(F.col("url")).alias("host"), "fetched_at", "n_active", "rule", "verdict", "kept")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_measures(_documents(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "ratio", "odd_chunks")


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(_documents(spark, sf_dir), keep=["doc_id"], check=True)


def op6_text_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(_documents(spark, sf_dir), digests=True).withColumnRenamed("full_hash", "text_sha256").select(
        "doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard_components(_documents(spark, sf_dir), k=3, percent=90)
    return found.select("doc_id", "n_shingles", "component_id", "class_id")


def op9_sainte_lague_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture(_documents(spark, sf_dir))


def op10_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = dedup_lines(_documents(spark, sf_dir).select("doc_id", "text"))
    return kept.select("doc_id", F.col("_chunks_removed").alias("chunks_removed"), F.col("_lines_removed").alias("lines_removed"), "text")


def op10_line_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = dedup_passages(_documents(spark, sf_dir).select("doc_id", "text"))
    return kept.select("doc_id", F.col("_lines_removed").alias("lines_removed"), "text")


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(_documents(spark, sf_dir), seed=7, fim_percent=100, spm_percent=50)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                       F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


def op12_polarised_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and components; ``deviation`` is null where it leaves 64 bits (the operator has it as a decimal)."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    model = fit(vectors)
    white = whiten(vectors, model, ["vec_id"], k=8)
    error = identity_error(white, min(8, len(model.eigenvalues)))
    explained = F.array(*[F.lit(float(e)) for e in model.explained[:8]]).cast("array<double>")
    entries = white.select("vec_id", F.expr("try_cast(deviation as long)").alias("deviation"), F.posexplode("whitened").alias("at", "whitened"))
    return entries.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
                          F.get(explained, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"))


def op13_superminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_documents(spark, sf_dir), k=4, percent=80).select("doc_id", "n_shingles", "component_id", "kept", "class_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_lookup_sharding, op2_language_id, op3_url_filter, op4_quality_rules, op5_sentencepiece, op6_text_density, op7_exact_dedup,
        op8_jaccard_join, op9_sainte_lague_mix, op10_line_chunks, op10_line_passages, op11_fill_in_middle, op12_polarised_whitening,
        op13_superminhash)
}
