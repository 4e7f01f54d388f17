"""Documents to training tokens: quality rules, line dedup, near duplicates, mixing, pieces."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weblode.llm.jaccard import jaccard_components
from weblode.llm.lines import dedup_passages
from weblode.llm.mixing import whole_copies
from weblode.llm.pieces import encode
from weblode.llm.quality import good_documents
from weblode.sources.stages import written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go. A null or empty text has no words and goes; every other row is judged alone, so repeated rows
    share a verdict; other columns are kept; an empty table stays empty."""
    return good_documents(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more and chunks of lines that an earlier document has too go from the texts, ``n_chars`` follows; a document
    that lost all of its text goes.

    Null and empty texts lose nothing and stay; of repeated texts the first keeps its lines; other columns are kept, an empty table stays empty."""
    lost = F.col("_lines_removed") > 0
    kept = dedup_passages(docs).filter(~lost | (F.trim("text") != ""))
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.when(lost, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return kept.select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a Jaccard similarity of 0.8 or more over five words, the one with the smallest doc_id stays.

    Documents without words and rows without a doc_id are linked with nothing and stay; rows that share a doc_id stay or go together; other
    columns are kept; an empty table stays empty."""
    gone = jaccard_components(docs, k=5, percent=80).filter("doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes its words, as whole copies: a shard's cut documents are rounded together, towards its quota.

    Documents without words are taken 0 times. A null doc_id and a null source are values like others; repeated rows are each taken as
    often; an empty table stays empty; other columns are kept whatever their names.
    """
    names = docs.columns
    place = next(i for i, name in enumerate(names) if name.lower() == "doc_id")
    rows = docs.toDF(*[f"c{i}" for i in range(len(names))])
    taken = whole_copies(docs).select(F.col("doc_id").alias("mixed_id"), "copies")
    both = rows.join(taken, F.col(f"c{place}").cast("long").eqNullSafe(F.col("mixed_id")))
    each = both.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return each.select(*[F.col(f"c{i}").alias(name) for i, name in enumerate(names)])


def sentence_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The texts as piece ids, one row for each row: null texts have none; other columns are kept; an empty table stays empty."""
    return encode(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("mixing", mixing),
    ("sentence_pieces", sentence_pieces),
]

#: Compression ratios and piece merges are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
