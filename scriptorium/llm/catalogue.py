"""The subpackage's queries by name, each ``(spark, folder) -> DataFrame``, and SQL for those that it can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.llm import leaks, mixing, near_duplicates, replies, split, toxicity
from scriptorium.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


@query()
def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of chunks of one edition with nearly the same rules text."""
    found = near_duplicates.near_duplicates(near_duplicates.chunk_rows(table(spark, folder, "chunks")), near_duplicates.CHUNK_SPEC)
    return near_duplicates.similar_ids(found).select(F.col("id_a").alias("chunk_a"), F.col("id_b").alias("chunk_b"))


@query()
def p2_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Every chunk with its class of equal texts and its group of similar ones."""
    found = near_duplicates.near_duplicates(near_duplicates.chunk_rows(table(spark, folder, "chunks")), near_duplicates.CHUNK_SPEC)
    return near_duplicates.labelled_members(found).withColumnsRenamed({"id": "chunk_id", "part": "edition"})


@query()
def p2_documents(spark: SparkSession, folder: str) -> DataFrame:
    """The same for documents, on runs of five words and a similarity of 0.8."""
    rows = table(spark, folder, "documents").select(F.col("doc_id").cast("string").alias("id"), F.lit("").alias("part"), F.col("text").alias("body"))
    found = near_duplicates.near_duplicates(rows, near_duplicates.NearDuplicateSpec())
    return near_duplicates.labelled_members(found).select(F.col("id").cast("bigint").alias("doc_id"), "class_id", "group_id")


def _pieces(spark: SparkSession, folder: str) -> DataFrame:
    return split.split_oversized(table(spark, folder, "chunks").select(F.col("chunk_id").alias("id"), "text")).withColumnRenamed("id", "chunk_id")


@query("SELECT DISTINCT chunk_id FROM chunks WHERE length(text) > 2400")
def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks that had to be split."""
    return _pieces(spark, folder).select("chunk_id").distinct()


@query()
def p5_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """The pieces of oversized chunks."""
    return _pieces(spark, folder)


@query()
def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with the test items they leak."""
    return leaks.find_leaks(table(spark, folder, "documents"), table(spark, folder, "eval_items")).select("doc_id", "item_id").distinct()


@query()
def p6_leaked_items(spark: SparkSession, folder: str) -> DataFrame:
    """Test items by the number of documents that hold them."""
    found = leaks.find_leaks(table(spark, folder, "documents"), table(spark, folder, "eval_items"))
    return found.groupBy("item_id").agg(F.count_distinct("doc_id").alias("documents"), F.max("containment").alias("most_contained"), F.max("windows").alias("most_windows"))


@query()
def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Defective pairs of question and reply."""
    return replies.tag_pairs(table(spark, folder, "conversations")).filter("defect is not null").select("conv_id", "pair_no", "defect")


@query()
def p7_mixture(spark: SparkSession, folder: str) -> DataFrame:
    """The documents of the mixture with their numbers of copies."""
    return mixing.mix(table(spark, folder, "documents"), table(spark, folder, "mix_targets")).documents


@query()
def p7_report(spark: SparkSession, folder: str) -> DataFrame:
    """Wanted and actual shares of the mixture."""
    return mixing.mix(table(spark, folder, "documents"), table(spark, folder, "mix_targets")).report


def _scored(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.score_documents(table(spark, folder, "documents"), table(spark, folder, "doc_labels"))


@query()
def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with abusive, hateful or sexual language."""
    return _scored(spark, folder).filter("toxic").select("doc_id")


@query()
def p8_scores(spark: SparkSession, folder: str) -> DataFrame:
    """The score of every document."""
    return _scored(spark, folder)


@query()
def p8_rates(spark: SparkSession, folder: str) -> DataFrame:
    """Toxic documents by source."""
    return toxicity.rates_by_source(_scored(spark, folder))
