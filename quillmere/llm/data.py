"""The tables the queries of this subpackage read, in the shape their operators expect."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmere.session import table


def records(spark: SparkSession, folder: str) -> DataFrame:
    """Texts of source_documents and chunks: record_table, key, text."""
    return (
        table(spark, folder, "source_documents")
        .select(F.lit("source_documents").alias("record_table"), F.col("doc_id").alias("key"), "text")
        .unionByName(table(spark, folder, "chunks").select(F.lit("chunks").alias("record_table"), F.col("chunk_id").alias("key"), "text"))
    )


SCANNED = ["pdf", "pdf_scan", "ocr_scan"]


def clean_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Texts not taken from pages, and chat turns: record_table, record_key, text."""
    documents = table(spark, folder, "source_documents").where(F.col("source_type").isNull() | ~F.col("source_type").isin(SCANNED))
    turns = table(spark, folder, "turns")
    return documents.select(F.lit("source_documents").alias("record_table"), F.col("doc_id").alias("record_key"), "text").unionByName(
        turns.select(F.lit("turns").alias("record_table"), F.concat_ws("#", "session", F.col("turn").cast("string")).alias("record_key"), "text")
    )


def page_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Texts taken from pages: record_table, record_key, title, text, is_chunk."""
    documents = table(spark, folder, "source_documents").where(F.col("source_type").isin(SCANNED))
    chunks = table(spark, folder, "chunks").where(F.col("source_type").isNull() | F.col("source_type").isin(SCANNED))
    return documents.select(F.lit("source_documents").alias("record_table"), F.col("doc_id").alias("record_key"), "title", "text", F.lit(False).alias("is_chunk")).unionByName(
        chunks.select(F.lit("chunks").alias("record_table"), F.col("chunk_id").alias("record_key"), F.element_at("meta", "doc_title").alias("title"), "text", F.lit(True).alias("is_chunk"))
    )
