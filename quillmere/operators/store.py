"""The chunk store: latest version of each chunk, lookups and counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest(chunks: DataFrame, key: str | list[str] = "chunk_id", at: str = "indexed_at") -> DataFrame:
    """One row for each key, the latest; among equals the first by content, so that it is always
    the same. Without a column of that name content alone decides; rows with a null key fall out."""
    keys = [key] if isinstance(key, str) else key
    rest = [F.col(c).cast("string") if not t.startswith("map") else F.to_json(c) for c, t in sorted(chunks.dtypes) if c not in (*keys, at)]
    order = Window.partitionBy(*keys).orderBy(*([F.desc_nulls_last(at)] if at in chunks.columns else []), *(rest or [F.lit(0)]))
    return chunks.dropna(subset=keys).withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def upsert(old: DataFrame, new: DataFrame, key: str | list[str] = "chunk_id", at: str = "indexed_at") -> DataFrame:
    """Old rows that new ones don't replace, and the new ones; a key given twice in new keeps its latest row."""
    keys = [key] if isinstance(key, str) else key
    fresh = latest(new, keys, at)
    return old.join(fresh.select(*keys), keys, "left_anti").unionByName(fresh, allowMissingColumns=True)


def by_doc(chunks: DataFrame, docs: DataFrame) -> DataFrame:
    return chunks.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")


def count_by(chunks: DataFrame, column: str) -> DataFrame:
    return chunks.groupBy(column).agg(F.count("*").alias("n"))


def counts(chunks: DataFrame, columns: tuple[str, ...] = ("split_method", "source_type")) -> DataFrame:
    """by, value, n: how many chunks there are by each value of each column, in one pass."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("by"), F.col(c).cast("string").alias("value")) for c in columns]))
    return chunks.select(pairs.alias("p")).groupBy("p.by", "p.value").agg(F.count("*").alias("n"))


def manifest(chunks: DataFrame, over: int = 512) -> DataFrame:
    """One row: documents, chunks, average and largest tokens, chunks over a limit, documents by kind."""
    return chunks.agg(
        F.countDistinct("doc_id").alias("n_docs"), F.count("*").alias("n_chunks"), F.round(F.avg("n_tokens"), 2).alias("avg_tokens"), F.max("n_tokens").cast("long").alias("max_tokens"),
        F.count_if(F.col("n_tokens") > over).alias("n_over"), F.countDistinct("source_type").alias("n_source_types"), F.countDistinct("split_method").alias("n_split_methods"),
    )
