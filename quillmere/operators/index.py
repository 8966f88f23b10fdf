"""A stored index of search terms: postings, statistics of terms, lengths of chunks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmere.functions import text as tx
from quillmere.operators import lexicon as lx

#: Postings are laid out by the hash of their term, so that a search reads few files.
FILES = 64


def words_of(df: DataFrame, text: str = "text", lexicon: DataFrame | None = None) -> DataFrame:
    """Adds words, the search terms of a text; with a lexicon its terms are kept whole beside the
    pairs of characters they consist of."""
    own = tx.tokens(text)
    if lexicon is not None:
        whole = F.filter(F.transform(lx.entities(lexicon, text), lambda e: F.lower(e["text"])), lambda t: F.length(t) > 2)
        own = F.concat(own, whole)
    return df.withColumn("words", own)


@dataclass
class TermIndex:
    """postings: term, chunk_id, length, tf. terms: term, df. sizes: one row of n_chunks, total,
    n_terms and the sum of the raw weights of all terms."""

    postings: DataFrame
    terms: DataFrame
    sizes: DataFrame
    whole_terms: bool = False

    @staticmethod
    def build(chunks: DataFrame, lexicon: DataFrame | None = None) -> TermIndex:
        """The index of chunks (chunk_id, text), each id once; null texts have no postings."""
        words = words_of(chunks.where("chunk_id is not null and text is not null").select("chunk_id", "text"), "text", lexicon).select("chunk_id", "words", F.size("words").alias("length"))
        postings = words.select("chunk_id", "length", F.explode("words").alias("term")).groupBy("term", "chunk_id", "length").agg(F.count("*").alias("tf"))
        terms = postings.groupBy("term").agg(F.count("*").alias("df"))
        chunk_sizes = words.agg(F.count("*").alias("n_chunks"), F.coalesce(F.sum("length"), F.lit(0)).alias("total"))
        raw = F.log(F.col("n_chunks") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
        sums = terms.join(F.broadcast(chunk_sizes)).agg(F.count("*").alias("n_terms"), F.sum(raw).alias("raw_sum"))
        return TermIndex(postings, terms, chunk_sizes.join(F.broadcast(sums)), lexicon is not None)

    def save(self, folder: str) -> None:
        files = F.pmod(F.xxhash64("term"), F.lit(FILES)).cast("int")
        self.postings.withColumn("part", files).repartition(FILES, "part").sortWithinPartitions("term").write.mode("overwrite").partitionBy("part").parquet(f"{folder}/postings")
        stored = self.postings.sparkSession.read.parquet(f"{folder}/postings")
        stored.groupBy("term").agg(F.count("*").alias("df")).write.mode("overwrite").parquet(f"{folder}/terms")
        self.sizes.withColumn("whole_terms", F.lit(self.whole_terms)).write.mode("overwrite").parquet(f"{folder}/sizes")

    @staticmethod
    def load(spark: SparkSession, folder: str) -> TermIndex:
        read = lambda name: spark.read.parquet(f"{folder}/{name}")
        sizes = read("sizes")
        return TermIndex(read("postings"), read("terms"), sizes.drop("whole_terms"), bool(sizes.first()["whole_terms"]))

    def of(self, asked: DataFrame) -> DataFrame:
        """The postings of terms (term). Of a stored index only the files that can hold them are read."""
        if "part" in self.postings.columns:
            asked = asked.withColumn("part", F.pmod(F.xxhash64("term"), F.lit(FILES)).cast("int"))
            return self.postings.join(asked, ["part", "term"], "left_semi").drop("part")
        return self.postings.join(asked, "term", "left_semi")

    def weights(self, epsilon: float) -> DataFrame:
        """term, df, idf. A term in more than half of the chunks gets a small share of the mean."""
        raw = F.log(F.col("n_chunks") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
        joined = self.terms.join(F.broadcast(self.sizes)).withColumn("raw", raw)
        return joined.select("term", "df", F.when(F.col("raw") < 0, epsilon * F.col("raw_sum") / F.col("n_terms")).otherwise(F.col("raw")).alias("idf"))
