"""Seeded samples. Order is by hash, the same on every cluster and in every run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def shuffled(key: str, seed: int) -> Column:
    """What to order by for a seeded shuffle."""
    return F.md5(F.concat_ws("#", F.lit(str(seed)), F.col(key).cast("string")))


def stratified(df: DataFrame, key: str, stratum: str, size: int, always: str | None = None, seed: int = 42) -> DataFrame:
    """About size rows, each stratum by its share and with at least one; rows of the stratum named
    by always are all kept and come first. A table that is small enough is kept whole."""
    counts = df.groupBy(stratum).agg(F.count("*").alias("_n"))
    sums = counts.agg(F.sum("_n").alias("_all"), F.sum(F.when(F.col(stratum) == (always or ""), F.col("_n")).otherwise(0)).alias("_kept"))
    quota = counts.join(F.broadcast(sums)).withColumn("_q", F.when(F.col("_all") <= size, F.col("_n")).when(F.col(stratum) == (always or ""), F.col("_n")).otherwise(
        F.greatest(F.lit(1), F.bround((size - F.col("_kept")) * F.col("_n") / F.greatest(F.lit(1), F.col("_all") - F.col("_kept"))))))
    place = Window.partitionBy(stratum).orderBy(shuffled(key, seed), key)
    chosen = df.join(F.broadcast(quota.select(stratum, "_q", "_all")), stratum).withColumn("_r", F.row_number().over(place)).where("_r <= _q")
    first = F.when(F.col(stratum) == (always or ""), 0).otherwise(1)
    return chosen.orderBy(first, shuffled(key, seed + 1), key).limit(size).drop("_r", "_q", "_all")


def round_robin(df: DataFrame, key: str, group: str, size: int, seed: int = 42) -> DataFrame:
    """size rows, one of each group in turn."""
    place = Window.partitionBy(group).orderBy(shuffled(key, seed), key)
    return df.withColumn("_r", F.row_number().over(place)).orderBy("_r", group).limit(size).drop("_r")


def first_keyword(texts: Column, keywords: list[str]) -> Column:
    """The first keyword of a list that a text holds; null if none does."""
    return F.coalesce(*[F.when(F.contains(texts, F.lit(k)), k) for k in keywords])


def supplement(pool: DataFrame, used: DataFrame, keywords: list[str], priority: list[str], size: int, quota: int = 40, least_score: int = 3, least_question: int = 8, least_answer: int = 40, seed: int = 42) -> DataFrame:
    """size question records not used before: first up to quota of each priority keyword, best
    scores first, then one of each keyword in turn among better ones, then the rest."""
    fresh = pool.where("id is not null").dropDuplicates(["id"]).join(used.select("id").distinct(), "id", "left_anti")
    fit = fresh.where((F.col("score") >= least_score) & (F.length(F.trim("question")) >= least_question) & (F.length(F.trim("answer")) >= least_answer))
    hit = fit.withColumn("keyword", first_keyword(F.concat_ws("\n", "question", "answer"), keywords)).where("keyword is not null")
    rank = Window.partitionBy("keyword").orderBy(F.desc("score"), shuffled("id", seed), "id")
    ranked = hit.withColumn("_r", F.row_number().over(rank))
    ahead = F.col("keyword").isin(priority) & (F.col("_r") <= quota)
    phase = F.when(ahead, 0).when(F.col("score") > least_score, 1).otherwise(2)
    order = F.array_position(F.array(*map(F.lit, [*priority, *keywords])), F.col("keyword"))
    return ranked.withColumn("phase", phase).orderBy("phase", F.when(F.col("phase") == 0, order).otherwise(F.col("_r")), F.when(F.col("phase") == 0, F.col("_r")).otherwise(order), "id").limit(size).drop("_r")
