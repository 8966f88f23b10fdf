"""Dense vectors of texts and exact top-k by inner product.

Encoders are interchangeable: HashEncoder needs no model; any object with encode(texts) -> array
and a dim can take its place and then runs on Arrow batches in the Python workers.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmere.session import cut


class Encoder(Protocol):
    dim: int

    def encode(self, texts: list[str], is_query: bool = False) -> np.ndarray: ...


class HashEncoder:
    """Unit vectors of hashed characters and character pairs with 1 + ln(count) weights.

    Equal in every process and in SQL: the bucket is the head of the MD5 of the gram. A text
    without characters has the zero vector.
    """

    def __init__(self, dim: int = 256):
        self.dim = dim
        self._bucket: dict[str, int] = {}

    def __getstate__(self):
        return self.dim

    def __setstate__(self, dim):
        self.__init__(dim)

    def bucket(self, gram: str) -> int:
        if (b := self._bucket.get(gram)) is None:
            if len(self._bucket) > 1_000_000:
                self._bucket.clear()
            b = self._bucket[gram] = int(hashlib.md5(gram.encode()).hexdigest()[:8], 16) % self.dim
        return b

    def encode(self, texts: list[str], is_query: bool = False) -> np.ndarray:
        out = np.zeros((len(texts), self.dim))
        for k, t in enumerate(texts):
            s = "".join((t or "").split())
            for gram, n in sorted(Counter([*s, *(s[i : i + 2] for i in range(len(s) - 1))]).items()):
                out[k, self.bucket(gram)] += 1 + math.log(n)
        norms = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, norms, out=out, where=norms > 0)


def create_encoder(preferred: Encoder | None = None, dim: int = 256) -> Encoder:
    """The preferred encoder, or the hash encoder where there is none."""
    return preferred if preferred is not None else HashEncoder(dim)


def encode(df: DataFrame, text: str, encoder: Encoder | None = None, out: str = "embedding", is_query: bool = False) -> DataFrame:
    """Adds the vector of a text column; null gives null."""
    e = create_encoder(encoder)

    @F.pandas_udf("array<double>")
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for values in batches:
            made = iter(e.encode([v for v in values if v is not None], is_query))
            yield pd.Series([None if v is None else next(made) for v in values], dtype=object)

    return df.withColumn(out, vectors(text))


def top_k(queries: DataFrame, rows: DataFrame, k: int, query_id: str = "query_id", row_id: str = "chunk_id", vector: str = "embedding", block: int = 5000, skip_same: bool = False) -> DataFrame:
    """query_id, row id, score, rank: the k rows of highest inner product for each query.

    queries and rows hold an id and a vector. Queries are a stated set: they go in blocks of
    block rows, each sent to all tasks; every task keeps its k best rows for each query, so at
    most tasks * queries * k rows are shuffled. Rows whose vector is null, of another size or
    not finite are skipped. Equal scores (rounded to 6) rank by the smaller id. An empty table
    gives no row, and k beyond the rows gives all of them.
    """
    spark = queries.sparkSession
    qtype, rtype = dict(queries.dtypes)[query_id], dict(rows.dtypes)[row_id]
    schema = f"{query_id} {qtype}, {row_id} {rtype}, score double"
    given = queries.select(query_id, vector).where(f"{query_id} is not null and {vector} is not null").dropDuplicates([query_id])
    total = given.count()
    best = None
    # The size that most queries have is that of all; of equally common sizes the smaller.
    size = given.groupBy(F.size(vector).alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").first()
    dim = size["dim"] if size else 0
    given = given.where(F.size(vector) == dim).withColumn("_n", F.row_number().over(Window.orderBy(query_id)) - 1) if total > block else given.where(F.size(vector) == dim).withColumn("_n", F.lit(0))
    if total > block:
        given = cut(given)
    for start in range(0, total, block):
        part = given.where((F.col("_n") >= start) & (F.col("_n") < start + block)).toPandas()
        if not len(part):
            continue
        shared = spark.sparkContext.broadcast((part[query_id].to_numpy(), np.stack(part[vector].to_numpy()).astype(np.float64)))

        def search(batches: Iterator[pd.DataFrame], shared=shared, dim=dim) -> Iterator[pd.DataFrame]:
            ids, matrix = shared.value
            for batch in batches:
                fit = [v is not None and len(v) == dim for v in batch[vector]]
                batch = batch[fit]
                if not len(batch):
                    continue
                x = np.stack(batch[vector].to_numpy()).astype(np.float64)
                fine = np.isfinite(x).all(axis=1)
                x, own = x[fine], batch[row_id].to_numpy()[fine]
                if not len(x):
                    continue
                scores = np.round(matrix @ x.T, 6)
                if skip_same:
                    scores[ids[:, None] == own[None, :]] = -np.inf
                n = min(k, len(own))
                # All rows as good as the k-th best; ids decide among them later.
                least = np.maximum(np.partition(scores, len(own) - n, axis=1)[:, len(own) - n], -1e300)
                q, at = np.nonzero(scores >= least[:, None])
                yield pd.DataFrame({query_id: ids[q], row_id: own[at], "score": scores[q, at]})

        found = rows.select(row_id, vector).where(f"{row_id} is not null").mapInPandas(search, schema)
        best = found if best is None else best.unionByName(found)
    if best is None:
        return spark.createDataFrame([], schema + ", rank int")
    place = Window.partitionBy(query_id).orderBy(F.desc("score"), row_id)
    # Repeated rows have one rank; they are neighbours, so dropping them needs no further shuffle.
    return best.withColumn("rank", F.dense_rank().over(place)).where(F.col("rank") <= k).dropDuplicates([query_id, row_id, "rank"])
