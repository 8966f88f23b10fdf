"""Sparse, dense and fused retrieval of chunks for a batch of queries, reranking and filtering.

queries: query_id, text. chunks: chunk_id, text and, for reranking, source_type and ocr_noise.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmere.config import Config, EvidenceFilter, Retrieval
from quillmere.functions import text as tx
from quillmere.operators import lexicon as lx
from quillmere.operators.embedding import Encoder, create_encoder, encode, top_k
from quillmere.operators.index import TermIndex, words_of
from quillmere.session import cut

MODES = ("dense", "bm25", "hybrid", "hybrid_rerank", "full")

# How far a source is trusted, and the order of sources among equals.
SOURCE_PRIOR = {"textbook": 1.0, "classic": 0.95, "case": 0.9, "qa": 0.8, "pdf": 0.85, "pdf_scan": 0.75, "ocr_scan": 0.7}
SOURCE_RANK = {"textbook": 0, "classic": 1, "case": 2, "pdf": 3, "qa": 4, "pdf_scan": 5, "ocr_scan": 6}
# Weights of the reranker's features.
WEIGHTS = {"dense": 0.30, "bm25": 0.15, "rrf": 0.10, "entity_overlap": 0.25, "clean": 0.12, "source_prior": 0.08}


def _map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def term_statistics(chunks: DataFrame, r: Retrieval | None = None) -> DataFrame:
    """term, df, idf. A term in more than half of the chunks gets a small share of the mean."""
    return TermIndex.build(chunks).weights((r or Retrieval()).epsilon)


def bm25_top_k(queries: DataFrame, chunks: DataFrame, k: int | None = None, r: Retrieval | None = None, index: TermIndex | None = None, lexicon: DataFrame | None = None) -> DataFrame:
    """query_id, chunk_id, score, rank of the best chunks with a positive score.

    With an index only its postings of query terms are read; without one it is made of the
    chunks. Query terms are sent to all tasks as long as the query set is a block. Repeated query
    terms count each time. Ties rank by id. lexicon: for an index that keeps its terms whole.
    """
    r = r or Retrieval()
    ix = index or TermIndex.build(chunks)
    words = words_of(queries.where("query_id is not null"), "text", lexicon if ix.whole_terms else None)
    asked = words.select("query_id", F.explode("words").alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))
    few = queries.limit(r.query_block + 1).count() <= r.query_block
    near = F.broadcast if few else (lambda df: df)
    if few:
        # The terms of a block of queries, a bounded set, are found once.
        asked = cut(asked)
    terms = asked.select("term").distinct()
    idf = ix.weights(r.epsilon).join(near(terms), "term", "left_semi")
    average = ix.sizes.select((F.col("total") / F.col("n_chunks")).alias("avgdl"))
    weight = F.col("times") * F.col("idf") * F.col("tf") * (r.k1 + 1) / (F.col("tf") + r.k1 * (1 - r.b + r.b * F.col("length") / F.col("avgdl")))
    scored = (
        ix.of(near(terms)).join(near(asked.join(near(idf), "term")), "term").join(F.broadcast(average))
        .groupBy("query_id", "chunk_id").agg(F.round(F.sum(weight), 6).alias("score")).where("score > 0")
    )
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= (k or r.bm25_top_k))


def dense_top_k(queries: DataFrame, chunks: DataFrame, k: int | None = None, r: Retrieval | None = None, encoder: Encoder | None = None) -> DataFrame:
    """query_id, chunk_id, score, rank by inner product; chunks may bring their embedding."""
    r = r or Retrieval()
    e = create_encoder(encoder, r.embedding_dim)
    q = encode(queries, "text", e, is_query=True).select("query_id", "embedding")
    c = chunks if "embedding" in chunks.columns else encode(chunks, "text", e)
    return top_k(q, c.select("chunk_id", "embedding"), k or r.dense_top_k, block=r.query_block)


def fuse(channels: dict[str, DataFrame], rrf_k: int = 60) -> DataFrame:
    """query_id, chunk_id, rrf: the sum over channels of 1 / (rrf_k + rank)."""
    all_ = None
    for ranked in channels.values():
        part = ranked.select("query_id", "chunk_id", (1.0 / (rrf_k + F.col("rank"))).alias("part"))
        all_ = part if all_ is None else all_.unionByName(part)
    return all_.groupBy("query_id", "chunk_id").agg(F.sum("part").alias("rrf"))


def candidates(queries: DataFrame, chunks: DataFrame, mode: str = "hybrid", config: Config | None = None, encoder: Encoder | None = None, index: TermIndex | None = None, lexicon: DataFrame | None = None) -> DataFrame:
    """query_id, chunk_id, dense, bm25_norm, rrf, rrf_norm, position: fused candidates in order.

    Scores are absolute: BM25 saturates as s / (s + 10), fusion is divided by the best it can be.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    r = (config or Config()).retrieval
    channels = {"dense": lambda: dense_top_k(queries, chunks, None, r, encoder), "bm25": lambda: bm25_top_k(queries, chunks, None, r, index, lexicon)}
    use = {name: make() for name, make in channels.items() if mode not in ("dense", "bm25") or mode == name}
    return fused(use, chunks, mode, r)


def fused(use: dict[str, DataFrame], chunks: DataFrame, mode: str, r: Retrieval) -> DataFrame:
    """The candidates of a mode from the ranked lists of its channels."""
    use = {name: ranked for name, ranked in use.items() if mode not in ("dense", "bm25") or mode == name}
    columns = {"dense": F.col("score").alias("dense"), "bm25": (F.col("score") / (F.col("score") + 10.0)).alias("bm25_norm")}
    both = None
    for name, ranked in use.items():
        part = ranked.select("query_id", "chunk_id", columns[name], F.col("rank").alias(f"{name}_rank"))
        both = part if both is None else both.join(part, ["query_id", "chunk_id"], "full")
    for name in ("dense", "bm25"):
        if name not in use:
            both = both.withColumn(f"{name}_rank", F.lit(None).cast("int")).withColumn({"dense": "dense", "bm25": "bm25_norm"}[name], F.lit(0.0))
    both = both.fillna(0.0, ["dense", "bm25_norm"])
    part = lambda c: F.coalesce(1.0 / (r.rrf_k + F.col(c)), F.lit(0.0))
    total = {"dense": F.col("dense"), "bm25": F.col("bm25_norm")}.get(mode, part("dense_rank") + part("bm25_rank"))
    top = 1.0 if mode in ("dense", "bm25") else 2.0 / (r.rrf_k + 1)
    order = Window.partitionBy("query_id").orderBy(F.desc("rrf"), F.asc_nulls_last("dense_rank"), F.asc_nulls_last("bm25_rank"), "chunk_id")
    return (
        both.withColumn("rrf", F.round(total, 10)).withColumn("rrf_norm", F.round(F.least(F.lit(1.0), F.col("rrf") / top), 6))
        .join(chunks.select("chunk_id"), "chunk_id", "left_semi")
        .withColumn("position", F.row_number().over(order))
        .select("query_id", "chunk_id", "dense", F.round("bm25_norm", 6).alias("bm25_norm"), "rrf", "rrf_norm", "position")
    )


def feature_rerank(found: DataFrame, queries: DataFrame, chunks: DataFrame, lexicon: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """Adds entity_overlap and score (a weighted sum of features, rounded to 4) to candidates.

    Terms are looked for only in texts that are candidates, each once.
    """
    w = {**WEIGHTS, **(weights or {})}
    q = queries.select("query_id", F.col("text").alias("_qt")).withColumn("_qe", lx.entity_texts(lx.entities(lexicon, "_qt")))
    texts = chunks.join(found.select("chunk_id").distinct(), "chunk_id", "left_semi").select("chunk_id", F.col("text").alias("_ct"), F.coalesce("ocr_noise", F.lit(0.0)).alias("_noise"), F.col("source_type").alias("_st"))
    texts = texts.withColumn("_ce", lx.entity_texts(lx.entities(lexicon, "_ct"))).withColumn("_cb", tx.bigrams("_ct"))
    joined = found.join(q, "query_id").join(texts, "chunk_id")
    overlap = F.when(F.size("_qe") > 0, F.size(F.array_intersect("_qe", "_ce")) / F.size("_qe")).otherwise(tx.coverage(tx.bigrams("_qt"), F.col("_cb")))
    unit = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(c)))
    score = (
        w["dense"] * unit("dense") + w["bm25"] * unit("bm25_norm") + w["rrf"] * unit("rrf_norm") + w["entity_overlap"] * F.col("entity_overlap")
        + w["clean"] * F.greatest(F.lit(0.0), 1 - 4 * F.col("_noise")) + w["source_prior"] * F.coalesce(_map(SOURCE_PRIOR)[F.col("_st")], F.lit(0.8))
    )
    return joined.withColumn("entity_overlap", overlap).withColumn("score", F.round(score, 4)).drop("_qt", "_qe", "_ct", "_ce", "_cb", "_noise", "_st")


def static_reason(score: Column, noise: Column, text: Column, f: EvidenceFilter) -> Column:
    """Why an evidence falls out whatever the others are; null if it doesn't. The order is part of the meaning."""
    return (
        F.when(F.length(tx.squeeze(text)) < f.min_chars, "too_short").when(noise > f.ocr_noise_max, "ocr_noise").when(score < f.min_rel_score, "low_relevance")
    )


def evidence_filter(scored: DataFrame, chunks: DataFrame, limit: int, f: EvidenceFilter | None = None) -> DataFrame:
    """Adds status (kept, dropped, unseen), drop_reason and kept_rank to scored candidates.

    Candidates are taken in the order of score, noise and source; one that is too like an
    already kept one falls out, and the walk ends when limit are kept. A query has no more
    candidates than the pools of its channels, so a group is small whatever the data.
    """
    f = f or EvidenceFilter()
    texts = chunks.join(scored.select("chunk_id").distinct(), "chunk_id", "left_semi").select("chunk_id", F.col("text").alias("_t"), F.coalesce("ocr_noise", F.lit(0.0)).alias("_n"), F.col("source_type").alias("_s"))
    ready = scored.join(texts, "chunk_id").withColumn("_why", static_reason(F.col("score"), F.col("_n"), F.col("_t"), f)).withColumn("_rank", F.coalesce(_map(SOURCE_RANK)[F.col("_s")], F.lit(9)))

    columns = [*scored.columns, "status", "drop_reason", "kept_rank"]

    def walk(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["score", "_n", "_rank", "chunk_id"], ascending=[False, True, True, True]).reset_index(drop=True)
        pairs = [frozenset(zip(s, s[1:], strict=False)) for s in ("".join((t or "").split()) for t in group["_t"])]
        why = list(group["_why"]) if f.enabled else [None] * len(group)
        kept: list[int] = []
        for k in range(len(group)):
            if len(kept) == limit:
                break
            if f.enabled and why[k] is None:
                like = (j for j in kept if len(pairs[k] & pairs[j]) > f.dedup_jaccard * len(pairs[k] | pairs[j]))
                why[k] = next((f"duplicate_of({group['chunk_id'][j]})" for j in like), None)
            if why[k] is None:
                kept.append(k)
        place = {j: n + 1 for n, j in enumerate(kept)}
        # All before the last one looked at are kept or dropped; the walk didn't see the rest.
        seen = kept[-1] + 1 if len(kept) == limit else len(group)
        status = ["kept" if j in place else "dropped" if j < seen else "unseen" for j in range(len(group))]
        return group.assign(status=status, drop_reason=[why[j] if status[j] == "dropped" else None for j in range(len(group))], kept_rank=pd.array([place.get(j) for j in range(len(group))], "Int32"))[columns]

    fields = ", ".join(f"`{n}` {t}" for n, t in scored.dtypes)
    return ready.groupBy("query_id").applyInPandas(walk, fields + ", status string, drop_reason string, kept_rank int")


def retrieve(queries: DataFrame, chunks: DataFrame, lexicon: DataFrame | None = None, mode: str = "full", top: int | None = None, config: Config | None = None, encoder: Encoder | None = None, index: TermIndex | None = None) -> DataFrame:
    """The retrieval of a batch of queries: query_id, chunk_id, rank, score and the channel scores.

    Modes: dense, bm25, hybrid (fused), hybrid_rerank, full (reranked and filtered). A top of 0
    or None is the default. chunks is used for several branches; pass a stored table.
    """
    c = config or Config()
    if mode in ("hybrid_rerank", "full") and lexicon is None:
        raise ValueError("reranking needs a lexicon")
    found = candidates(queries, chunks, mode, c, encoder, index, lexicon)
    return _ranked(found, queries, chunks, lexicon, mode, top, c)


def retrieve_modes(queries: DataFrame, chunks: DataFrame, lexicon: DataFrame, modes: tuple[str, ...] = MODES, top: int | None = None, config: Config | None = None, encoder: Encoder | None = None, index: TermIndex | None = None) -> DataFrame:
    """retrieve() for several modes, each row with its mode: both channels are searched once."""
    c = config or Config()
    lists = {"dense": cut(dense_top_k(queries, chunks, None, c.retrieval, encoder)), "bm25": cut(bm25_top_k(queries, chunks, None, c.retrieval, index, lexicon))}
    out = None
    for mode in modes:
        part = _ranked(fused(lists, chunks, mode, c.retrieval), queries, chunks, lexicon, mode, top, c).withColumn("mode", F.lit(mode))
        out = part if out is None else out.unionByName(part)
    return out


def _ranked(found: DataFrame, queries: DataFrame, chunks: DataFrame, lexicon: DataFrame | None, mode: str, top: int | None, c: Config) -> DataFrame:
    top = top or c.retrieval.final_top_k
    if mode in ("hybrid_rerank", "full"):
        # Cut once: the texts of the pool are looked up by the reranker and by the filter.
        pool = cut(found.where(F.col("position") <= max(2 * c.retrieval.rerank_top_k, c.retrieval.dense_top_k)))
        found = feature_rerank(pool, queries, chunks, lexicon)
    else:
        found = found.withColumn("entity_overlap", F.lit(None).cast("double")).withColumn("score", F.col("rrf_norm"))
    if mode == "full":
        found = evidence_filter(cut(found), chunks, max(top, c.retrieval.final_top_k), c.evidence).where("status = 'kept'").withColumnRenamed("kept_rank", "rank").drop("status", "drop_reason")
    else:
        best = Window.partitionBy("query_id").orderBy(F.desc("score"), "position")
        found = found.withColumn("rank", F.row_number().over(best))
    return found.where(F.col("rank") <= top).select("query_id", "chunk_id", "rank", "score", "dense", "bm25_norm", "rrf", "rrf_norm", "entity_overlap")


class Reranker:
    """What a model-backed reranker implements: scores of (query, text) pairs in batches.

    rerank_with() runs it on Arrow batches; where it raises, the feature score stays.
    """

    def scores(self, queries: list[str], texts: list[str]) -> list[float]:
        raise NotImplementedError


def rerank_with(scored: DataFrame, queries: DataFrame, chunks: DataFrame, model: Reranker, share: float = 0.7, chars: int = 1024) -> DataFrame:
    """Mixes a model's score (as a probability) with the feature score. Where the model fails, or
    gives no finite score, for any chunk of a query, the feature scores of that query stay."""

    @F.pandas_udf("double")
    def told(q: pd.Series, t: pd.Series) -> pd.Series:
        try:
            raw = model.scores(list(q), [(x or "")[:chars] for x in t])
        except Exception:  # noqa: BLE001 - any failure of a remote model leaves the feature score
            return pd.Series([float("nan")] * len(q))
        return pd.Series([*raw, *[float("nan")] * len(q)][: len(q)], dtype="float64")

    both = scored.join(queries.select("query_id", F.col("text").alias("_q")), "query_id").join(chunks.select("chunk_id", F.col("text").alias("_t")), "chunk_id")
    both = cut(both.withColumn("_m", told("_q", "_t")).drop("_q", "_t"))
    whole = F.min((F.col("_m").isNotNull() & ~F.isnan("_m")).cast("int")).over(Window.partitionBy("query_id")) == 1
    mixed = F.round(share / (1 + F.exp(-F.col("_m"))) + (1 - share) * F.col("score"), 4)
    return both.withColumn("_all", whole).withColumn("score", F.when(F.col("_all"), mixed).otherwise(F.col("score"))).drop("_m", "_all")


class RemoteReranker(Reranker):
    """A reranker behind a callable post(query, texts) -> scores from 0 to 1, such as an HTTP call."""

    def __init__(self, post, chars: int = 1500):
        self.post, self.chars = post, chars

    def scores(self, queries: list[str], texts: list[str]) -> list[float]:
        out = [0.0] * len(queries)
        for query in dict.fromkeys(queries):
            places = [k for k, q in enumerate(queries) if q == query]
            answer = self.post(query, [texts[k][: self.chars] for k in places])
            for k, p in zip(places, answer, strict=False):
                p = min(max(float(p), 1e-6), 1 - 1e-6)
                out[k] = math.log(p / (1 - p))
        return out


def create_reranker(kind: str = "feature", model=None) -> Reranker | None:
    """The reranker of a kind: None for features alone, a model with scores(), or a remote callable."""
    if kind == "feature" or model is None:
        return None
    if kind not in ("model", "remote"):
        raise ValueError("a reranker is feature, model or remote")
    return RemoteReranker(model) if kind == "remote" else model
