"""Experiments over a corpus: recovery from scanning noise, dialogues with and without memory,
rerankers side by side, grounded and free answers, and the time each stage of a search takes."""

from __future__ import annotations

import time
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmere.config import Config
from quillmere.functions import text as tx
from quillmere.operators import agent, evaluation, ocr, retrieval
from quillmere.operators import lexicon as lx
from quillmere.operators.completion import Completion, generated
from quillmere.operators.embedding import Encoder
from quillmere.operators.index import TermIndex
from quillmere.session import cut


def ocr_recovery(truth: DataFrame, noisy: DataFrame, lexicon: DataFrame) -> DataFrame:
    """For each stem of both tables (stem, text): term recall, character accuracy and noise of the
    noisy text as it is and after cleaning. A row with a null stem has none; averages come from
    evaluation.mean_metrics(found.withColumnRenamed("stem", "query_id"))."""
    both = truth.where("stem is not null and text is not null").select("stem", F.col("text").alias("truth")).join(noisy.where("text is not null").select("stem", F.col("text").alias("raw")), "stem")
    return recovered(both, lexicon)


def recovered(both: DataFrame, lexicon: DataFrame) -> DataFrame:
    """The measures of ocr_recovery where a row holds both texts, truth and raw; its other columns stay."""
    shared = lexicon.sparkSession.sparkContext.broadcast(lx.matcher(lexicon))

    @F.pandas_udf("struct<n_terms:int,raw:double,cleaned:double>")
    def recall(truth: pd.Series, raw: pd.Series, clean: pd.Series) -> pd.DataFrame:
        rows = []
        for t, *texts in zip(truth, raw, clean, strict=True):
            terms = {word for word, *_ in shared.value.find(t)}
            rows.append((len(terms), *(sum(word in x for word in terms) / max(1, len(terms)) for x in texts)))
        return pd.DataFrame(rows, columns=["n_terms", "raw", "cleaned"])

    kept = [c for c in both.columns if c not in ("truth", "raw")]
    cleaned = ocr.clean(both.where("truth is not null and raw is not null"), "raw", lexicon)
    sides = {"raw": "raw", "cleaned": "clean_text"}
    measured = cleaned.select(
        *kept, recall("truth", "raw", "clean_text").alias("_recall"), *[tx.noise_score(c).alias(f"{side}_noise") for side, c in sides.items()],
        *[F.round(tx.char_accuracy("truth", c), 4).alias(f"{side}_char_accuracy") for side, c in sides.items()],
    )
    of = lambda side: [F.round(F.col("_recall")[side], 4).alias(f"{side}_term_recall"), f"{side}_char_accuracy", f"{side}_noise"]
    return measured.select(*kept, F.col("_recall")["n_terms"].alias("n_terms"), *of("raw"), *of("cleaned"))


def dialogues(asked: DataFrame, chunks: DataFrame, lexicon: DataFrame, config: Config | None = None, encoder: Encoder | None = None, mode: str = "static") -> DataFrame:
    """Dialogues replayed with and without memory: memory, kind, n, hit, error and refusal rates.

    asked: dialogue_id, turn, question, kind (such as direct or anaphora), gold_chunk_ids. All
    dialogues go turn by turn together; with memory a question sees the terms of its dialogue's
    earlier questions and answers. A hit answers with a gold chunk among what was found, an error
    answers without one.
    """
    c = config or Config()
    index = TermIndex.build(chunks)
    given = asked.where("dialogue_id is not null and turn is not null and question is not null").dropDuplicates(["dialogue_id", "turn"])
    numbers = [r["turn"] for r in given.select("turn").distinct().orderBy("turn").limit(101).collect()]
    if len(numbers) > 100:
        raise ValueError("a dialogue of an experiment has at most 100 turns")
    out = None
    for remembers in (False, True):
        told = None
        for n in numbers:
            now = given.where(F.col("turn") == n).select(F.col("dialogue_id").alias("query_id"), F.col("question").alias("text"))
            recent = None
            if remembers and told is not None:
                last = Window.partitionBy("session").orderBy(F.desc("turn"))
                seen = told.withColumn("_r", F.row_number().over(last)).where("_r = 1")
                recent = seen.select(F.col("session").alias("query_id"), "assistant", "user")
            done = agent.answer(now, chunks, lexicon, c, mode, recent, encoder, index)
            done = done.select("query_id", "question", "answer", "refused", "retrieved").withColumns({"_q": lx.entities(lexicon, "question"), "_a": lx.entities(lexicon, "answer")})
            done = cut(done.select(F.col("query_id").alias("session"), F.lit(n).alias("turn"), "refused", "retrieved", lx.by_type(F.col("_a")).alias("assistant"), lx.by_type(F.col("_q")).alias("user")))
            told = done if told is None else told.unionByName(done)
        if told is not None:
            part = told.withColumn("memory", F.lit(remembers))
            out = part if out is None else out.unionByName(part)
    if out is None:
        return asked.sparkSession.createDataFrame([], "memory boolean, kind string, n long, hit double, error double, refusal double")
    joined = out.join(given.select(F.col("dialogue_id").alias("session"), "turn", "kind", "gold_chunk_ids"), ["session", "turn"])
    right = F.coalesce(F.arrays_overlap("retrieved", "gold_chunk_ids"), F.lit(False))
    share = lambda what: F.round(F.avg(what.cast("double")), 4)
    return joined.groupBy("memory", "kind").agg(F.count("*").alias("n"), share(~F.col("refused") & right).alias("hit"), share(~F.col("refused") & ~right).alias("error"), share(F.col("refused")).alias("refusal"))


def compare_rerankers(queries: DataFrame, chunks: DataFrame, lexicon: DataFrame, qrels: DataFrame, rerankers: dict[str, retrieval.Reranker | None], config: Config | None = None, encoder: Encoder | None = None) -> DataFrame:
    """Mean measures of several rerankers over one pool of fused candidates; None is the feature reranker alone."""
    c = config or Config()
    pool = cut(retrieval.candidates(queries, chunks, "hybrid", c, encoder).where(F.col("position") <= max(2 * c.retrieval.rerank_top_k, c.retrieval.dense_top_k)))
    scored = cut(retrieval.feature_rerank(pool, queries, chunks, lexicon))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "position")
    out = None
    for name, model in rerankers.items():
        mine = scored if model is None else retrieval.rerank_with(scored, queries, chunks, model)
        ranked = mine.withColumn("rank", F.row_number().over(best))
        part = evaluation.mean_metrics(evaluation.retrieval_metrics(ranked, qrels)).withColumn("reranker", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def grounded_and_free(answers: DataFrame, model: Completion, lexicon: DataFrame) -> DataFrame:
    """way, n, faithfulness, answered: answers drawn from evidence beside what a model says without it.

    answers: query_id, question, answer, context, refused. A free answer counts as given unless
    the model fails; refused grounded answers aren't judged.
    """
    rows = cut(generated(answers, model))
    free = rows.select("query_id", F.col("free_answer").alias("answer"), "context", F.col("free_answer").isNull().alias("refused"))
    out = None
    for way, part in (("grounded", rows.select("query_id", "answer", "context", "refused")), ("free", free)):
        kept = part.where(~F.col("refused"))
        true = evaluation.faithfulness(kept, lexicon).agg(F.round(F.avg("faithfulness"), 4).alias("faithfulness"))
        one = part.agg(F.count("*").alias("n"), F.round(F.avg((~F.col("refused")).cast("double")), 4).alias("answered")).crossJoin(true).withColumn("way", F.lit(way))
        out = one if out is None else out.unionByName(one)
    return out


def recomputed(rows: DataFrame, by: str = "mode") -> DataFrame:
    """Refusals where they are right and where they aren't, counted from rows of detail (item_type, refused) by a column."""
    asked = F.col("item_type") != "unanswerable"
    said = F.coalesce("refused", F.lit(False))
    counts = rows.groupBy(by).agg(F.count_if(~asked).alias("n_unanswerable"), F.count_if(~asked & said).alias("n_refused"), F.count_if(asked).alias("n_answerable"), F.count_if(asked & said).alias("n_over_refused"))
    return counts.withColumns({"refusal_accuracy": F.round(F.try_divide("n_refused", "n_unanswerable"), 4), "over_refusal": F.round(F.try_divide("n_over_refused", "n_answerable"), 4)})


def deltas(now: DataFrame, before: DataFrame, keys: list[str]) -> DataFrame:
    """Two tables of measures side by side by keys: each measure with what it gained; null unless both are finite."""
    values = [c for c, t in now.dtypes if c not in keys and t in ("double", "float", "int", "bigint") and c in before.columns]
    finite = lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x) < float("inf"))
    joined = now.select(*keys, *values).join(before.select(*keys, *[F.col(c).alias(f"_{c}") for c in values]), keys, "left")
    gained = [F.when(finite(F.col(c)) & finite(F.col(f"_{c}")), F.round(F.col(c) - F.col(f"_{c}"), 4)).alias(f"{c}_delta") for c in values]
    return joined.select(*keys, *values, *gained)


def keyword_counts(df: DataFrame, columns: list[str], keywords: list[str]) -> DataFrame:
    """keyword, n: in how many rows each keyword occurs, the commonest first; keywords that don't occur have none."""
    text = F.concat_ws("\n", *columns)
    found = F.explode(F.filter(F.array(*map(F.lit, dict.fromkeys(keywords))), lambda k: F.contains(text, k)))
    return df.select(found.alias("keyword")).groupBy("keyword").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "keyword")


def timings(queries: DataFrame, chunks: DataFrame, lexicon: DataFrame, config: Config | None = None, encoder: Encoder | None = None, index: TermIndex | None = None) -> DataFrame:
    """stage, ms, ms_per_query of a search of a batch: each channel, fusion, reranking, filter, and all together."""
    c = config or Config()
    n = queries.count()
    rows: list[tuple[str, float]] = []

    def timed(stage: str, make: Callable[[], DataFrame]) -> DataFrame:
        begun = time.perf_counter()
        done = cut(make())
        rows.append((stage, (time.perf_counter() - begun) * 1000))
        return done

    lists = {"dense": timed("dense", lambda: retrieval.dense_top_k(queries, chunks, None, c.retrieval, encoder)), "bm25": timed("bm25", lambda: retrieval.bm25_top_k(queries, chunks, None, c.retrieval, index, lexicon))}
    pool = timed("fusion", lambda: retrieval.fused(lists, chunks, "hybrid", c.retrieval).where(F.col("position") <= c.retrieval.dense_top_k))
    scored = timed("rerank", lambda: retrieval.feature_rerank(pool, queries, chunks, lexicon))
    timed("filter", lambda: retrieval.evidence_filter(scored, chunks, c.retrieval.final_top_k, c.evidence))
    rows.append(("total", sum(ms for _, ms in rows)))
    return queries.sparkSession.createDataFrame([(stage, round(ms, 2), round(ms / max(1, n), 2)) for stage, ms in rows], "stage string, ms double, ms_per_query double")
