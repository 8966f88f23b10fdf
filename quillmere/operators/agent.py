"""Answers with evidence for a batch of questions: query rewriting, bounded search rounds,
confidence signals, the decision to answer or decline, and cited extractive answers."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmere.config import Agent, Config
from quillmere.functions import text as tx
from quillmere.operators import lexicon as lx
from quillmere.operators import memory, nli
from quillmere.operators.embedding import Encoder
from quillmere.operators.index import TermIndex
from quillmere.operators.retrieval import retrieve
from quillmere.session import cut

# What a question is after, by the first group of words it contains.
FOCUS = [
    ("组成 哪些药 什么药 成分 药物组成", "组成 药味"), ("主治 治什么 用于 适应症 治疗哪些", "主治 功用"), ("性味 归经 四气五味", "性味归经"), ("剂量 用量 多少克 怎么煎 用法", "用法用量"),
    ("出处 哪本书 记载 出自 原文", "出处 原文"), ("禁忌 注意 不能吃 慎用 忌用 副作用", "使用注意 禁忌"), ("辨证 证型 怎么治 治法 用什么方 选方", "辨证论治 治法 方药"), ("病因 病机 为什么 怎么回事", "病因病机"),
    ("方解 君臣佐使 为何用", "方解"), ("医案 案例 验案", "医案 初诊 处方"),
]
QUESTION_WORDS = "请问 什么 哪些 如何 怎么 为什么 为何 吗 呢 \\? ？".split()
ANAPHORA = "它 它们 该药 此药 这味药 该方 此方 本方 上方 这个方 那个方 这个 那个 前述 上述 此证 该证 这种 他的 她的".split()
OTHER_FOCUS = {"主治": "功效 应用 适应症", "组成": "药味 方剂组成", "使用注意": "禁忌 慎用 孕妇", "辨证论治": "证型 治法 代表方", "性味归经": "四气五味 归经", "出处": "来源 载于 首见"}
LAST_FOCUS = "中医 治疗 方药"
CONFLICT_WORDS = ("禁忌", "注意")


def focus_terms(question: Column | str) -> Column:
    """What the question is after; an empty text if no word tells."""
    q = F.col(question) if isinstance(question, str) else question
    return F.coalesce(*[F.when(q.rlike("|".join(words.split())), focus) for words, focus in FOCUS], F.when(q.isNotNull(), ""))


def analyze(questions: DataFrame, lexicon: DataFrame, text: str = "text") -> DataFrame:
    """Adds entities, entity_types, focus_terms and query_type."""
    found = questions.withColumn("_e", lx.entities(lexicon, text)).withColumn("focus_terms", focus_terms(text))
    kind = F.split("focus_terms", " ")[0]
    return found.withColumns({"entities": lx.entity_texts(F.col("_e")), "entity_types": lx.by_type(F.col("_e")), "query_type": F.when(kind != "", kind).otherwise("lookup")}).drop("_e")


def initial_query(question: Column | str, focus: Column | str) -> Column:
    """The question without its question words, its parts joined, and what it is after."""
    q = F.col(question) if isinstance(question, str) else question
    f = F.col(focus) if isinstance(focus, str) else focus
    spaced = F.regexp_replace(q, "|".join(QUESTION_WORDS), " ")
    # Latin words keep one space between them; CJK parts are joined.
    one = tx.strip(F.regexp_replace(spaced, tx.SPACE + "+", " "))
    core = F.regexp_replace(one, f"(?<=[{tx.CJK_CORE}，。]) | (?=[{tx.CJK_CORE}，。])", "")
    return tx.strip(F.concat_ws(" ", F.when(core != "", core).otherwise(q), f))


def resolve_anaphora(questions: DataFrame, recent: DataFrame) -> DataFrame:
    """Adds resolved (the question with up to three known terms of the talk) and added.

    questions: query_id, text, entities. recent: query_id, assistant and user, maps of kind to
    terms of the latest turns. Only a question that points back, or names nothing, is completed:
    conclusions of the assistant come first, then what the user talks about, then symptoms.
    """
    joined = questions.join(recent, "query_id", "left")
    empty = F.array().cast("array<string>")
    two = lambda who, kind: F.slice(F.coalesce(F.col(who)[kind], empty), 1, 2)
    order = [("assistant", k) for k in ("formula", "pattern", "disease")] + [("user", k) for k in ("formula", "herb", "pattern", "disease")] + [("assistant", "symptom"), ("user", "symptom"), ("user", "western_disease")]
    terms = F.array_distinct(F.filter(F.concat(*[two(w, k) for w, k in order]), lambda t: ~F.contains(F.col("text"), t)))
    points = F.col("text").rlike("|".join(ANAPHORA)) | (F.size("entities") == 0)
    added = F.when(points & (F.col("assistant").isNotNull() | F.col("user").isNotNull()), F.slice(terms, 1, 3)).otherwise(empty)
    return joined.withColumn("added", added).withColumn("resolved", F.when(F.size("added") > 0, F.concat_ws(" ", "text", F.array_join("added", " "))).otherwise(F.col("text"))).drop("assistant", "user")


def refined_query(question: str, missing: str, focus: str, history: str) -> Column:
    """Keywords, missing terms and focus, each once; if that was asked before, another focus is added."""
    keywords = F.slice(F.filter(tx.tokens(question), lambda t: F.length(t) >= 2), 1, 6)
    parts = F.array_distinct(F.concat(keywords, F.col(missing), F.filter(F.split(focus, " "), lambda x: x != "")))
    wanted = F.array_join(parts, " ")
    other = F.coalesce(F.create_map(*[F.lit(x) for pair in OTHER_FOCUS.items() for x in pair])[F.split(focus, " ")[0]], F.lit(LAST_FOCUS))
    return tx.strip(F.when(F.array_contains(F.col(history), wanted), F.concat_ws(" ", wanted, other)).otherwise(wanted))


def conflict_query(entities: str, focus: str) -> Column:
    return F.array_join(F.array_distinct(F.concat(F.col(entities), F.filter(F.split(focus, " "), lambda x: x != ""), F.array(*map(F.lit, CONFLICT_WORDS)))), " ")


def merge_pools(*pools: DataFrame) -> DataFrame:
    """The best score of each query and chunk over search rounds: query_id, chunk_id, score."""
    all_ = None
    for p in pools:
        p = p.select("query_id", "chunk_id", "score")
        all_ = p if all_ is None else all_.unionByName(p)
    return all_.groupBy("query_id", "chunk_id").agg(F.max("score").alias("score"))


def top_evidence(pool: DataFrame, chunks: DataFrame, k: int = 5) -> DataFrame:
    """The k best chunks of each query's pool with their text, place and noise."""
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    ranked = pool.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k)
    return ranked.join(chunks.select("chunk_id", "doc_id", "seq", "text", "source_type", F.coalesce("ocr_noise", F.lit(0.0)).alias("ocr_noise")), "chunk_id")


def signals(questions: DataFrame, pool: DataFrame, chunks: DataFrame, lexicon: DataFrame) -> DataFrame:
    """coverage, token_overlap, bigram_coverage, relevance, top_score, consistency, confidence and
    the terms covered and missing, for every question; all 0 (consistency 1) without evidence.

    questions: query_id, text, entities. At most five chunks of a question are gathered.
    """
    top = top_evidence(pool, chunks)
    claims = F.slice(tx.evidence_sentences("text"), 1, 2)
    gathered = top.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("place", "score", "text", F.when(F.col("place") <= 4, claims).otherwise(F.array().cast("array<string>")).alias("claims")))).alias("_top"))
    sizes = pool.groupBy("query_id").agg(F.count("*").alias("n_evidence"))
    j = questions.select("query_id", "text", "entities").join(gathered, "query_id", "left").join(sizes, "query_id", "left").fillna(0, ["n_evidence"])
    j = j.withColumn("_ev", F.coalesce(F.array_join(F.transform("_top", lambda e: e["text"]), " "), F.lit("")))
    j = j.withColumn("covered", F.array_sort(F.filter("entities", lambda t: F.contains(F.col("_ev"), t))))
    j = j.withColumn("missing", F.array_sort(F.array_except("entities", "covered")))
    words = F.array_distinct(F.filter(tx.tokens("text"), lambda t: F.length(t) >= 2))
    j = j.withColumn("_c", F.when(F.size("entities") > 0, F.size("covered") / F.size("entities")).otherwise(0.0)).withColumn("_t", tx.coverage(words, tx.tokens("_ev"))).withColumn("_b", tx.coverage(tx.bigrams("text"), tx.bigrams("_ev")))
    some = F.col("n_evidence") > 0
    j = j.withColumn("_r", F.when(~some, 0.0).when(F.size("entities") > 0, 0.5 * F.col("_c") + 0.25 * F.col("_t") + 0.25 * F.col("_b")).otherwise(F.greatest("_t", "_b")))
    j = j.withColumn("_s", F.coalesce(F.col("_top")[0]["score"], F.lit(0.0))).withColumn("_k", nli.consistency(lexicon, F.coalesce(F.flatten(F.transform("_top", lambda e: e["claims"])), F.array().cast("array<string>"))))
    confidence = (0.65 * F.col("_r") + 0.35 * F.col("_s")) * (0.7 + 0.3 * F.col("_k")["score"])
    r4 = lambda c: F.round(F.when(some, c).otherwise(0.0), 4)
    return j.select(
        "query_id", r4(F.col("_c")).alias("coverage"), r4(F.col("_t")).alias("token_overlap"), r4(F.col("_b")).alias("bigram_coverage"), r4(F.col("_r")).alias("relevance"), F.round("_s", 4).alias("top_score"),
        F.round(F.col("_k")["score"], 4).alias("consistency"), F.col("_k")["reasons"].alias("conflicts"), F.round(confidence, 4).alias("confidence"), "covered", "missing", "n_evidence",
    )


def decision(round_: int, a: Agent, confidence: str = "confidence", consistency: str = "consistency", conflicts: str = "conflicts") -> Column:
    """finish, resolve_conflict, refine_search or refuse, after a round of search."""
    more = F.lit(round_ < a.max_rounds)
    return (
        F.when((F.col(confidence) >= a.answer_threshold) & (F.col(consistency) >= a.consistency_threshold), "finish")
        .when((F.size(conflicts) > 0) & more, "resolve_conflict").when(more & (F.col(confidence) < a.answer_threshold), "refine_search")
        .when(F.col(confidence) < a.refusal_threshold, "refuse").otherwise("finish")
    )


def compose(questions: DataFrame, evidence: DataFrame, lexicon: DataFrame, a: Agent | None = None) -> DataFrame:
    """query_id, answer, claims, citations: the best sentences of each question's evidence,
    grouped by chunk in the order of the evidence and marked with its number.

    A sentence counts by the terms and tokens it shares with the question, weighted by its
    chunk's score and noise; equal beginnings count once; at most max_claims sentences and
    max_answer_chars characters are used, and the chunk that overflows ends the answer.
    """
    a = a or Agent()
    q = questions.select("query_id", F.col("text").alias("_q"), "entities").withColumn("_qt", F.array_distinct(tx.tokens("_q")))
    sentences = evidence.select("query_id", "chunk_id", "place", "score", "ocr_noise", F.posexplode(tx.evidence_sentences("text")).alias("at", "sentence"))
    sentences = sentences.withColumn("_se", lx.entity_texts(lx.entities(lexicon, "sentence"))).join(q, "query_id")
    shared = F.when(F.size("entities") > 0, F.size(F.array_intersect("entities", "_se")) / F.size("entities")).otherwise(0.0)
    value = (0.55 * shared + 0.45 * tx.coverage(F.col("_qt"), tx.tokens("sentence"))) * (0.5 + 0.5 * F.col("score")) * (1 - F.least(F.col("ocr_noise"), F.lit(0.2)))
    order = [F.desc("value"), "place", "at"]
    first = Window.partitionBy("query_id", F.substring(tx.squeeze("sentence"), 1, 40)).orderBy(*order)
    best = Window.partitionBy("query_id").orderBy(*order)
    kept = sentences.withColumn("value", F.round(value, 8)).withColumn("_f", F.row_number().over(first)).where("_f = 1").withColumn("claim", F.row_number().over(best)).where(F.col("claim") <= a.max_claims)
    blocks = kept.groupBy("query_id", "chunk_id", "place").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("claim", "sentence"))), lambda x: x["sentence"]), "").alias("block"), F.min(F.struct("claim", "sentence"))["sentence"].alias("quote")
    )
    by_place = Window.partitionBy("query_id").orderBy("place")
    blocks = blocks.withColumn("mark", F.row_number().over(by_place)).withColumn("upto", F.sum(F.length("block")).over(by_place))
    # The running sum only grows, so the first block beyond the limit and all later ones fall out.
    fits = F.col("upto") <= a.max_answer_chars
    before = F.coalesce(F.lag("upto").over(by_place), F.lit(0)) <= a.max_answer_chars
    blocks = blocks.withColumn("fits", fits).withColumn("cited", before)
    answers = blocks.groupBy("query_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("fits"), F.struct("place", F.concat(F.format_string("〔%d〕", "mark"), "block").alias("line"))))), lambda x: x["line"]), "\n").alias("body"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("cited"), F.struct("place", "chunk_id")))), lambda x: x["chunk_id"]).alias("citations"),
        F.map_from_entries(F.collect_list(F.struct("chunk_id", "quote"))).alias("quotes"),
    )
    tops = kept.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("claim", "sentence"))), lambda x: x["sentence"]).alias("claims"))
    lead = F.regexp_replace(F.col("claims")[0], "[。；]+$", "")
    answer = F.when(F.startswith("body", F.substring(lead, 1, 10)), F.col("body")).otherwise(F.concat(F.lit("根据检索到的证据："), lead, F.lit("。\n\n"), F.col("body")))
    return answers.join(tops, "query_id").select("query_id", answer.alias("answer"), "claims", "citations", "quotes")


def answer(questions: DataFrame, chunks: DataFrame, lexicon: DataFrame, config: Config | None = None, mode: str = "react", recent: DataFrame | None = None, encoder: Encoder | None = None, index: TermIndex | None = None) -> DataFrame:
    """One row for each question (query_id, text): answer, refused, citations, signals, rounds_used, trace.

    A first search is followed by at most max_rounds - 1 more, each only for the questions whose
    signals ask for one; mode static answers after the first. The passes are unrolled and each
    ends with a checkpoint, so plans stay small and work survives lost executors.
    """
    c = config or Config()
    # All rounds search the same index.
    index = index or TermIndex.build(chunks)
    asked = questions.select("query_id", "text").where("query_id is not null and text is not null").dropDuplicates(["query_id"])
    if recent is not None:
        asked = resolve_anaphora(analyze(asked, lexicon).select("query_id", "text", "entities"), recent).select("query_id", F.col("resolved").alias("text"), F.col("text").alias("asked"))
    else:
        asked = asked.withColumn("asked", F.col("text"))
    state = cut(analyze(asked, lexicon).select("query_id", "text", "asked", "entities", "focus_terms", "query_type").withColumn("query", initial_query("text", "focus_terms")))
    search = lambda df: retrieve(df.select("query_id", F.col("query").alias("text")), chunks, lexicon, "full", None, c, encoder, index).select("query_id", "chunk_id", "score")
    pool = cut(search(state))
    now = cut(signals(state, pool, chunks, lexicon))
    state = state.withColumn("history", F.array("query")).withColumn("rounds_used", F.lit(1)).withColumn("action", F.lit("search"))
    trace = state.join(now, "query_id").select("query_id", F.struct(F.lit(0).alias("round"), F.lit("search").alias("action"), "query", "confidence", "consistency", "coverage").alias("step"))
    done = state.join(now, "query_id")
    if mode != "static":
        for r in range(1, c.agent.max_rounds):
            told = state.join(now, "query_id").withColumn("action", decision(r, c.agent))
            going = told.where("action in ('resolve_conflict', 'refine_search')")
            going = going.withColumn("query", F.when(F.col("action") == "resolve_conflict", conflict_query("entities", "focus_terms")).otherwise(refined_query("text", "missing", "focus_terms", "history")))
            going = cut(going.select(*state.columns).withColumn("history", F.concat("history", F.array("query"))).withColumn("rounds_used", F.lit(r + 1)))
            pool = cut(merge_pools(pool, search(going)))
            fresh = cut(signals(going, pool.join(going.select("query_id"), "query_id", "left_semi"), chunks, lexicon))
            now = now.join(fresh.select("query_id"), "query_id", "left_anti").unionByName(fresh)
            state = state.join(going.select("query_id"), "query_id", "left_anti").unionByName(going)
            trace = trace.unionByName(going.join(fresh, "query_id").select("query_id", F.struct(F.lit(r).alias("round"), "action", "query", "confidence", "consistency", "coverage").alias("step")))
            state, now = cut(state), cut(now)
        done = state.join(now, "query_id")
        done = done.withColumn("refused", (decision(c.agent.max_rounds, c.agent) == "refuse") | (F.col("confidence") < c.agent.refusal_threshold))
    else:
        done = done.withColumn("refused", F.lit(False))
    evidence = cut(top_evidence(pool, chunks, c.retrieval.final_top_k))
    made = compose(done.where("not refused").select("query_id", F.col("asked").alias("text"), "entities"), evidence, lexicon, c.agent)
    low = F.when(~F.col("refused") & (F.col("confidence") < c.agent.answer_threshold), F.lit(True)).otherwise(False)
    steps = trace.groupBy("query_id").agg(F.array_sort(F.collect_list("step")).alias("trace"))
    shown = F.struct("place", "chunk_id", "doc_id", F.substring("text", 1, 400).alias("text"), F.round("score", 4).alias("score"))
    ids = evidence.groupBy("query_id").agg(F.array_sort(F.collect_list(shown)).alias("_shown")).withColumn("retrieved", F.transform("_shown", lambda x: x["chunk_id"]))
    return (
        done.join(made, "query_id", "left").withColumn("quotes", F.coalesce("quotes", F.create_map().cast("map<string,string>"))).join(steps, "query_id", "left").join(ids, "query_id", "left")
        .select("query_id", F.col("asked").alias("question"), F.when(F.col("refused"), F.lit("抱歉，现有语料中未能检索到足以可靠回答该问题的证据。")).otherwise(F.coalesce("answer", F.lit(""))).alias("answer"), "refused", low.alias("low_confidence"),
                F.coalesce("citations", F.array().cast("array<string>")).alias("citations"), F.coalesce("claims", F.array().cast("array<string>")).alias("claims"), F.coalesce("retrieved", F.array().cast("array<string>")).alias("retrieved"),
                F.coalesce(F.transform("_shown", lambda x: F.struct(x["chunk_id"].alias("chunk_id"), x["doc_id"].alias("doc_id"), x["text"].alias("text"), x["score"].alias("score"), F.col("quotes")[x["chunk_id"]].alias("quote"))), F.array()).alias("evidence"),
                "confidence", "consistency", "coverage", "relevance", "rounds_used", "trace")
    )


def best_quote(query: str, text: str) -> Column:
    """The sentence of a text that shares most tokens with a query; the first of equals."""
    asked = F.array_distinct(tx.tokens(query))
    scored = F.transform(tx.evidence_sentences(text), lambda s, i: F.struct(F.size(F.array_intersect(asked, tx.tokens(s))).alias("n"), (-i).alias("i"), s.alias("s")))
    return F.array_max(scored)["s"]


def fallback(done: DataFrame, generate) -> DataFrame:
    """Adds general_answer of refused questions from a callable on lists of questions, where one is given."""

    @F.pandas_udf("string")
    def general(q: pd.Series) -> pd.Series:
        return pd.Series(generate(list(q)))

    return done.withColumn("general_answer", F.when(F.col("refused"), general("question")))


def memory_effect(turns: DataFrame, lexicon: DataFrame) -> DataFrame:
    """What memory adds to follow-up questions: kind (points_back, names_nothing, direct), n,
    completed (share that gets terms of the talk) and hit (share whose terms, with memory, are
    among those of the next assistant turn) beside hit_without.

    turns: session, turn, role, text, entities. Each user turn sees only turns before it.
    """
    order = Window.partitionBy("session").orderBy("turn")
    before, empty = order.rowsBetween(Window.unboundedPreceding, -1), F.array().cast("array<string>")
    told = memory.latest_turns(turns)
    last = lambda role: F.last(F.when(F.col("role") == role, F.col("entities")), ignorenulls=True).over(before)
    told = told.withColumns({"assistant": last("assistant"), "user": last("user"), "next_role": F.lead("role").over(order), "next_terms": F.lead("entities").over(order)})
    asked = told.where("role = 'user' and next_role = 'assistant' and text is not null").withColumn("query_id", F.concat_ws("#", "session", "turn"))
    asked = asked.withColumn("entities", lx.entity_texts(lx.entities(lexicon, "text"))).withColumn("answered", F.coalesce(F.flatten(F.map_values("next_terms")), empty))
    done = resolve_anaphora(asked.select("query_id", "text", "entities", "answered"), asked.select("query_id", "assistant", "user"))
    kind = F.when(F.col("text").rlike("|".join(ANAPHORA)), "points_back").when(F.size("entities") == 0, "names_nothing").otherwise("direct")
    share = lambda terms: F.round(F.avg(F.arrays_overlap(terms, F.col("answered")).cast("double")), 4)
    return done.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"), F.round(F.avg((F.size("added") > 0).cast("double")), 4).alias("completed"), share(F.concat("entities", "added")).alias("hit"), share(F.col("entities")).alias("hit_without"))
