import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmere.config import Chunking, EvidenceFilter, LongTerm, ShortTerm
from quillmere.operators import agent, chunking, embedding, evaluation, memory, nli, ocr, retrieval, sampling, store
from quillmere.functions.text import python_tokens, python_truncate
from quillmere.operators import lexicon as lx
from quillmere.operators.index import TermIndex


def brute_entities(text, terms):
    out, i = [], 0
    while i < len(text):
        hit = max((t for t in terms if text.startswith(t, i)), key=len, default=None)
        if hit:
            out.append(hit)
            i += len(hit)
        else:
            i += 1
    return out


def test_longest_match_equals_brute_force(spark, lexicon):
    terms = {r["term"]: r["type"] for r in lx.unique_terms(lexicon).collect()}
    assert terms["感冒"] == "disease" and "脉" not in terms
    m = lx.Matcher(terms)
    rng = random.Random(1)
    for _ in range(300):
        text = "".join(rng.choice("黄芪汤甘草发热x感冒气虚证") for _ in range(rng.randint(0, 14)))
        assert [w for w, *_ in m.find(text)] == brute_entities(text, terms)
    got = spark.createDataFrame([("黄芪汤治感冒",), (None,), ("",)], "t string").withColumn("e", lx.entities(lexicon, "t")).select(lx.by_type(F.col("e")).alias("m"), lx.importance(F.col("e")).alias("i")).collect()
    assert got[0]["m"] == {"formula": ["黄芪汤"], "disease": ["感冒"]} and got[1]["m"] is None and got[2]["i"] == 0.15
    assert got[0]["i"] == round(0.15 + 0.85 * (1 - math.exp(-1.85 / 2)), 4)


def test_ocr_repairs_by_lexicon_and_static_list(spark, lexicon):
    docs = spark.createDataFrame([("a", "黄芪 与桂挂，甘革□调和"), ("b", ""), ("c", None)], "doc_id string, text string")
    got = {r["doc_id"]: r for r in ocr.clean(docs, "text", lexicon).collect()}
    assert "甘草" in got["a"]["clean_text"] and got["a"]["n_fixes"] >= 1 and got["a"]["n_garbage"] == 1
    assert got["a"]["noise_after"] <= got["a"]["noise_before"]
    assert got["b"]["clean_text"] == "" and got["c"]["clean_text"] is None
    off = ocr.clean(docs, "text", None, enabled=False).where("doc_id = 'a'").first()
    assert off["clean_text"] == "黄芪 与桂挂，甘革□调和" and off["noise_after"] == off["noise_before"]
    twice = [ocr.corrupt(docs).orderBy("doc_id").collect() for _ in range(2)]
    assert twice[0] == twice[1]


DOC = "前言一句。\n# 书\n卷首语。\n## 第一章\n总论一句。\n### 第一节\n细节一句。\n## 第二章\n结语一句。\n"


def test_sections_and_chunks():
    got = chunking.sections_of(DOC, "书名")
    assert [s[0] for s in got] == [["书名"], ["书"], ["书", "第一章"], ["书", "第一章", "第一节"], ["书", "第二章"]]
    assert all(DOC[a:b] == text for _, text, a, b in got)
    assert chunking.sections_of("  \n", None) == []


def test_chunk_sizes_offsets_and_windows(spark):
    long_doc = "# 长\n" + "".join(f"第{k}味黄芪补气。" for k in range(400)) + "\n" + "甲乙丙丁戊" * 300
    docs = spark.createDataFrame([("d", "长", long_doc, "classic", None, None), ("e", "空", " ", "classic", None, None), ("f", None, None, None, None, None), ("g", "书名", DOC, "qa", "p", {"question": "问"})], "doc_id string, title string, text string, source_type string, source_path string, meta map<string,string>")
    c = Chunking(128, 256, 32, 24)
    rows = chunking.chunk(docs, c).collect()
    own = sorted((r for r in rows if r["doc_id"] == "d"), key=lambda r: r["seq"])
    assert {r["doc_id"] for r in rows} == {"d", "g"} and max(r["n_tokens"] for r in own) <= 256 + 40
    assert {r["split_method"] for r in own} >= {"sentence", "token_fallback"}
    assert all(0 <= r["char_start"] <= r["char_end"] <= len(long_doc) for r in own)
    assert [r["seq"] for r in own] == list(range(len(own))) and own[0]["chunk_id"] == "d#c000"
    deep = [r for r in rows if r["title_path"] == ["书", "第一章", "第一节"]][0]
    assert deep["text"].startswith("〈书·第一章·第一节〉\n") and deep["meta"]["question"] == "问"
    flat = docs.where("text is not null")
    whole = chunking.retention(flat, chunking.chunk(docs, c)).collect()
    naive = chunking.retention(flat, chunking.naive_chunks(docs, Chunking(naive_tokens=20))).collect()
    share = {r["doc_id"]: r["retention"] for r in whole}
    less = {r["doc_id"]: r["retention"] for r in naive}
    assert share["d"] > less["d"]


def test_hash_vectors_and_top_k(spark):
    e = embedding.HashEncoder(64)
    v = e.encode(["黄芪补气", "", "黄芪补气"])
    assert np.allclose(np.linalg.norm(v[0]), 1) and not v[1].any() and np.array_equal(v[0], v[2])
    rng = np.random.default_rng(0)
    x = rng.normal(size=(40, 8)).round(2)
    x[7] = x[3]
    rows = spark.createDataFrame([(i, [float(a) for a in r]) for i, r in enumerate(x)] + [(98, None), (99, [1.0, 2.0])], "vec_id long, embedding array<double>").repartition(3)
    q = rows.where("vec_id < 6").withColumnRenamed("vec_id", "query_id")
    got = {(r["query_id"], r["rank"]): r["vec_id"] for r in embedding.top_k(q, rows, 4, "query_id", "vec_id", block=4, skip_same=True).collect()}
    for i in range(6):
        s = np.round(x @ x[i], 6)
        order = sorted((j for j in range(40) if j != i), key=lambda j: (-s[j], j))[:4]
        assert [got[i, k + 1] for k in range(4)] == order
    assert embedding.top_k(q.limit(0), rows, 4, "query_id", "vec_id").count() == 0


CHUNKS = [
    ("c1", "黄芪甘温，功能补气固表，常用于气虚证与自汗。每次用量十克。", "textbook", 0.0), ("c2", "桂枝辛温，能发汗解肌，感冒恶寒发热者宜用。", "classic", 0.0), ("c3", "黄芪汤由黄芪与甘草组成，主治气虚证口渴。请先煎黄芪再下甘草。", "textbook", None),
    ("c4", "黄芪甘温，功能补气固表，常用于气虚证与自汗。每次用量十克呀。", "ocr_scan", 0.35), ("c5", "黄芪好", "qa", 0.0), ("c6", "黄芪甘温，功能补气固表，常用于气虚证与自汗。每次用量十二克。", None, 0.0),
]


def store_of(spark):
    return spark.createDataFrame([(i, i[0], k, t, s, n) for k, (i, t, s, n) in enumerate(CHUNKS)], "chunk_id string, doc_id string, seq int, text string, source_type string, ocr_noise double")


def test_retrieval_modes_and_filter(spark, lexicon):
    q = spark.createDataFrame([("q1", "黄芪有什么功能"), ("q2", "感冒恶寒"), ("q3", "zzz")], "query_id string, text string")
    c = store_of(spark)
    best = {r["query_id"]: r["chunk_id"] for r in retrieval.bm25_top_k(q, c).where("rank = 1").collect()}
    assert best["q2"] == "c2" and "q3" not in best
    for mode in retrieval.MODES:
        rows = retrieval.retrieve(q, c, lexicon, mode, 0).collect()
        for name in ("q1", "q2"):
            ranks = sorted(r["rank"] for r in rows if r["query_id"] == name)
            assert ranks == list(range(1, len(ranks) + 1)) and len(ranks) <= 5
    scored = c.select(F.lit("q").alias("query_id"), "chunk_id").join(spark.createDataFrame([("c1", 0.8), ("c6", 0.75), ("c4", 0.9), ("c5", 0.8), ("c2", 0.05), ("c3", 0.7)], "chunk_id string, score double"), "chunk_id")
    done = {r["chunk_id"]: r for r in retrieval.evidence_filter(scored, c, 5, EvidenceFilter(min_chars=10, dedup_jaccard=0.72)).collect()}
    assert done["c4"]["drop_reason"] == "ocr_noise" and done["c5"]["drop_reason"] == "too_short" and done["c2"]["drop_reason"] == "low_relevance"
    assert done["c6"]["drop_reason"] == "duplicate_of(c1)" and done["c1"]["status"] == done["c3"]["status"] == "kept"
    first = {r["chunk_id"]: r for r in retrieval.evidence_filter(scored, c, 1, EvidenceFilter(min_chars=10)).collect()}
    assert first["c3"]["status"] == "unseen"


def test_fusion_prefers_what_both_channels_find(spark):
    a = spark.createDataFrame([("q", "x", 1), ("q", "y", 2)], "query_id string, chunk_id string, rank int")
    b = spark.createDataFrame([("q", "y", 1), ("q", "z", 2)], "query_id string, chunk_id string, rank int")
    got = {r["chunk_id"]: r["rrf"] for r in retrieval.fuse({"a": a, "b": b}).collect()}
    assert got["y"] > got["x"] > 0 and "z" in got


def test_statements(spark, lexicon):
    j = nli.Judge(lx.matcher(lexicon))
    assert j.judge("病人恶寒明显", "病人不恶寒的")[0] == "contradiction"
    assert j.judge("黄芪其性偏寒凉的药", "黄芪其性偏热燥的药")[0] == "contradiction"
    assert j.judge("黄芪用3g即可", "黄芪用15g即可")[2].startswith("dose:")
    assert j.judge("黄芪能够补气固表", "黄芪能够补气固表的")[0] == "entailment"
    assert j.judge("黄芪补气", "天空很蓝啊")[0] == "neutral"
    assert j.consistency(["只有一句"]) == (1.0, [])
    assert j.consistency(["病人恶寒明显", "病人不恶寒的", "黄芪能够补气"])[0] < 1
    assert j.doses("黄芪三钱，甘草十二克")["黄芪"] == 9.0 and j.doses("甘草十二克") == {"甘草": 12.0}
    rows = spark.createDataFrame([("病人恶寒明显", None)], "premise string, hypothesis string")
    assert nli.judge_pairs(rows, lexicon).first()["label"] is None


def test_agent_answers_and_declines(spark, lexicon):
    q = spark.createDataFrame([("q1", "黄芪汤的组成是什么？"), ("q2", "quantum entanglement of photons")], "query_id string, text string")
    got = {r["query_id"]: r for r in agent.answer(q, store_of(spark), lexicon).collect()}
    assert not got["q1"]["refused"] and "c3" in got["q1"]["citations"] and "〔1〕" in got["q1"]["answer"]
    assert got["q2"]["refused"] and got["q2"]["citations"] == []
    assert 0 <= got["q1"]["confidence"] <= 1 and got["q1"]["rounds_used"] <= 3
    static = {r["query_id"]: r for r in agent.answer(q, store_of(spark), lexicon, mode="static").collect()}
    assert static["q2"]["rounds_used"] == 1 and not static["q2"]["refused"]


def test_questions_that_point_back(spark, lexicon):
    q = spark.createDataFrame([("a", "它怎么用？", []), ("b", "黄芪怎么用？", ["黄芪"])], "query_id string, text string, entities array<string>")
    recent = spark.createDataFrame([(k, {"formula": ["黄芪汤"]}, {"symptom": ["口渴"]}) for k in "ab"], "query_id string, assistant map<string,array<string>>, user map<string,array<string>>")
    got = {r["query_id"]: r["resolved"] for r in agent.resolve_anaphora(q, recent).collect()}
    assert got == {"a": "它怎么用？ 黄芪汤 口渴", "b": "黄芪怎么用？"}


def test_short_term_memory(spark, lexicon):
    turns = spark.createDataFrame([("s", k, "USER" if k % 2 == 0 else "assistant", f"第{k}轮黄芪补气" * 3, None, 0.5, None, False, None) for k in range(12)] + [("s", 3, "assistant", "第3轮黄芪补气" * 3, None, 0.5, None, False, None), ("t", 0, "user", None, None, None, None, False, None)],
                                  "session string, turn int, role string, text string, entities map<string,array<string>>, base_importance double, created_at timestamp, compressed boolean, received_at timestamp")
    rows = memory.replay(turns, lexicon, ShortTerm(window_turns=3)).collect()
    last = max((r for r in rows if r["session"] == "s"), key=lambda r: r["turn"])
    assert last["n_active"] <= 3 and last["n_compressed"] >= 6 and last["summary"] and len(rows) == 13
    tight = memory.replay(turns, lexicon, ShortTerm(window_turns=6, max_window_tokens=30)).where("session = 's'").collect()
    assert all(r["active_tokens"] <= 30 or r["n_active"] == 1 for r in tight)
    w = memory.window_turns(turns, 3).where("active and session = 's'").count()
    assert w == 3
    f = {r["turn"]: r["importance"] for r in memory.latest_turns(turns).select("session", "turn", memory.effective_importance().alias("importance")).where("session = 's'").collect()}
    assert f[0] < f[11] == 0.5


def test_long_term_memory(spark, lexicon):
    def actions(policy, *contents):
        rows = spark.createDataFrame([("k", i, c, "") for i, c in enumerate(contents)], "key string, seq int, content string, source string")
        return [r["action"] for r in memory.write_all(rows, lexicon, LongTerm(merge_similarity=0.99, candidate_similarity=0.2, policy=policy)).orderBy("seq").collect()]

    assert actions("newer_wins", "天气好", "", "黄芪汤治感冒发热", "黄芪汤治感冒发热") == ["rejected_low_importance", "rejected_low_importance", "inserted", "merged"]
    pair = ("感冒发热恶寒，宜用黄芪汤", "感冒不发热恶寒，宜用黄芪汤")
    assert actions("newer_wins", *pair)[1] == "conflict_superseded"
    assert actions("importance_wins", "感冒发热恶寒口渴，宜用黄芪汤甘草", "感冒不发热，宜用黄芪汤")[1] in ("conflict_rejected", "conflict_superseded")


def test_metrics(spark):
    ranked = spark.createDataFrame([("q", k + 1, c) for k, c in enumerate("abcd")], "query_id string, rank int, chunk_id string")
    qrels = spark.createDataFrame([("q", "b"), ("q", "x"), ("r", "a"), ("q", "b")], "query_id string, chunk_id string")
    got = {r["query_id"]: r for r in evaluation.retrieval_metrics(ranked, qrels, (2, 4)).collect()}
    q = got["q"]
    assert (q["recall_2"], q["recall_4"], q["precision_2"], q["mrr"], q["top1"], q["context_precision"]) == (0.5, 0.5, 0.5, 0.5, 0.0, 0.5)
    assert got["r"]["top1"] is None and got["r"]["mrr"] == 0.0
    means = evaluation.mean_metrics(evaluation.retrieval_metrics(ranked, qrels, (2,))).first()
    assert means["n"] == 2 and means["top1"] == 0.0


def test_faithfulness(spark, lexicon):
    rows = [("a", "黄芪能够补气固表止汗。", "黄芪能够补气固表止汗，用量十克。"), ("b", "甘草可以治疗骨折外伤。", "黄芪能够补气固表止汗。"), ("c", "", "x"), ("d", "短", "x")]
    got = {r["query_id"]: r["faithfulness"] for r in evaluation.faithfulness(spark.createDataFrame(rows, "query_id string, answer string, context string"), lexicon).collect()}
    assert got == {"a": 1.0, "b": 0.0, "c": 1.0, "d": 0.0}


def test_records_items_and_samples(spark, lexicon):
    c = store_of(spark).withColumn("title_path", F.array(F.lit("书"), F.lit("节"))).withColumn("meta", F.create_map().cast("map<string,string>"))
    entries = evaluation.records(c)
    assert {r["term"] for r in entries.collect()} >= {"节"}
    items = evaluation.build_items(entries, lexicon).collect()
    assert items and all(r["question"] for r in items)
    pool = spark.createDataFrame([(str(i), "ab"[i % 2] if i < 90 else "z") for i in range(100)], "k string, t string")
    got = sampling.stratified(pool, "k", "t", 30, "z").groupBy("t").count().collect()
    assert {r["t"]: r["count"] for r in got} == {"z": 10, "a": 10, "b": 10}
    assert sampling.stratified(pool, "k", "t", 200).count() == 100
    q = spark.createDataFrame([(i, "问题问题问题问题" + w, "答" * 50, sc, "x", "") for i, (w, sc) in enumerate([("生姜", 5), ("红糖", 3), ("无", 5), ("生姜", 2)])], "id long, question string, answer string, score int, label string, related_diseases string")
    assert [r["id"] for r in sampling.supplement(q, q.where("id = 1"), ["生姜", "红糖"], ["生姜"], 5).collect()] == [0]


def test_store(spark):
    a = spark.createDataFrame([("x", 1, "t1"), ("x", 2, "t2"), ("y", None, "t3"), (None, 1, "t")], "chunk_id string, indexed_at int, text string")
    assert {r["chunk_id"]: r["text"] for r in store.latest(a).collect()} == {"x": "t2", "y": "t3"}
    new = spark.createDataFrame([("y", 8, "older"), ("y", 9, "new"), ("y", 9, "new"), ("z", None, "b"), ("z", None, "a"), (None, 1, "t")], "chunk_id string, indexed_at int, text string")
    got = store.upsert(store.latest(a), new).collect()
    assert {r["chunk_id"]: r["text"] for r in got} == {"x": "t2", "y": "new", "z": "a"} and len(got) == 3
    two = store.upsert(a.dropna(), new.dropna().withColumn("indexed_at", F.lit(1)), ["chunk_id", "text"], "nothing")
    assert sorted((r["chunk_id"], r["text"]) for r in two.collect()) == [("x", "t1"), ("x", "t2"), ("y", "new"), ("y", "older")]
    assert {(r["by"], r["value"], r["n"]) for r in store.counts(a, ("text", "chunk_id")).collect()} >= {("text", "t1", 1), ("chunk_id", "x", 2), ("chunk_id", None, 1)}


def test_stored_terms(spark, tmp_path, lexicon):
    chunks = spark.createDataFrame([("a", "黄芪汤治感冒"), ("b", "黄芪补气 Tea"), ("c", None), ("d", "甘草汤")], "chunk_id string, text string")
    asked = spark.createDataFrame([("q", "黄芪汤 tea"), ("n", None)], "query_id string, text string")
    made = TermIndex.build(chunks)
    made.save(str(tmp_path))
    stored = TermIndex.load(spark, str(tmp_path))
    rows = lambda ix: sorted(map(tuple, retrieval.bm25_top_k(asked, chunks, index=ix).collect()))
    assert rows(None) == rows(made) == rows(stored) and len(rows(stored)) == 2
    whole = TermIndex.build(chunks, lexicon)
    assert {r["term"] for r in whole.terms.collect()} - {r["term"] for r in made.terms.collect()} == {"黄芪汤"}
    assert retrieval.bm25_top_k(asked, chunks, index=whole, lexicon=lexicon).where("rank = 1").first()["chunk_id"] == "a"
    assert TermIndex.build(chunks.limit(0)).terms.count() == 0 and retrieval.bm25_top_k(asked, chunks.limit(0)).count() == 0


def test_model_reranking_is_decided_by_query(spark):
    scored = spark.createDataFrame([("q", "a", 0.5), ("q", "b", 0.5), ("r", "a", 0.5)], "query_id string, chunk_id string, score double")
    queries = spark.createDataFrame([("q", "good"), ("r", "bad")], "query_id string, text string")
    chunks = spark.createDataFrame([("a", "x"), ("b", "yy")], "chunk_id string, text string")

    def post(query, texts):
        return [float("nan") if query == "bad" else len(t) / 4 for t in texts]

    class Half(retrieval.Reranker):
        def scores(self, queries, texts):
            return [float("nan") if q == "bad" else float(len(t)) for q, t in zip(queries, texts, strict=True)]

    got = {(r["query_id"], r["chunk_id"]): r["score"] for r in retrieval.rerank_with(scored, queries, chunks, Half()).collect()}
    assert got["r", "a"] == 0.5 and got["q", "a"] < got["q", "b"] != 0.5
    assert retrieval.create_reranker() is None and isinstance(retrieval.create_reranker("remote", post), retrieval.RemoteReranker)
    assert retrieval.create_reranker("remote", post).scores(["good", "good"], ["x", "yy"])[0] < 0
    with pytest.raises(ValueError):
        retrieval.create_reranker("magic", post)


def test_parts_of_a_text_are_measured():
    rng = random.Random(5)
    for _ in range(60):
        text = "".join(rng.choice("ab1黄，。 　\n-") for _ in range(rng.randint(0, 40)))
        r = chunking.Ruler(text)
        for a in range(len(text) + 1):
            for b in range(a, len(text) + 1):
                assert r.tokens(a, b) == python_tokens(text[a:b])
            for limit in (1, 3, 7):
                assert r.reach(a, len(text), limit) == a + len(python_truncate(text[a:], limit))


def test_what_memory_adds(spark, lexicon):
    rows = [("s", 0, "user", "感冒怎么办", {"disease": ["感冒"]}), ("s", 1, "assistant", "可用黄芪汤", {"formula": ["黄芪汤"]}), ("s", 2, "user", "它怎么用？", None), ("s", 3, "assistant", "黄芪汤先煎", {"formula": ["黄芪汤"]})]
    turns = spark.createDataFrame(rows, "session string, turn int, role string, text string, entities map<string,array<string>>").withColumn("received_at", F.lit(None).cast("timestamp"))
    got = {r["kind"]: r for r in agent.memory_effect(turns, lexicon).collect()}
    assert got["points_back"]["hit"] == 1.0 and got["points_back"]["hit_without"] == 0.0 and got["direct"]["completed"] == 0.0


def test_retention_of_sentences_over_many_chunks(spark):
    long = "".join(chr(0x4E00 + k) for k in range(1500)) + "。"
    docs = spark.createDataFrame([("a", long + "黄芪补气。\n黄芪补气。", "classic"), ("b", "甘草和中。桂枝解肌。", None), (None, "甘草和中。", "qa")], "doc_id string, text string, source_type string")
    pieces = [long[k : k + 100] for k in range(0, len(long), 100)] + ["黄芪 补气。"]
    chunks = spark.createDataFrame([("a", f"a#{k:03d}", k, p) for k, p in enumerate(pieces)] + [("b", "b#0", 0, "甘草和"), ("b", "b#1", 1, "中。"), ("c", "c#0", 0, "桂枝解肌。")], "doc_id string, chunk_id string, seq int, text string")
    found = chunking.retention(docs, chunks, None, "source_type")
    assert {(r["source_type"], r["sentences"], r["retained"]) for r in found.collect()} == {("classic", 3, 3), (None, 2, 1), ("qa", 1, 0), (None, 6, 4)}
    # Nothing is sent to the driver, whatever the threshold for broadcasts is.
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    named = {r["doc_id"]: (r["sentences"], r["retained"]) for r in chunking.retention(docs, chunks, ["黄芪", "桂枝", "x"]).collect()}
    assert named == {"a": (2, 2), "b": (1, 0)}
