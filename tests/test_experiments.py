import json
import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from quillmere.functions import text as tx
from quillmere.operators import completion, evaluation, experiments, ocr, retrieval
from quillmere.operators import lexicon as lx
from quillmere.plans import catalogue
from quillmere.sources import readers, sinks

CHUNKS = [
    ("a#0", "a", 0, "黄芪汤由黄芪与甘草组成，主治气虚证口渴，感冒后体弱者也可用。", "textbook"), ("b#0", "b", 0, "桂枝辛温，感冒恶寒发热者宜用，先煎桂枝，再入甘草同煎即可。", "classic"),
    ("c#0", "c", 0, "黄芪汤的煎法是先煎黄芪，后下甘草，每日两次，饭后温服为宜。", "qa"),
]


@pytest.fixture(scope="module")
def chunks(spark):
    return spark.createDataFrame(CHUNKS, "chunk_id string, doc_id string, seq int, text string, source_type string").withColumn("ocr_noise", F.lit(None).cast("double"))


def scripted(*rules):
    """A model that says what it was told to, or fails; made here so that workers get it whole."""

    class Scripted:
        def complete(self, prompt, system=None):
            for word, said in rules:
                if word in prompt:
                    return said
            raise completion.CompletionError("nothing to say")

    return Scripted()


def test_completions(monkeypatch):
    seen = []
    end = completion.ChatEndpoint("http://h/", "m", "k", post=lambda body: seen.append(body) or {"choices": [{"message": {"content": "ok"}}]})
    assert end.complete("p", "s") == "ok" and [m["role"] for m in seen[0]["messages"]] == ["system", "user"]
    with pytest.raises(completion.CompletionError):
        completion.ChatEndpoint("http://h", "m", post=lambda body: {}).complete("p")
    assert completion.object_in('said:\n```json\n{"a": 1}\n```') == {"a": 1}
    for bad in ("none", "{1}", "[1]"):
        with pytest.raises(completion.CompletionError):
            completion.object_in(bad)
    assert completion.create_completion() is None and completion.create_completion(end) is end
    monkeypatch.setenv("COMPLETION_URL", "http://h")
    assert isinstance(completion.create_completion(), completion.ChatEndpoint)


def test_judged_and_free_answers(spark, lexicon):
    rows = spark.createDataFrame([("q1", "问甲", "黄芪汤主治气虚证口渴。", "黄芪汤主治气虚证口渴。", False), ("q2", "问乙", None, None, True), ("q3", "问丙", "天气很好很好很好。", "黄芪", False)], "query_id string, question string, answer string, context string, refused boolean")
    got = {r["query_id"]: r for r in completion.judged(rows, scripted(("黄芪汤", '{"score": 3}'), ("问丙", "no object"))).collect()}
    assert got["q1"]["judged_faithfulness"] == 1.0 and got["q2"]["judged_relevancy"] is None and got["q3"]["judged_relevancy"] is None
    ways = {r["way"]: r for r in experiments.grounded_and_free(rows, scripted(("问甲", "桂枝主治感冒发热恶寒。"), ("问乙", "甘草主治感冒发热恶寒。")), lexicon).collect()}
    assert ways["grounded"]["answered"] == ways["free"]["answered"] == 0.6667 and ways["grounded"]["faithfulness"] > ways["free"]["faithfulness"]


def test_ocr_recovery(spark, lexicon):
    truth = spark.createDataFrame([("x", "黄芪与甘草主治感冒发热。" * 3), ("y", "桂枝"), (None, "z"), ("n", None)], "stem string, text string")
    noisy = spark.createDataFrame([("x", "黄 芪与甘革主治感冒发热。" * 3), ("w", "桂枝")], "stem string, text string")
    row = experiments.ocr_recovery(truth, noisy, lexicon).collect()
    assert len(row) == 1 and row[0]["raw_term_recall"] < row[0]["cleaned_term_recall"] == 1.0 and row[0]["raw_char_accuracy"] < row[0]["cleaned_char_accuracy"]
    assert experiments.ocr_recovery(truth.limit(0), noisy, lexicon).count() == 0
    assert ocr.corrupt(truth, "text", "stem").where("stem = 'n'").first()["corrupted"] is None


def test_recovery_is_measured_on_whole_texts(spark, lexicon, tmp_path):
    r = random.Random(9)
    text = "".join(r.choice("已己未末土士日曰风凤") + chr(0x4E00 + r.randrange(900)) for _ in range(3000))
    spark.createDataFrame([("x", text, "a")], "doc_id string, text string, source_type string").write.parquet(f"{tmp_path}/source_documents.parquet")
    lexicon.write.parquet(f"{tmp_path}/lexicon.parquet")
    (got,) = catalogue.queries()["v19_ocr_recovery"](spark, str(tmp_path)).collect()
    noisy = ocr.clean(ocr.corrupt(spark.createDataFrame([("x", text)], "doc_id string, text string")), "corrupted", lexicon)
    bare = [tx.python_squeeze(t) for t in noisy.select("text", "corrupted", "clean_text").first()]
    for n, name in ((1, "raw_char_accuracy"), (2, "cleaned_char_accuracy")):
        assert abs(got[name] - SequenceMatcher(None, bare[0], bare[n], autojunk=False).ratio()) < 1e-4


def test_recovery_reads_one_text_of_each_document_once(spark, lexicon, tmp_path):
    rows = [("x", "黄芪与甘草主治感冒发热。" * 9, "a"), ("x", "桂枝", "b"), ("y", "口渴恶寒。" * 9, "b"), ("n", None, "a"), (None, "甘草", "a")]
    spark.createDataFrame(rows, "doc_id string, text string, source_type string").write.parquet(f"{tmp_path}/source_documents.parquet")
    lexicon.write.parquet(f"{tmp_path}/lexicon.parquet")
    found = catalogue.QUERIES["v19_ocr_recovery"](spark, str(tmp_path))
    got = {r["source_type"]: r for r in found.collect()}
    assert {k: (r["n"], r["n_terms"]) for k, r in got.items()} == {"b": (2, 1.5)}
    assert found._jdf.queryExecution().optimizedPlan().toString().count("doc_id") > 0 == found._jdf.queryExecution().optimizedPlan().toString().count("Join")


def test_dialogues(spark, chunks, lexicon):
    asked = spark.createDataFrame([("d", 0, "黄芪汤主治什么？", "direct", ["a#0", "c#0"]), ("d", 1, "它怎么煎？", "anaphora", ["c#0", "a#0"]), ("d", 1, "它怎么煎？", "anaphora", ["c#0", "a#0"])], "dialogue_id string, turn int, question string, kind string, gold_chunk_ids array<string>")
    got = {(r["memory"], r["kind"]): r for r in experiments.dialogues(asked, chunks, lexicon).collect()}
    assert set(got) == {(m, k) for m in (False, True) for k in ("direct", "anaphora")} and all(r["n"] == 1 for r in got.values())
    assert got[True, "anaphora"]["hit"] >= got[False, "anaphora"]["hit"] and got[True, "direct"]["hit"] == 1.0
    assert experiments.dialogues(asked.limit(0), chunks, lexicon).count() == 0


def test_rerankers_and_timings(spark, chunks, lexicon):
    asked = spark.createDataFrame([("q", "感冒恶寒用什么"), ("r", "黄芪汤的煎法")], "query_id string, text string")
    gold = spark.createDataFrame([("q", "b#0"), ("r", "c#0")], "query_id string, chunk_id string")

    class Short(retrieval.Reranker):
        def scores(self, queries, texts):
            return [float(-len(t)) for t in texts]

    got = {r["reranker"]: r["mrr"] for r in experiments.compare_rerankers(asked, chunks, lexicon, gold, {"features": None, "short": Short()}).collect()}
    assert got["features"] == 1.0 and set(got) == {"features", "short"}
    rows = {r["stage"]: r["ms"] for r in experiments.timings(asked, chunks, lexicon).collect()}
    assert set(rows) == {"dense", "bm25", "fusion", "rerank", "filter", "total"} and abs(rows["total"] - sum(v for k, v in rows.items() if k != "total")) < 1


def test_counts_and_deltas(spark):
    rows = spark.createDataFrame([("m", "unanswerable", True), ("m", "unanswerable", None), ("m", "herb", True), ("n", "herb", False)], "mode string, item_type string, refused boolean")
    got = {r["mode"]: r for r in experiments.recomputed(rows).collect()}
    assert got["m"]["refusal_accuracy"] == 0.5 and got["m"]["over_refusal"] == 1.0 and got["n"]["refusal_accuracy"] is None
    now = spark.createDataFrame([("a", 0.5), ("b", float("nan")), ("c", 1.0)], "mode string, mrr double")
    before = spark.createDataFrame([("a", 0.25), ("b", 1.0)], "mode string, mrr double")
    assert {r["mode"]: r["mrr_delta"] for r in experiments.deltas(now, before, ["mode"]).collect()} == {"a": 0.25, "b": None, "c": None}
    words = experiments.keyword_counts(spark.createDataFrame([("ab", None), ("a", "b"), (None, None)], "x string, y string"), ["x", "y"], ["a", "b", "c", "a"])
    assert [(r["keyword"], r["n"]) for r in words.collect()] == [("a", 2), ("b", 2)]


def test_further_items(spark, lexicon):
    rows = [("k1", "黄芪汤", "classic", "c1", 0, "黄芪汤用黄芪"), ("k1", "黄芪汤", "classic", "c2", 1, "气虚证见发热口渴"), ("k2", "黄芪", "textbook", "c3", 0, "甘草"), ("k3", "问", "qa", "c4", 0, None)]
    entries = spark.createDataFrame(rows, "record_key string, term string, source_type string, chunk_id string, seq int, text string")
    got = {(r["record_key"], r["item_type"], r["chunk_id"]) for r in evaluation.further_items(entries, lexicon).collect()}
    assert got == {("k1", "classic", "c1"), ("k1", "diagnosis", "c2"), ("k1", "multi_hop", "c1"), ("k1", "multi_hop", "c3"), ("k3", "qa", "c4")}
    assert lx.seed(spark).count() == lx.seed(spark).distinct().count() > 100


def test_reports_and_kinds(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps([{"a": 1}, {"a": 2}]), encoding="utf-8")
    assert readers.reports(spark, str(tmp_path / "r.json")).count() == 2
    df = spark.createDataFrame([(1, float("nan"))], "a int, b double")
    assert readers.reports(spark, sinks.json_lines(df, str(tmp_path / "rows"))).first()["b"] is None
    folder = tmp_path / "corpus"
    folder.mkdir()
    (folder / "x.md").write_text("# 一\n黄芪", encoding="utf-8")
    assert readers.corpus(spark, str(folder)).count() == 1
    (folder / "y.docx").write_text("?", encoding="utf-8")
    with pytest.raises(ValueError):
        readers.corpus(spark, str(folder))
