import json

import pytest
from pyspark.sql import functions as F

from quillmere import config
from quillmere.engine import Engine
from quillmere.sources import readers, sinks
from quillmere.streaming.conversations import entity_counts, session_memory


@pytest.fixture()
def folder(tmp_path):
    (tmp_path / "ocr").mkdir()
    (tmp_path / "a b.md").write_text("前言\n# 题目\n黄芪补气。", encoding="utf-8")
    (tmp_path / "ocr" / "scan.md").write_text("无题", encoding="utf-8")
    (tmp_path / "_skip.md").write_text("# x", encoding="utf-8")
    (tmp_path / "n.txt").write_text("文本", encoding="utf-8")
    (tmp_path / "book.json").write_text(json.dumps({"book": "本草", "chapters": [{"title": "补气", "records": [{"term": "黄芪", "fields": {"性味": "甘温"}}]}]}, ensure_ascii=False), encoding="utf-8")
    return tmp_path


def test_readers(spark, folder):
    docs = {r["title"]: r for r in readers.corpus(spark, str(folder)).collect()}
    assert set(docs) == {"题目", "scan", "n", "本草"}
    assert docs["scan"]["source_type"] == "ocr_scan" and docs["题目"]["source_type"] == "classic"
    assert docs["本草"]["text"] == "# 本草\n\n## 补气\n\n### 黄芪\n\n【性味】甘温\n" and docs["本草"]["meta"]["n_records"] == "1"
    assert docs["题目"]["doc_id"].startswith("a b_")
    assert [(r["term"], r["type"]) for r in readers.textbook_terms(spark, str(folder), {"本草": "herb"}).collect()] == [("黄芪", "herb")]
    with pytest.raises(ValueError):
        readers.corpus(spark, str(folder), (".xyz",))


def test_question_records(spark, tmp_path):
    path = tmp_path / "q.jsonl"
    path.write_text('{"id": "1", "question": "问题' + "很" * 30 + '？", "answer": "答", "label": "x", "score": 5}\nnot json\n', encoding="utf-8")
    rows = readers.question_records(spark, str(path))
    doc = readers.questions_to_documents(rows).collect()
    assert len(doc) == 1 and doc[0]["doc_id"] == "qa_1" and doc[0]["title"].endswith("…") and doc[0]["meta"]["score"] == "5"


def test_sinks(spark, tmp_path, lexicon):
    a = spark.createDataFrame([("x", 1.0), ("y", float("nan"))], "chunk_id string, v double")
    sinks.upsert_table(a, str(tmp_path), "t")
    sinks.upsert_table(spark.createDataFrame([("x", 9.0)], "chunk_id string, v double"), str(tmp_path), "t")
    assert {r["chunk_id"]: r["v"] for r in spark.read.parquet(str(tmp_path / "t")).where("chunk_id = 'x'").collect()} == {"x": 9.0}
    sinks.delete_rows(spark.createDataFrame([("x",)], "chunk_id string"), str(tmp_path), "t", "chunk_id")
    assert spark.read.parquet(str(tmp_path / "t")).count() == 1
    assert spark.read.json(sinks.json_lines(a, str(tmp_path / "j"))).where("v is null").count() == 1
    back = readers.lexicon_json(spark, sinks.lexicon_json(lexicon, str(tmp_path / "lex")))
    assert back.count() == lexicon.select("term", "type").distinct().count()
    assert "| 1 |" in sinks.markdown_report("R", {"t": a.where("chunk_id = 'x'").select(F.lit("m").alias("mode"), "v")}).replace("1.0", "1")
    assert sinks.metric_index({"t": a}).count() == 2


def test_engine(spark, tmp_path, lexicon):
    docs = spark.createDataFrame([("d", "书", "# 书\n黄芪汤由黄芪与甘草组成，主治气虚证口渴。\n## 二\n桂枝辛温，感冒恶寒发热者宜用。", "textbook", "p", {"a": "b"})], "doc_id string, title string, text string, source_type string, source_path string, meta map<string,string>")
    e = Engine(spark, str(tmp_path), config.load({"evidence": {"min_chars": 8, "min_rel_score": 0.05}}))
    assert e.build(docs, lexicon).first()["n_chunks"] == 2
    assert e.search(["感冒恶寒用什么"]).where("rank = 1").count() == 1
    turns = spark.createDataFrame([("s", 0, "user", "感冒发热恶寒怎么办"), ("s", 1, "assistant", "可用桂枝")], "session string, turn int, role string, text string").withColumns({"received_at": F.lit(None).cast("timestamp"), "entities": F.lit(None).cast("map<string,array<string>>")})
    first = e.chat(turns).collect()
    assert len(first) == 1 and first[0]["memories"] == [] and e.health()["chunks"] == 2
    # Another session leaves the first one as it is; turns and records are kept by key.
    other = turns.where("turn = 0").withColumn("session", F.lit("s2"))
    assert e.chat(other).count() == 1 and e.chat(other).count() == 1
    stored = e._table("turns").collect()
    assert sorted((r["session"], r["turn"], r["role"]) for r in stored) == [("s", 0, "user"), ("s", 1, "assistant"), ("s2", 0, "user"), ("s2", 1, "assistant")]
    records = e.memories.collect()
    assert {r["key"] for r in records} == {"s", "s2"} and len(records) == len({(r["key"], r["id"]) for r in records})
    assert all(len(r["embedding"]) == e.encoder.dim and r["content"] for r in records) and max(r["hits"] for r in records if r["key"] == "s2") >= 1
    again = e.chat(spark.createDataFrame([("s", 2, "user", "感冒发热恶寒口渴怎么办")], "session string, turn int, role string, text string").withColumns({"received_at": F.lit(None).cast("timestamp"), "entities": F.lit(None).cast("map<string,array<string>>")})).first()
    assert any("感冒" in m for m in again["memories"]) and e.session("s").count() == 4
    e.reset_session("s")
    assert {r["session"] for r in e._table("turns").collect()} == {"s2"}
    with pytest.raises(ValueError):
        e.search([""])
    with pytest.raises(ValueError):
        config.load({"nothing": {"x": 1}})


def test_stream_equals_replay(spark, tmp_path, lexicon):
    rows = [("s", k, "user", f"第{k}轮黄芪", None, f"2025-01-01 00:0{k}:00") for k in range(9)]
    df = spark.createDataFrame(rows, "session string, turn int, role string, text string, entities map<string,array<string>>, received_at string").withColumn("received_at", F.to_timestamp("received_at"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = session_memory(stream, lexicon).writeStream.format("memory").queryName("stm").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = {r["turn"]: (r["n_active"], r["summary"]) for r in spark.sql("select * from stm").collect()}
    from quillmere.operators.memory import replay

    assert got == {r["turn"]: (r["n_active"], r["summary"]) for r in replay(df, lexicon).collect()}
    words = df.withColumn("entities", F.create_map(F.lit("herb"), F.array(F.lit("黄芪"))))
    assert entity_counts(words, at="received_at").first()["n"] == 9
