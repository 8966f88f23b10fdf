import os

import pytest
from pyspark.sql import functions as F

from quillmere.llm import p7_mix as p7
from quillmere.llm import p8_level as p8


def test_water_fill():
    assert p7.water_fill(10, [1, 1], [100, 100]) == [5, 5]
    assert p7.water_fill(10, [1, 1], [2, 100]) == [2, 8]
    assert p7.water_fill(10, [1, 1, 0], [2, 3, 50]) == [2, 3, 0]
    assert p7.water_fill(0, [1], [1]) == [0] and p7.water_fill(5, [], []) == []


def test_siblings_come_before_ancestors():
    leaves = {("wiki", "zh", "a_wiki"): (0.25, 1.0), ("wiki", "zh", "b_wiki"): (0.25, 100.0), ("notes", "zh", "c_notes"): (0.5, 100.0)}
    got = p7.budgets(leaves, 40)
    assert got["wiki", "zh", "a_wiki"] == 1 and got["wiki", "zh", "b_wiki"] == 19 and got["notes", "zh", "c_notes"] == 20


TOKENIZER = p7.Settings().tokenizer


@pytest.mark.skipif(not os.path.exists(TOKENIZER), reason="no tokenizer files here")
def test_mix(spark):
    docs = [(k, f"document number {k} about tea and roots " * (1 + k % 5), ["a_wiki", "b_wiki", "c_notes"][k % 3] if k else "tiny_notes") for k in range(300)]
    docs += [(900, None, "a_wiki"), (901, "", "a_wiki"), (902, "x", None), (5, docs[5][1], docs[5][2])]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").withColumn("tokens", F.lit(-1)).repartition(4)
    targets = spark.createDataFrame([("m", "a_wiki", 0.5, 2, 0.5), ("m", "c_notes", 0.3, 1, 0.5), ("m", "tiny_notes", 0.2, 3, 0.5), ("m", "absent_x", 0.1, 2, 0.5), ("z", "a_wiki", None, 2, 1.0), (None, "a_wiki", 1.0, 1, 1.0)], "mix_id string, source string, target_share double, max_repeats int, size_ratio double")
    s = p7.Settings(buckets=16)
    rows = p7.mix(df, targets, s).collect()
    caps = {"a_wiki": 2, "c_notes": 1, "tiny_notes": 3}
    assert rows and all(1 <= r["copies"] <= caps[r["source"]] for r in rows) and len({(r["mix_id"], r["doc_id"]) for r in rows}) == len(rows)
    rep = {(r["mix_id"], r["source"]): r for r in p7.report(df, targets, s).collect()}
    made = rep["m", "a_wiki"]["mix_actual_tokens"]
    assert abs(made - rep["m", "a_wiki"]["mix_target_tokens"]) < 120
    assert rep["m", "tiny_notes"]["most_copies"] == 3 and rep["m", "absent_x"]["actual_tokens"] == 0 and rep["z", "a_wiki"]["actual_tokens"] == 0
    assert abs(sum(r["actual_share"] for (m, _), r in rep.items() if m == "m") - 1) < 1e-9
    assert sum(r["tokens"] * r["copies"] for r in rows if r["source"] == "a_wiki") == rep["m", "a_wiki"]["actual_tokens"]
    assert p7.mix(df.limit(0), targets, s).count() == 0 and p7.mix(df, targets.limit(0), s).count() == 0
    again = {(r["doc_id"], r["copies"]) for r in p7.mix(df.repartition(7), targets, s).collect()}
    assert again == {(r["doc_id"], r["copies"]) for r in rows}


EASY = ["小朋友你看，叶子是圆的。", "多喝温水，少熬夜。", "不要怕，咳嗽很常见。"]
HARD = ["贝叶斯分层模型的后验分布提示量表各维度的测量不变性。", "异质性检验提示残余混杂仍不可忽略。", "倍半萜内酯构成比与单倍型显著相关。"]


def test_levels(spark):
    docs = [(k, "".join((EASY if k % 2 else HARD)[j % 3] for j in range(k, k + 4)) + (HARD[0] if k % 2 else EASY[0])) for k in range(60)]
    docs += [(100, None), (101, ""), (102, "白雁丸は頭痛に用いられる。"), (103, "!!!"), (104, EASY[0] * 2000), (1, docs[1][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("reading_level", F.lit(9)).repartition(3)
    labels = spark.createDataFrame([(k, 1 if k % 2 else 4, "a") for k in range(30)] + [(2, None, "b"), (3, 7, "b"), (4, 1, "b"), (4, 4, "c"), (999, 2, "a")], "doc_id long, reading_level int, annotator string")
    rows = p8.levels(df, labels).collect()
    got = {r["doc_id"]: r["reading_level"] for r in rows}
    assert len(rows) == len(got) and set(got) == {*range(60), 104} and got[104] == 1
    assert all(got[k] == (1 if k % 2 else 4) for k in range(60))
    assert p8.levels(df, labels.limit(0)).count() == 0 and p8.levels(df.limit(0), labels).count() == 0


def test_words_of_sentences():
    w = p8.words_of(["黄芪补气。短！Good"], "zh")
    assert list(w.lengths) == [3]
    assert list(p8.words_of(["The tea is hot. Wait for it."], "en").lengths) == [4, 3]
    assert len(p8.words_of([""], "zh").ids) == 0
