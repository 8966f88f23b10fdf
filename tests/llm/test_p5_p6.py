import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmere.llm import p5_sentences as p5
from quillmere.llm import p6_leaks as p6
from quillmere.llm.scripts import Simplifier, simplified

CASES = [
    (False, ["体温36.5℃，记录编号 No. 24.4。", "怎么会心悸？！", "初觉腹胀……继而头痛。", "荣卫相搏，耳鸣乃起；毋伐天和。"]),
    (False, ["他写道：“先看舌。夜里不渴。”", "书中写道：“再看脉。不可再汗。”，可作参考。", "病家答：“再看脉？”，随后提灯而去。", "“水要滚开！”采药人低声说。", "原书注云「不可再汗。」，今从之。"]),
    (False, ["乌坡皮（性平。味淡。）宜于睡前采收。", "(5) 荷川叶洗净，阴干。", "真的好了！！！"]),
    (False, ["Mr. J. R. Corvane et al. grew talmin moss near St. Ulvin.", "(The seed was dried. See above.)", "See Sect. 9.8 and Nos. 3 vs. 60 for details.", 'He said, "Rest first. Then eat." before leaving.', '"Is it worse?" she asked.', "It cost $4.25 per kg... then prices fell.", "The dose, i.e. 0.8 mL, was given at 6 p.m. to each patient."]),
    (False, ["Bei Fieber nimmt man z. B. 0.75 g Moos.", "„Hilft das?“, fragte der Kranke.", "Am 3. Mai wurde sie geerntet.", "Vgl. Abb. 5.", "Wer leidet, sollte schlafen!"]),
    (False, ["M. Velmor a noté, p. ex., que la toux revient.", "« D’où vient la toux ? » demanda-t-il.", "Pourquoi la fatigue ?"]),
    (False, ["「咳は夜に強くなりますか。」と師は尋ねた。", "月見皮（苦い。少し甘い。）を水で洗う。", "なぜ咳が治らないのでしょうか？"]),
    (False, ['"두통은 언제 시작되었나요?"라고 물었다.', "표 3.7을 참고하십시오!"]),
    (False, ["डॉ. वेल्म ने 9 मामले लिखे।", 'वैद्य ने कहा, "पहले आराम करो। फिर खाओ।" और चले गए।']),
    (False, ["قال الطبيب: «استرح أولا. ثم كل.» وانصرف.", "راجع د. فلم في الفصل 7.2؛ ففيه شرح."]),
    (False, ["กินยาวันละ 6 ครั้งหลังอาหาร", "ควรดื่มน้ำอุ่นก่อนนอน"]),
    (True, ["要不要换黄芪汤？？", "昨晚吃了甘草～", "受凉后还会失眠🙏", "量过体温 39.5 度。。。", "已经3天了"]),
]


def test_sentences_of_ten_languages(spark):
    rows, want = [], {}
    for k, (chat, parts) in enumerate(CASES):
        glue = "" if any("一" <= c <= "鿿" for c in parts[0]) and not chat else " "
        text, ends = "", []
        for p in parts:
            text += p
            ends.append(len(text))
            text += glue
        rows.append((f"k{k}", chat, text))
        want[f"k{k}"] = ends
    df = spark.createDataFrame(rows, "k string, chat boolean, text string")
    got = {}
    for r in p5.sentences(df, ["k"], "text", F.col("chat")).collect():
        got.setdefault(r["k"], []).append(r["end_pos"])
    for k, ends in want.items():
        assert sorted(got[k]) == ends, (k, rows[int(k[1:])][2])


def test_lines_headings_and_edges(spark):
    text = "# 一。二。\n1. 加水浸泡60分钟。\n煎服分三盏\n\n【按语】\n👍好。​\n  尾 "
    rows = [("a", text), ("a", text), ("n", None), ("e", ""), ("b", " \n　\n"), ("l", "黄芪补气。" * 3000), ("x", "\U00020000。𠮷。")]
    df = spark.createDataFrame(rows, "k string, text string").withColumn("end_pos", F.lit(-1))
    got = {}
    for r in p5.sentences(df, ["k"]).collect():
        got.setdefault(r["k"], []).append(r["end_pos"])
    assert set(got) == {"a", "l", "x"} and sorted(got["x"]) == [2, 4] and len(got["l"]) == 3000
    cut = lambda s: text.index(s) + len(s)
    assert sorted(got["a"]) == [cut("# 一。二。"), cut("60分钟。"), cut("三盏"), cut("【按语】"), cut("👍好。"), cut("尾")]
    said = {r["sentence"] for r in p5.sentence_texts(df.where("k = 'a'"), ["k"]).collect()}
    assert said >= {"# 一。二。", "1. 加水浸泡60分钟。", "煎服分三盏", "👍好。", "尾"}


def test_long_lines(spark):
    import time

    deep = "乌坡皮（" + "性平" * 300 + "。味淡" * 200 + "。）宜用。"
    link = "见 http://a.b/" + "c." * 400 + "d 一文。"
    quote = '他说"' + "先看。" * 300 + '"，可。'
    # A megabyte on one line, with marks that are never closed.
    huge = "他写道：“（先看舌。" + "夜里不渴。" * 200_000
    df = spark.createDataFrame([("a", deep + deep), ("b", link + "好。"), ("c", quote), ("d", huge)], "record_key string, text string")
    begun = time.perf_counter()
    got = {}
    for r in p5.sentences(df, ["record_key"]).collect():
        got.setdefault(r["record_key"], []).append(r["end_pos"])
    assert sorted(got["a"]) == [len(deep), 2 * len(deep)] and sorted(got["b"]) == [len(link), len(link) + 2] and got["c"] == [len(quote)]
    assert len(got["d"]) == 200_001 and time.perf_counter() - begun < 60


def test_alignment():
    code = lambda s: p6._codes(s)
    assert p6.stretch(code("abcdefghij"), code("xxabcdefghijyy"), 2) == (10, 0)
    assert p6.stretch(code("abcdefghij"), code("xxabcdXfghijyy"), 2) == (10, 1)
    run, cost = p6.stretch(code("abcdefghijklmnop"), code("zzabcdefghzz"), 2)
    assert run == 8 and cost == 8
    assert p6.stretch(code("aXcXefghij"), code("aYcYefghij"), 2)[1] == 2


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame(
        [("q1", "竹筲煎沙泽芝与米泔浸之雁羽参，哪一种于冬至晨更宜胆气滞证之失眠？", "月铃藤色皎者归胃经，米泔浸后色皎者归肺经，以铜釜贮九粒，可缓胃厥病之肢麻。鹤泽霜丸去溪纹草易麦鳞根一撮。"), ("q2", "Why must candied quercine gall from brindle be kept 24 days before treating back pain near brindle?", None), ("q3", None, ""), (None, "x", "y")],
        "qid string, question string, reference_answer string",
    )


def test_leaks(spark, items):
    q1 = "竹筲煎沙泽芝与米泔浸之雁羽参，哪一种于冬至晨更宜胆气滞证之失眠？"
    a1 = "月铃藤色皎者归胃经，米泔浸后色皎者归肺经，以铜釜贮九粒，可缓胃厥病之肢麻。鹤泽霜丸去溪纹草易麦鳞根一撮。"
    docs = [
        (1, "前文。" + q1 + "后文。"), (2, "前文" + q1.replace("冬至", "夏至").replace("，", "\n")), (3, q1[:20]), (4, "开头" + a1[:32] + "结尾"), (5, "开头" + a1[:14] + "结尾"), (6, None), (7, ""),
        (8, "WHY MUST candied　quercine gall from brindle be kept 25 days, before treating back-pain near brindle"), (9, "Why must candied quercine gall be kept"), (10, "竹筲煎沙澤芝與米泔浸之雁羽參，哪一種於冬至晨更宜膽氣滯證之失眠？"), (1, "前文。" + q1 + "后文。"),
    ]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("qid", F.lit("?")).repartition(3)
    got = sorted((r["doc_id"], r["qid"]) for r in p6.leaks(df, items).collect())
    assert got == [(1, "q1"), (2, "q1"), (4, "q1"), (8, "q2"), (10, "q1")]
    assert p6.leaks(df, items.limit(0)).count() == 0 and p6.leaks(df.limit(0), items).count() == 0
    small = p6.leaks(df, items, s=p6.Settings(block_letters=1)).count()
    assert small == 5


def test_leaks_that_are_copied_often(spark, items):
    q1, a1 = items.where("qid = 'q1'").select("question", "reference_answer").first()
    docs = [(k, f"第{k}篇。" + (q1 if k % 2 else a1[:32])) for k in range(300)]
    df = spark.createDataFrame([*docs, (300, "无关的文字。")], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in p6.leaks(df, items).where("qid = 'q1'").collect()) == list(range(300))


def found_in(codes, ix, s):
    grams = p6._grams(codes, tuple(ix.by_length))
    hits = {n: p6._hits(grams[n], n, ix) for n in ix.by_length}
    return {ix.owner[p.pattern] for p in p6.places(codes, hits, ix, s) if p6.holds(p, ix, s)}


def test_grams_are_equal_where_letters_are():
    rng = np.random.default_rng(2)
    codes = rng.integers(97, 100, 400).astype(np.uint32)
    made = p6._grams(codes, p6.LENGTHS)
    for n in p6.LENGTHS:
        seen = {}
        for k in range(len(codes) - n + 1):
            seen.setdefault(codes[k : k + n].tobytes(), set()).add(int(made[n][k]))
        assert len(made[n]) == len(codes) - n + 1 and all(len(x) == 1 for x in seen.values()) and len(set.union(*seen.values())) == len(seen)
    assert [len(x) for x in p6._grams(codes[:3], (1, 3, 4, 16)).values()] == [3, 1, 0, 0]


def test_texts_that_repeat_themselves():
    s = p6.Settings()
    text = "ab" * 12
    ix = p6.build([("q", text, None)], Simplifier({}), s)
    assert found_in(p6._codes("ab" * 3000), ix, s) == {0} and found_in(p6._codes("abc" * 3000), ix, s) == set()
    assert found_in(p6._codes("ab" * 10 + "c" + "ba" * 9 + "ccc" + "ab" * 12), ix, s) == {0}


def test_random_leaks_against_a_plain_search():
    rng = np.random.default_rng(1)
    simple = Simplifier({})
    alphabet = [chr(0x4E00 + k) for k in range(60)]
    texts = ["".join(rng.choice(alphabet, 40)) for _ in range(20)]
    ix = p6.build([(f"q{k}", t, None) for k, t in enumerate(texts)], simple, p6.Settings())
    for trial in range(200):
        k = int(rng.integers(20))
        edits = int(rng.integers(0, 6))
        chars = list(texts[k])
        for at in rng.choice(40, edits, replace=False):
            chars[at] = chr(0x5F00 + trial)
        codes = p6._codes("".join(rng.choice(alphabet, 30)) + "".join(chars) + "".join(rng.choice(alphabet, 30)))
        found = found_in(codes, ix, p6.Settings())
        assert (k in found) == (edits <= 2)


def test_short_questions_with_two_edits():
    rng = np.random.default_rng(4)
    s = p6.Settings()
    for size in range(6, 49, 3):
        for alphabet in ("abcdefghijklmnopqrstuvwxyz", "".join(chr(0x4E00 + k) for k in range(60))):
            text = "".join(rng.choice(list(alphabet), size))
            ix = p6.build([("q", text, None)], Simplifier({}), s)
            for a in range(size):
                b = (a + size // 3) % size
                codes = p6._codes("一丁" * 5 + "".join("" if k == a else "龘" if k == b else c for k, c in enumerate(text)) + "丁一" * 5)
                assert found_in(codes, ix, s) == {0}, (size, a, b)


def test_simplified_table(spark):
    table = simplified(spark)
    assert not table or (table["氣"] == "气" and "气" not in table)
