import numpy as np
from pyspark.sql import functions as F

from quillmere.llm import p3_pairs as p3
from quillmere.llm import p4_pages as p4
from quillmere.llm.language import language
from quillmere.llm.scripts import Simplifier


def test_languages():
    texts = {"zh": "黄芪补气固表，常用于气虚证。", "ja": "白雁丸は頭痛に用いられる。", "ko": "왜 두통이 다시 생길까요?", "en": "The tea is brown and sweet.", "de": "Wer an Husten leidet, sollte früh schlafen!", "fr": "Il faut cesser dès que la toux disparaît !", "vi": "Vì sao đau đầu lại tái phát?", "th": "ควรดื่มน้ำอุ่นก่อนนอน", "hi": "चक्कर होने पर गुनगुना पानी पिएँ।", "ar": "هل يزداد الأرق ليلا؟"}
    for lang, text in texts.items():
        assert language(text) == lang, text
    assert language(None) is None and language("…") is None
    # Names in Latin letters, with tone marks, don't make a text another language.
    assert language("可以。荷铃芝（Cortex sylbifera, zǐ lù gēn）与 Radix velmophylla 均可。") == "zh"
    assert language("他说 the tea is brown and it should be taken with warm water in the morning") == "en"


def test_parser():
    assert p3.parsed("（1）取黄芪，（2）煎煮。") is None
    assert p3.parsed("具体做法：（1）取黄芪，（2）") == "list"
    assert p3.parsed("```\ncode") == "```" and p3.parsed("```\n(```") is None
    assert p3.parsed("他说“黄芪") == "“" and p3.parsed("<b>黄芪") == "<b" and p3.parsed("<b>黄芪</b><br>") is None and p3.parsed("黄芪<di") == "markup"
    assert p3.parsed("") is None
    # Open constructs count though a mark ends the text; straight quotation marks are parsed, marks of inches aren't.
    assert p3.parsed("见（黄芪。") == "（" and p3.parsed('他说"黄芪。') == '"' and p3.parsed('他说"黄芪"。') is None and p3.parsed('长 5" 左右。') is None
    assert p3.parsed("<b>黄<i>芪</i>") == "<b" and p3.parsed("<p>黄芪<br/>甘草") is None and p3.parsed("a < b, c > d.") is None
    assert p3.parsed("<" * 100_000) is None


def test_tiling_covers_what_is_common():
    assert p3.tiled("abcdef", "abcdef", 3) == 6 and p3.tiled("abcdef", "defabc", 3) == 6 and p3.tiled("abc", "xyz", 3) == 0 and p3.tiled("", "abc", 3) == 0


def test_defects(spark):
    full = ["若伴咳嗽，可酌加黄芪。", "需要注意的是，服用黄芪汤时不要与甘草同用，因为二者会加重咳嗽，尤其是睡前。"]
    rows = [(k, "咳嗽怎么办？", full[0] + full[1]) for k in range(30)]
    cases = {
        100: ("咳嗽怎么办？", None, "empty"), 101: ("咳嗽怎么办？", "（略）", "empty"), 102: ("咳嗽怎么办？", " <br>​", "empty"), 103: ("咳嗽怎么办？", "答：咳嗽怎么办", "copy"), 104: ("孩子咳嗽快7周了，用黄芪汤行不行？", "孩子咳嗽快７周了 用黄芪汤行不行！", "copy"),
        105: ("咳嗽怎么办？", "很抱歉，我无法就咳嗽给出用药建议。祝您早日康复！", "refusal"), 106: ("咳嗽怎么办？", "我无法当面诊脉，仅供参考：" + full[0], None), 107: ("咳嗽怎么办？", "Wer an Husten leidet, sollte früh schlafen!", "language"), 108: ("黄芪用英文怎么介绍？请用英文回答。", "The tea is a common choice for a dry cough.", None),
        109: (None, "可以，但不要超过三天。", None), 110: ("咳嗽怎么办？", "需要注意的是，服用黄芪汤时不要与", "truncated"), 111: ("咳嗽怎么办？", "若伴咳嗽，可酌加黄芪", None), 112: ("咳嗽怎么办？", "需要注意的是，服用黄芪汤时不要与甘草同用，因为…", "truncated"), 113: ("咳嗽怎么办？", "不行。", None), 114: ("", "", "empty"),
        115: ("咳嗽怎么办？", "咳嗽怎么办？" * 9, "copy"), 116: ("咳嗽怎么办？", "咳嗽怎么办？" + full[0] * 9, None), 117: ("咳嗽怎么办？", "<b>" + full[0] + "<i>" + full[0] + "</i>", "truncated"), 118: ("咳嗽怎么办？", "可以。甘草（Radix sylbifera, lǜ què yè）与 Radix velmo 均可。", None),
    }
    rows += [(k, q, a) for k, (q, a, _) in cases.items()] + [(100, "咳嗽怎么办？", None)]
    df = spark.createDataFrame(rows, "id long, question string, answer string").withColumn("defect", F.lit("?")).repartition(3)
    lexicon = spark.createDataFrame([("黄芪", "herb"), ("甘草", "herb"), ("黄芪汤", "formula"), ("咳嗽", "symptom"), (None, "x")], "term string, type string")
    got = [(r["id"], r["defect"]) for r in p3.defects(df, lexicon).collect()]
    assert dict(got) == {k: d for k, (_, _, d) in cases.items() if d} and len(got) == len(dict(got))
    assert p3.defects(df.limit(0), lexicon).count() == 0
    assert p3.defects(df.where("id < 0"), None).count() == 0


def vocabulary():
    import numpy as np

    words = {w: 500 for w in "decoctions based on pattern digestive function concentration dependent radix cortex should the of and".split()}
    return p4.Vocabulary(words, frozenset({"医案"}), (np.empty(0, np.int64),) * 2, (np.empty(0, np.int64),) * 2, 25.0, 5.0, Simplifier({}))


def test_trie_finds_all_within_one_edit():
    import random

    rng = random.Random(2)
    words = {"".join(rng.choice("abc") for _ in range(rng.randint(1, 5))): 1 for _ in range(80)}

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            before, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
        return row[-1]

    trie = p4.Trie(words)
    for _ in range(200):
        q = "".join(rng.choice("abc") for _ in range(rng.randint(0, 6)))
        near = trie.near(q)
        assert sorted(near) == sorted(w for w in words if distance(q, w) <= 1)
        assert all(alone == (w == q) for w, alone in near.items())
        # Groups as read and as meant: one place, or two if nothing else is changed.
        groups = [("ac", "b"), ("b", "ca")]
        one = {q[:i] + good + q[i + len(bad) :] for bad, good in groups for i in range(len(q)) if q.startswith(bad, i)}
        found = trie.near(q, groups)
        assert set(near) <= set(found) and one & set(words) <= {w for w, alone in found.items() if alone}


def test_furniture():
    v = frozenset({"医案"})
    for line in ("[162]", "- 12 -", "p. 53", "Page 7", "第12页", "〔第3页〕", "iv", "·62·", "1 6", "三"):
        assert p4.furniture(line, "题目", v) == {"page_number"}, line
    assert p4.furniture("NOTES ON TEA", "Notes on tea", v) == {"running_head"} and p4.furniture("医案", "题目", v) == {"running_head"}
    assert p4.furniture("13□    胃劳病论治", "胃劳病论治", v) == {"running_head", "page_number"} and p4.furniture("胃劳病论治 · 总论    133", "胃劳病论治", v) == {"running_head", "page_number"}
    for line in ("# 胃劳病论治", "胃劳病论治之要在于调中。", "", "1. 取黄芪九克。", "2.5克。"):
        assert p4.furniture(line, "胃劳病论治", v) == frozenset(), line


def test_repair():
    v = vocabulary()
    page = "NOTES ON TEA\nDecoctions based on the digest-\np. 5\nNOTES ON TEA\nive funct!on and the concentration-\ndependent pattem should\nthe of and.\n"
    done = p4.repair(page, "Notes on tea", v)
    assert done.kinds == {"broken_word", "misread", "running_head", "page_number"}
    assert done.text == "Decoctions based on the digestive function and the concentration-dependent pattern should the of and."
    clean = p4.repair("Decoctions based on the pattern.", "Notes on tea", v)
    assert clean.kinds == frozenset() and clean.text == "Decoctions based on the pattern."
    assert p4.repair("", None, v).text == "" and p4.repair("黄◆芪", None, v).text == "黄芪"
    chunk = p4.repair("〈题目 > 一〉\n题目\n黄芪", None, v, is_chunk=True)
    assert chunk.kinds == {"running_head"} and chunk.text == "〈题目 > 一〉\n黄芪"


def test_misread_characters_and_tables(spark):
    body = "临床观察显示，胃阴虚证患者服用黄芪汤后食少减轻。"
    clean = [(f"d{k}", "题", body * 3, "textbook") for k in range(40)]
    noisy = [("n1", "题", body.replace("虚", "虐") + "\n第3页\n" + body, "ocr_scan"), ("n2", None, None, "pdf"), ("n3", "题", "", "pdf"), ("n4", "题", body, "pdf"), ("n4", "题", body, "pdf")]
    docs = spark.createDataFrame(clean + noisy, "doc_id string, title string, text string, source_type string")
    pages = docs.where("source_type <> 'textbook'").select(F.lit("source_documents").alias("record_table"), F.col("doc_id").alias("record_key"), "title", "text", F.lit(False).alias("is_chunk"))
    got = {(r["record_key"], r["noise_kind"]) for r in p4.kinds_found(pages, docs).collect()}
    assert got == {("n1", "misread"), ("n1", "page_number")}
    text = {r["record_key"]: r["repaired"] for r in p4.repaired(pages, docs).collect()}
    assert text["n1"] == body * 2 and text["n3"] == "" and set(text) == {"n1", "n3", "n4"}
    assert p4.kinds_found(pages.limit(0), docs.limit(0)).count() == 0


def small_vocabulary(words, pairs=None, triples=None):
    arrays = lambda d: (np.array(sorted(d), np.int64), np.array([d[k] for k in sorted(d)], np.int64))
    return p4.Vocabulary(words, frozenset(), arrays(pairs or {}), arrays(triples or {}), 25.0, 5.0, Simplifier({}))


def test_unknown_words_are_looked_for_in_the_trie():
    v = small_vocabulary({"liver": 400, "although": 300, "processing": 300, "growers": 300, "herb": 5000, "local": 300, "kidney": 300})
    assert [v.correct_word(w) for w in ("llver", "althaugh", "procxssing", "procssing", "kldnoy")] == ["liver", "although", "processing", "processing", None]
    # Forms of a word, parts of one, and other words aren't misreadings.
    assert [v.correct_word(w) for w in ("herbs", "rowers", "vocal", "liver")] == [None] * 4


def test_counts_are_judged_alike_at_every_size():
    han = lambda s: p4._sequence_codes(s)
    a, b, good, bad = (int(han(x)[0]) for x in "气证虚虐")
    for size in (1, 1000):
        pairs = {a << 21 | good: 100 * size, good << 21 | b: 100 * size, a << 21 | bad: 4 * size, bad << 21 | b: 4 * size}
        v = small_vocabulary({"modern": 100 * size, "modem": 3 * size}, pairs, {a << 42 | b << 21 | good: 100 * size, a << 42 | b << 21 | bad: 4 * size})
        assert v.correct_characters(han("气虐证")) == [(1, good)], size
        assert p4.repair("A modem garden.", None, v).kinds == {"misread"}, size


def test_the_whole_text_is_looked_at():
    a, b, good, bad = (int(p4._sequence_codes(x)[0]) for x in "气证虚虐")
    pairs = {a << 21 | good: 100, good << 21 | b: 100}
    v = small_vocabulary({}, pairs, {a << 42 | b << 21 | good: 100})
    english = "The tea is brown and sweet. " * 20
    done = p4.repair(english + "\n\n气虐证", None, v)
    assert done.kinds == {"misread"} and done.text.endswith("气虚证")
    assert "cold hands" in p4.repair("黄芪补气固表常用。" * 50 + "\n\n" + "This is for cold\nhands and feet.", None, v).text
    assert "常用于气虚" in p4.repair(english + "\n\n黄芪补气固表常用\n于气虚的人。", None, v).text


def test_words_with_several_wrong_groups():
    v = small_vocabulary({"decoction": 400, "pattern": 400, "concentration": 400})
    assert [v.correct_word(w) for w in ("pattexn", "decoctlon", "patterm", "dccoct1on", "c0ncentrati0n")] == ["pattern", "decoction", "pattern", "decoction", "concentration"]


def test_confusions_come_from_the_corpus(spark):
    others = "甲乙丙丁戊己庚辛壬癸子丑寅卯辰巳午未申酉戌亥天地玄黄宇宙洪荒"
    texts = [f"{a}虚{b}。" * 60 for a, b in zip(others[::2], others[1::2], strict=True)]
    texts += [f"{a}虐{b}。" for a, b in zip(others[::2], others[1::2], strict=True)][:9]
    texts += [f"{others[0]}{c}{others[1]}。{others[2]}{c}{others[3]}。" for c in "春夏秋冬"]
    # Other characters that stand for others elsewhere, so that chance can be told.
    texts += [f"{a}之{b}。" * 60 + f"{a}{c}{b}。" for k, (a, b) in enumerate(zip("东南西北金木水火土日", "一二三四五六七八九十", strict=True)) for c in "赤橙绿青蓝紫"[k % 3 :: 2]]
    docs = spark.createDataFrame([("题", t) for t in texts], "title string, text string")
    v = p4.vocabulary(docs, p4.Settings(lift=2.0))
    assert {(chr(int(k) >> 21), chr(int(k) & (1 << 21) - 1)) for k in v.confused} == {("虚", "虐")} | {(a, b) for a, b in {(chr(int(k) >> 21), chr(int(k) & (1 << 21) - 1)) for k in v.confused} if a == "之"}
    assert len(p4.vocabulary(docs.limit(0), p4.Settings()).confused) == 0
    # The same, but what stands for the other does so in ordinary texts too: that is writing, not misreading.
    pages = docs.withColumn("source_type", F.when(F.contains("text", F.lit("虐")), "ocr_scan").otherwise("classic"))
    pair = ord("虚") << 21 | ord("虐")
    assert pair in p4.vocabulary(pages, p4.Settings(lift=2.0)).confused
    assert pair not in p4.vocabulary(pages.withColumn("source_type", F.when(F.contains("text", F.lit("之")), "pdf").otherwise("classic")), p4.Settings(lift=2.0)).confused


def test_grammar_of_declining():
    yes = ["此问题不在服务范围内。", "这类问题恕难作答，还请另询医师。", "我没有办法帮您判断，换个问题吧。", "平台方面已关闭此类问答。网络咨询不能代替面诊。", "作为一个助手，我不具备诊断的资格，因此不便回答。", "I'm sorry, but I can't help with that. Please consult a professional.", "This question cannot be answered."]
    no = ["黄芪补气。", "我无法当面诊脉，可用黄芪9克煎服。", "不能确定，不过可先观察。此问题不便回答。", "抱歉。", "", "谢谢您的咨询。", "无法回答。黄芪补气固表。", "In general, I can't recommend more than 3 g."]
    assert [p3.is_refusal(a) for a in yes] == [True] * len(yes)
    assert [p3.is_refusal(a) for a in no] == [False] * len(no)


def test_very_long_words():
    import time

    begun = time.perf_counter()
    done = p4.repair("x" * 300_000 + " digest-\nive", None, vocabulary())
    assert done.kinds == {"broken_word"} and time.perf_counter() - begun < 20
