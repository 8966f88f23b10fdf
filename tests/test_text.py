import random
import time
from difflib import SequenceMatcher

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillmere.functions import text as tx
from quillmere.functions.text import python_tokens, python_truncate
from quillmere.operators import ocr
from quillmere.plans import catalogue


def one(spark, value, make):
    return spark.createDataFrame([(value,)], "t string").select(make(F.col("t")).alias("r")).first()["r"]


def test_tokens_of_python_and_sql_agree(spark):
    texts = ["", "黄芪补气健脾", "abcdefghi 12g", "，。！", "Größe œuvre", "a1b2c3d4e5", "混合 mixed 文本。", None, "👍好"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", tx.count_tokens("t").alias("n")).collect()
    assert [r["n"] for r in got] == [None if t is None else python_tokens(t) for t in texts]
    assert python_tokens("黄芪补气健") == 5 and python_tokens("") == 0


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab1 中文，。é\n", max_size=40), st.integers(0, 20))
def test_truncated_is_the_longest_prefix(text, n):
    cut = python_truncate(text, n)
    assert text.startswith(cut) and python_tokens(cut) <= n
    assert cut == text or python_tokens(text[: len(cut) + 1]) > n


def test_sentences_paragraphs_and_parts(spark):
    assert one(spark, "一。二！三？四；末\nlast.", tx.split_sentences) == ["一。", "二！", "三？", "四；", "末", "last."]
    assert one(spark, "a\n\n b \nc", tx.split_paragraphs) == ["a", "b", "c"]
    assert one(spark, "〈书·章〉\n黄芪补气健脾。短。甘草调和诸药。", tx.evidence_sentences) == ["黄芪补气健脾。", "甘草调和诸药。"]
    assert one(spark, "〔1〕黄芪能够补气固表。短句。", tx.claims) == ["黄芪能够补气固表"]
    assert one(spark, None, tx.split_sentences) is None
    assert one(spark, "", tx.split_sentences) == []


def test_normalize_counts_and_narrows(spark):
    got = one(spark, "黄 芪　补□气ＡＢ１\n\n\n\n完\x01", tx.normalize)
    assert (got["text"], got["n_space"], got["n_garbage"]) == ("黄芪补气AB1\n\n完", 2, 1)


def test_noise_score(spark):
    assert one(spark, "", tx.noise_score) == 0.0
    assert one(spark, None, tx.noise_score) is None
    assert one(spark, "黄芪补气", tx.noise_score) == 0.0
    assert one(spark, "黄□芪", tx.noise_score) == 0.3333


def test_bigrams_and_jaccard(spark):
    assert one(spark, "a b c", tx.bigrams) == ["ab", "bc"]
    assert one(spark, "a", tx.bigrams) == [] and one(spark, "a", tx.statement_bigrams) == ["a"]
    assert one(spark, "\U00020000甲乙", tx.bigrams) == ["\U00020000甲", "甲乙"]
    pair = spark.createDataFrame([("abc", "abd"), ("", "ab")], "a string, b string")
    assert [r[0] for r in pair.select(tx.jaccard(tx.bigrams("a"), tx.bigrams("b"))).collect()] == [1 / 3, 0.0]


def test_search_tokens(spark):
    assert one(spark, "黄芪汤 Astragalus 12 的", tx.tokens) == ["黄芪", "芪汤", "astragalus", "12"]


def test_numbers_json_and_accuracy(spark):
    values = {"三": 3.0, "半": 0.5, "十二": 12.0, "2.5": 2.5, "二十": None, "克": None}
    for word, value in values.items():
        assert one(spark, word, tx.chinese_number) == value
    assert one(spark, 'x ```json\n{"a": 1}``` y', lambda c: tx.repaired_json(c, "a int"))["a"] == 1
    assert one(spark, "nothing", lambda c: tx.repaired_json(c, "a int")) is None
    assert one(spark, "黄芪补气", lambda c: tx.char_accuracy(c, c)) == 1.0


def test_matching_ratio_is_that_of_difflib_in_less_time():
    r = random.Random(3)
    for letters in ("甲", "甲乙", "甲乙丙abc", "甲乙丙丁戊己庚辛壬癸子丑寅卯"):
        for _ in range(150):
            a = "".join(r.choice(letters) for _ in range(r.randrange(90))) * r.choice([1, 1, 3])
            b = "".join("" if (x := r.random()) < 0.03 else c * 2 if x < 0.06 else r.choice(letters) if x < 0.1 else c for c in a)
            for x, y in ((a, b), (b[len(b) // 2 :] + b[: len(b) // 2], a), (a, b[::-1])):
                assert tx.matching_ratio(x, y) == SequenceMatcher(None, x, y, autojunk=False).ratio()
    a = "".join(chr(0x4E00 + int(200 * r.random() ** 2)) for _ in range(3000))
    b = "".join(c * 2 if r.random() < 0.05 else c for c in a)[:3000]
    begun = time.process_time()
    fast = tx.matching_ratio(a, b)
    between = time.process_time()
    assert fast == SequenceMatcher(None, a, b, autojunk=False).ratio() and between - begun < (time.process_time() - between) / 3


def test_ratios_of_many_texts_at_once_are_those_of_difflib(monkeypatch):
    monkeypatch.setattr(tx, "TOGETHER", 700)
    r = random.Random(5)
    words = ["".join(r.choice("甲乙丙丁戊己庚abc😀") for _ in range(r.randrange(2, 14))) for _ in range(40)]
    pairs = [("", ""), ("", "甲"), ("甲", ""), ("甲" * 300, "甲" * 290), ("甲乙", "乙甲"), ("\ud800甲乙丙丁戊己庚辛", "甲乙丙丁戊己庚辛")]
    for n in range(300):
        a = "".join(r.choice(words) for _ in range(r.randrange(1, 30)))
        b = "".join("" if (x := r.random()) < 0.01 else c * 2 if x < 0.04 else r.choice("子丑 ") if x < 0.07 else c for c in a)
        # Parts that change places, stand twice or stem from another text.
        pairs.append((a, (b, b[len(b) // 3 :] + b[: len(b) // 3], b + b[:40], pairs[-1][1])[n % 4]))
    assert tx.matching_ratios(pairs) == [SequenceMatcher(None, a, b, autojunk=False).ratio() for a, b in pairs]


def test_long_texts_that_repeat_themselves_are_compared_in_time():
    r = random.Random(7)
    line = "".join(r.choice("甲乙丙丁戊己庚辛") for _ in range(30))
    for a in (line * 30, "甲" * 700, ("甲" * 8 + "乙") * 80, "".join(r.choice("甲乙") for _ in range(700))):
        b = "".join("" if (x := r.random()) < 0.03 else c * 2 if x < 0.06 else "丙" if x < 0.08 else c for c in a)
        for x, y in ((a, b), (b[300:] + b[:300], a)):
            want, got, todo = SequenceMatcher(None, x, y, autojunk=False), 0, [(x, y)]
            assert tx.matching_ratio(x, y) == want.ratio()
            # Cutting at the longest blocks alone gives the same.
            while todo:
                found, parts = tx._by_longest(*todo.pop())
                got, todo = got + found, todo + parts
            assert got == sum(m.size for m in want.get_matching_blocks())
    a = line * 1500
    begun = time.process_time()
    assert tx.matching_ratio(a, a[:-9] + "丙" + a[-9:]) > 0.99 and time.process_time() - begun < 10


def test_corruption_is_measured_on_whole_texts(spark, tmp_path):
    r = random.Random(9)
    text = "".join(r.choice("已己未末土士日曰风凤\n") + chr(0x4E00 + r.randrange(900)) for _ in range(4000))
    spark.createDataFrame([("d", text, "qa")], "doc_id string, text string, source_type string").write.parquet(f"{tmp_path}/source_documents.parquet")
    (got,) = catalogue.queries()["t31_corruption"](spark, str(tmp_path)).collect()
    noisy = ocr.corrupt(spark.createDataFrame([("d", text)], "doc_id string, text string"))
    bare = [tx.python_squeeze(t) for t in noisy.select("text", "corrupted", tx.normalize("corrupted")["text"]).first()]
    for n, name in ((1, "raw_accuracy"), (2, "clean_accuracy")):
        assert abs(got[name] - SequenceMatcher(None, bare[0], bare[n], autojunk=False).ratio()) < 1e-4
    # A partition holds few texts, however many there are.
    many = spark.range(9000).selectExpr("cast(id as string) doc_id", "'甲乙' text", "'qa' source_type")
    many.union(many.limit(50)).repartition(2).write.parquet(f"{tmp_path}/many/source_documents.parquet")
    found = catalogue.queries()["t31_corruption"](spark, f"{tmp_path}/many")
    assert "RepartitionByExpression [doc_id" in (plan := found._jdf.queryExecution().optimizedPlan().toString()) and ", 5" in plan.split("RepartitionByExpression", 1)[1].split("\n")[0]
    # Only the end of these texts differs.
    a, b = text + "甲" * 2000, text + "乙" * 2000
    assert spark.createDataFrame([(a, b)], "a string, b string").select(tx.char_accuracy("a", "b")).first()[0] == tx.matching_ratio(tx.python_squeeze(a), tx.python_squeeze(b)) < 0.85


def test_white_space_is_the_same_in_python(spark):
    text = "".join(f"{chr(c)}x" for c in [*range(1, 0x300), *range(0x1670, 0x1690), *range(0x1FF0, 0x2070), *range(0x2FF0, 0x3010), 0xFEFF])
    assert one(spark, text, tx.squeeze) == tx.python_squeeze(text) and one(spark, "甲 \u3000\n乙", tx.squeeze) == tx.python_squeeze("甲 \u3000\n乙") == "甲乙"
