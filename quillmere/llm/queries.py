"""The queries of problems 1 to 8. Each takes a session and the folder of the tables."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmere.llm import data, p1_unify, p2_neighbours, p3_pairs, p4_pages, p5_sentences, p6_leaks, p7_mix, p8_level
from quillmere.session import table


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return p1_unify.same_look_pairs(data.records(spark, folder))


def p1_classes(spark: SparkSession, folder: str) -> DataFrame:
    """Every record with its class, and how many records look like it in other characters."""
    return p1_unify.classes(data.records(spark, folder))


def p1_unified(spark: SparkSession, folder: str) -> DataFrame:
    """Every record with the consistent form of its text."""
    return p1_unify.unify(data.records(spark, folder).distinct(), "text", "form").select("record_table", F.col("key").alias("record_key"), "form")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return p2_neighbours.pairs(p2_neighbours.neighbours(table(spark, folder, "memories")))


def p2_neighbours_of_each(spark: SparkSession, folder: str) -> DataFrame:
    """The five nearest records of every record, with rank and cosine."""
    found = p2_neighbours.neighbours(table(spark, folder, "memories"))
    return found.withColumns({"rank": F.col("rank").cast("long"), "cosine": F.round("cosine", 6)})


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return p3_pairs.defects(table(spark, folder, "build_corpus"), table(spark, folder, "lexicon"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return p4_pages.kinds_found(data.page_texts(spark, folder), table(spark, folder, "source_documents"))


def p4_repaired(spark: SparkSession, folder: str) -> DataFrame:
    """Continuous paragraphs of every page text."""
    return p4_pages.repaired(data.page_texts(spark, folder), table(spark, folder, "source_documents"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return p5_sentences.sentences(data.clean_texts(spark, folder), ["record_table", "record_key"], "text", F.col("record_table") == "turns")


def p5_sentences_of_each(spark: SparkSession, folder: str) -> DataFrame:
    """The sentences themselves, in original characters."""
    return p5_sentences.sentence_texts(data.clean_texts(spark, folder), ["record_table", "record_key"], "text", F.col("record_table") == "turns")


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return p6_leaks.leaks(table(spark, folder, "documents"), table(spark, folder, "eval_items"))


def p7_selection(spark: SparkSession, folder: str) -> DataFrame:
    """How often each document is in each mix."""
    return p7_mix.mix(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))


def p7_report(spark: SparkSession, folder: str) -> DataFrame:
    """Target and actual share of each source in each mix."""
    return p7_mix.report(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return p8_level.levels(table(spark, folder, "documents"), table(spark, folder, "level_labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"p1_found": p1_found, "p1_classes": p1_classes, "p1_unified": p1_unified, "p2_found": p2_found, "p2_neighbours": p2_neighbours_of_each, "p3_found": p3_found, "p4_found": p4_found, "p4_repaired": p4_repaired, "p5_found": p5_found, "p5_sentences": p5_sentences_of_each, "p6_found": p6_found, "p7_mix": p7_selection, "p7_report": p7_report, "p8_found": p8_found}


#: Neighbours by comparing all vectors with each other, for the tables of tests.
ALL_NEIGHBOURS = """
WITH v AS (SELECT DISTINCT id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM memories WHERE id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) = 128
  AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
u AS (SELECT id, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS u FROM v),
k AS (SELECT a.id AS q, b.id AS n FROM u a JOIN u b ON a.id <> b.id QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY round(list_dot_product(a.u, b.u), 10) DESC, b.id) <= 5)
SELECT DISTINCT least(q, n) AS id_a, greatest(q, n) AS id_b FROM k"""


RANKED_NEIGHBOURS = ALL_NEIGHBOURS[: ALL_NEIGHBOURS.index("k AS (")] + """
k AS (SELECT a.id AS id, b.id AS neighbour, round(list_dot_product(a.u, b.u), 10) AS cosine FROM u a JOIN u b ON a.id <> b.id)
SELECT id, neighbour, row_number() OVER (PARTITION BY id ORDER BY cosine DESC, neighbour) AS rank, round(cosine, 6) AS cosine FROM k QUALIFY rank <= 5"""


def _same_look() -> str:
    """Pairs of records by one form of each text, made in SQL: characters are mapped by tables that
    follow from the character data of Unicode and from the look-alike letters, then composed."""
    seen = {"<super>", "<sub>", "<circle>", "<square>", "<fraction>"}
    alike = "АВЕЅІЈКМНОРСТХУԌԚԜаеѕіјорсухһԁԛԝѵΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹοϲϳνιⲎⲒⲔⲘⲚⲞⲢⲤⲦⲬⲟⲣⲥՍՏՕսոհցզօᎪᏴᏟᎠᎬᎻᎫᏦᏞᎷᏢᏒᏚᎢᏙᏔᏃᎡ⺠⻁⻄⻅⻆⻉⻋⻌⻓⻔⻘⻙⻚⻛⻜⻝⻢⻥⻦⻨⻩⻬⻮⻰"
    drawn = "ABESIJKMHOPCTXYGQWaesijopcyxhdqwvABEZHIKMNOPTYXCocjviHIKMNOPCTXopcUSOunhgqoABCDEHJKLMPRSTVWZR民虎西见角贝车辶长门青韦页风飞食马鱼鸟麦黄齐齿龙"
    letters = dict(zip(alike, drawn, strict=True))
    one, more = {}, {}
    for c in map(chr, [*range(0x80, 0xD800), *range(0xE000, 0x10000)]):
        if unicodedata.decomposition(c).partition(" ")[0] in seen and c not in "℃℉":
            continue
        made = unicodedata.normalize("NFC", "".join(letters.get(x, x) for x in unicodedata.normalize("NFKD", c)))
        if made != c and unicodedata.category(c) not in ("Zs", "Cf") and "'" not in made:
            (one if len(made) == 1 else more)[c] = made
    form = f"translate(text, '{''.join(one)}', '{''.join(one.values())}')"
    # Characters that stand for several: nested, for those that writing in these languages has.
    for c in "ﬀﬁﬂﬃﬄﬅﬆ…‥℃℉№㎎㎏㎜㎝㎞㏄ǆǉǌ":
        if c in more:
            form = f"replace({form}, '{c}', '{more[c]}')"
    ignored = r"[\x{00AD}\x{034F}\x{061C}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{180B}-\x{180F}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{206F}\x{3164}\x{FE00}-\x{FE0F}\x{FEFF}\x{FFA0}\x{FFF0}-\x{FFF8}\x{E0000}-\x{E0FFF}]"
    spaces = r"[\t\x{0B}\x{0C}\x{1C}-\x{1F}\x{A0}\x{1680}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}]"
    form = f"nfc_normalize(regexp_replace(regexp_replace({form}, '{ignored}', '', 'g'), '\\r\\n?|\\x{{2028}}|\\x{{2029}}|\\x{{85}}', chr(10), 'g'))"
    form = f"regexp_replace(regexp_replace({form}, '{spaces}', ' ', 'g'), ' +(\\n|$)', '\\1', 'g')"
    return f"""WITH r AS (SELECT DISTINCT 'source_documents' AS t, doc_id AS k, text FROM source_documents WHERE text IS NOT NULL AND doc_id IS NOT NULL UNION ALL SELECT DISTINCT 'chunks', chunk_id, text FROM chunks WHERE text IS NOT NULL AND chunk_id IS NOT NULL),
f AS (SELECT t, k, text, {form} AS f FROM r)
SELECT DISTINCT a.t AS record_table, a.k AS key_a, b.k AS key_b FROM f a JOIN f b ON a.t = b.t AND a.f = b.f AND a.k < b.k AND a.text <> b.text WHERE trim(a.f, ' ' || chr(10)) <> ''"""


def oracle_sql() -> dict[str, str]:
    return {"p1_found": _same_look(), "p2_found": ALL_NEIGHBOURS, "p2_neighbours": RANKED_NEIGHBOURS}
