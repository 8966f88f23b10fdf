"""Problem 1: texts that look the same but differ in their characters.

Method: compatibility normalisation in composed form, full case folding, mapped white space
and removal of default-ignorable characters, computed once per distinct value of a batch.

Two forms of a text are made:

``look``  keeps letter case. Two texts with equal ``look`` cannot be told apart by a reader.
``form``  is ``look`` after full case folding; the form in which texts are compared and joined.

Raised, lowered and circled characters stay what they are: a reader sees them as different.
A null text has null forms; an empty text has the empty form.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmere.session import cut

# Code points that Unicode calls default-ignorable, as a regex class.
IGNORABLE = (
    "­͏؜ᅟᅠ឴឵᠋-᠏​-‏‪-‮⁠-⁯ㅤ"
    "︀-️﻿ﾠ￰-￸\U0001bca0-\U0001bca3\U0001d173-\U0001d17a\U000e0000-\U000e0fff"
)

# Letters of other scripts that are drawn like a Latin letter.
CYRILLIC = ("АВЕЅІЈКМНОРСТХУԌԚԜаеѕіјорсухһԁԛԝѵ", "ABESIJKMHOPCTXYGQWaesijopcyxhdqwv")
GREEK = ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹοϲϳνι", "ABEZHIKMNOPTYXCocjvi")
CHEROKEE = ("ᎪᏴᏟᎠᎬᎻᎫᏦᏞᎷᏢᏒᏚᎢᏙᏔᏃ", "ABCDEHJKLMPRSTVWZ")
CHEROKEE_R = ("Ꭱ", "R")
COPTIC = ("ⲎⲒⲔⲘⲚⲞⲢⲤⲦⲬⲟⲣⲥ", "HIKMNOPCTXopc")
ARMENIAN = ("ՍՏՕսոհցզօ", "USOunhgqo")

# Radicals that have no compatibility mapping, and the character drawn the same.
RADICALS = ("⺠⻁⻄⻅⻆⻉⻋⻌⻓⻔⻘⻙⻚⻛⻜⻝⻢⻥⻦⻨⻩⻬⻮⻰", "民虎西见角贝车辶长门青韦页风飞食马鱼鸟麦黄齐齿龙")

LOOKALIKE = {ord(a): b for left, right in (CYRILLIC, GREEK, CHEROKEE, CHEROKEE_R, COPTIC, ARMENIAN, RADICALS) for a, b in zip(left, right, strict=True)}

#: Compatibility mappings of these kinds change what a reader sees.
SEEN_KINDS = {"<super>", "<sub>", "<circle>", "<square>", "<fraction>"}
#: ... but square and fraction signs that are mere spellings of a unit keep their mapping.
KEPT_UNSEEN = {"℃", "℉"}


def _seen() -> dict[str, str]:
    """Characters that keep their shape, each with a private-use stand-in."""
    found = [c for c in map(chr, range(0x80, 0x20000)) if unicodedata.decomposition(c).partition(" ")[0] in SEEN_KINDS and c not in KEPT_UNSEEN]
    return {c: chr(0xF0000 + k) for k, c in enumerate(found)}


def _ranges(chars: list[str]) -> str:
    """A regex class body in which neighbouring code points are one range; the engine scans it far faster."""
    spans: list[list[int]] = []
    for c in sorted(map(ord, chars)):
        if spans and c == spans[-1][1] + 1:
            spans[-1][1] = c
        else:
            spans.append([c, c])
    return "".join(f"{chr(a)}-{chr(b)}" for a, b in spans)


SEEN = _seen()
_BACK = {ord(v): k for k, v in SEEN.items()}
_IGN = re.compile(f"[{IGNORABLE}]")
_SEEN = re.compile("[" + _ranges(list(SEEN)) + "]")
_STAND_IN = re.compile("[\U000f0000-\U000fffff]")
_ALIKE = re.compile("[" + "".join(re.escape(chr(c)) for c in LOOKALIKE) + "]")
_SPACE = re.compile(r"[^\S\n ]")
_TRAIL = re.compile(r" +(?=\n|\Z)")
_BREAK = re.compile(r"\r\n?| | |\x85")


def look_of(text: str) -> str:
    """The consistent form of one text with its letter case kept."""
    return _TRAIL.sub("", look_with_spaces(text))


def look_with_spaces(text: str) -> str:
    """As look_of, with the spaces at line ends kept."""
    if text.isascii():
        text = _BREAK.sub("\n", text) if "\r" in text else text
        return _SPACE.sub(" ", text)
    text = _BREAK.sub("\n", _IGN.sub("", text))
    text, hidden = _SEEN.subn(lambda m: SEEN[m[0]], text)
    text = unicodedata.normalize("NFKD", text)
    text = _ALIKE.sub(lambda m: LOOKALIKE[ord(m[0])], text)
    text = unicodedata.normalize("NFC", _IGN.sub("", text))
    if hidden:
        text = _STAND_IN.sub(lambda m: _BACK.get(ord(m[0]), m[0]), text)
    return _SPACE.sub(" ", text)


def form_of(look: str) -> str:
    """Full case folding, composed again."""
    return look.lower() if look.isascii() else unicodedata.normalize("NFC", look.casefold())


def _per_value(values: pd.Series, make) -> pd.Series:
    """Applies make once per distinct value; nulls stay null."""
    codes, distinct = pd.factorize(values, use_na_sentinel=True)
    made = [make(v) for v in distinct] + [None]
    return pd.Series([made[c] for c in codes], index=values.index, dtype=object)


def unify(df: DataFrame, column: str = "text", out: str = "form", fold: bool = True) -> DataFrame:
    """Adds the consistent form of a text column; an existing column of that name is replaced.

    Nulls stay null, empty texts stay empty, rows and other columns are untouched.
    """

    @F.pandas_udf("string")
    def made(values: pd.Series) -> pd.Series:
        return _per_value(values, (lambda v: form_of(look_of(v))) if fold else look_of)

    return df.withColumn(out, made(F.col(column)))


def _hashes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    def three(text: str) -> tuple[bytes, bytes, bytes] | None:
        look = look_of(text)
        if not look.strip():
            return None
        digest = lambda s: xxhash.xxh3_128_digest(s.encode("utf-8", "surrogatepass"))
        return digest(form_of(look)), digest(look), digest(text)

    for batch in batches:
        made = _per_value(batch["text"], three)
        kept = made.notna().to_numpy()
        rows = list(made[kept])
        yield pd.DataFrame({
            "record_table": batch["record_table"].to_numpy()[kept],
            "key": batch["key"].to_numpy()[kept],
            "form_id": [r[0] for r in rows],
            "look_id": [r[1] for r in rows],
            "text_id": [r[2] for r in rows],
        })


#: Records of one text that a task pairs with others at once.
PART = 2000


def _ids(records: DataFrame) -> DataFrame:
    """record_table, key and the hashes of form, look and text of each record; distinct."""
    given = records.select("record_table", F.col("key").cast("string").alias("key"), F.col("text").cast("string").alias("text"))
    given = given.where("record_table is not null and key is not null and text is not null")
    return cut(given.mapInPandas(_hashes, "record_table string, key string, form_id binary, look_id binary, text_id binary").distinct())


def classes(records: DataFrame) -> DataFrame:
    """record_table, key, class_id, look_id, text_id, variants, links: one row per record and text.

    records: record_table, key, text. A class holds the records whose forms, so after case
    folding, are equal. variants is the number of different texts that look like this one, itself
    included; links is the number of keys whose text looks the same but has other characters. Null and
    blank texts and null keys have no row; repeated rows give one.
    """
    ids = _ids(records)
    look, text = ["record_table", "form_id", "look_id"], ["record_table", "form_id", "look_id", "text_id"]
    # Counted by text first, so that a text with very many copies is one row when its look is summed up.
    of_text = ids.groupBy(*text).agg(F.count("*").alias("copies"))
    of_look = of_text.groupBy(*look).agg(F.count("*").alias("variants"), F.sum("copies").alias("alike"))
    per_text = of_text.join(of_look, look).withColumn("links", F.col("alike") - F.col("copies"))
    return (
        ids.join(per_text, text)
        .select("record_table", "key", F.hex("form_id").alias("class_id"), F.hex("look_id").alias("look_id"), F.hex("text_id").alias("text_id"), "variants", "links")
    )


def same_look_pairs(records: DataFrame) -> DataFrame:
    """Pairs of keys whose whole texts look the same without being the same characters.

    records: record_table, key, text. Only hashes of texts are shuffled. Pairs are formed within
    the classes of equal form; there the exact check on the look keeps letter case, which a
    reader sees, apart. Different texts are paired first, then their records, so that copies never
    meet copies; the records of a text with many are parted, and each part is another task's.
    Null and blank texts and null keys belong to no pair; repeated rows give one pair; a key
    that comes with two texts is compared by each of them.
    """
    ids = _ids(records)
    same = ["record_table", "form_id", "look_id"]
    mixed = ids.groupBy(*same).agg(F.min("text_id").alias("lo"), F.max("text_id").alias("hi")).where("lo <> hi").select(*same)
    ids = cut(ids.join(mixed, same, "left_semi"))
    texts = ids.groupBy(*same, "text_id").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"))
    side = lambda k: texts.select(*same, F.col("text_id").alias(f"id_{k}"), F.col("parts").alias(f"parts_{k}"))
    variants = side(1).join(side(2), same).where("id_1 < id_2").select("record_table", "id_1", "id_2", "parts_1", "parts_2")
    # One row for each pair of parts; nearly all texts have one part.
    variants = variants.withColumn("part_1", F.explode(F.sequence(F.lit(0), F.col("parts_1") - 1))).withColumn("part_2", F.explode(F.sequence(F.lit(0), F.col("parts_2") - 1)))
    members = ids.join(texts.select("record_table", "text_id", "parts"), ["record_table", "text_id"]).select("record_table", "text_id", "key", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int").alias("part"))
    member = lambda k: members.select("record_table", F.col("text_id").alias(f"id_{k}"), F.col("part").alias(f"part_{k}"), F.col("key").alias(f"key_{k}"))
    return (
        variants.select("record_table", "id_1", "id_2", "part_1", "part_2")
        .join(member(1), ["record_table", "id_1", "part_1"])
        .join(member(2), ["record_table", "id_2", "part_2"])
        .where("key_1 <> key_2")
        .select("record_table", F.least("key_1", "key_2").alias("key_a"), F.greatest("key_1", "key_2").alias("key_b"))
        .distinct()
    )
