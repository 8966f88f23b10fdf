"""Repair of misread characters against a lexicon, and the cleaning of noisy text."""

from __future__ import annotations

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmere.functions import text as tx

# Pairs of characters that are mistaken for each other, either way.
CONFUSABLE = (
    "己已 巳已 未末 日曰 土士 干千 入人 太大 玉王 自白 刀刃 天夫 贝见 戊戌 汨汩 草革 热熟 脾牌 风凤 灸炙 祟崇 盲肓 折拆 酒洒 治冶 令今 丸九 汤场 "
    "梗便 芍苍 茯伏 苓荃 芪杞 归旧 芎穹 冬东 仁仕 蜜密 桂挂 麻床 黄寅 连莲 翘翅 银垠 膏高 附付 乌鸟 梅悔 姜美 枣刺"
)
# Misread words that are mended whatever the lexicon says, in this order.
STATIC_FIXES = [
    ("甘革", "甘草"), ("寒熟", "寒热"), ("补牌", "补脾"), ("黄茂", "黄芪"), ("栓楼", "栝楼"), ("括楼", "栝楼"), ("桂枚", "桂枝"), ("伤塞", "伤寒"), ("温瘸", "温疟"), ("咳逆上乞", "咳逆上气"),
    ("五赃六腑", "五脏六腑"), ("心下痞便", "心下痞硬"), ("烦燥", "烦躁"), ("麻黄汤王", "麻黄汤主之"), ("银翹", "银翘"), ("伏苓", "茯苓"), ("灸甘草", "炙甘草"), ("栓蒌", "栝蒌"),
]


def confusables(spark) -> DataFrame:
    """char, other: both directions of each pair."""
    pairs = CONFUSABLE.split()
    return spark.createDataFrame([(p[0], p[1]) for p in pairs] + [(p[1], p[0]) for p in pairs], "char string, other string").distinct()


def variants(lexicon: DataFrame) -> DataFrame:
    """variant, term, place: each term with one character misread, unless that is a term itself.

    A variant of several terms goes to the longest, then the first in order; place gives the
    order in which variants are applied.
    """
    terms = lexicon.select("term").where("length(term) >= 2").distinct()
    chars = terms.select("term", F.posexplode(F.filter(F.split("term", ""), lambda x: x != "")).alias("at", "char"))
    made = chars.join(F.broadcast(confusables(lexicon.sparkSession)), "char").select(
        "term", "at", F.concat(F.substring(F.col("term"), F.lit(1), F.col("at")), F.col("other"), F.expr("substring(term, at + 2)")).alias("variant")
    )
    made = made.join(terms.select(F.col("term").alias("variant")), "variant", "left_anti")
    first = Window.partitionBy("variant").orderBy(F.desc(F.length("term")), "term", "at")
    one = made.withColumn("_r", F.row_number().over(first)).where("_r = 1")
    order = F.struct((-F.length("term")).alias("a"), F.col("term").alias("b"), F.col("at").alias("c"), F.col("variant").alias("d"))
    return one.select("variant", "term", order.alias("place"))


def fix_list(lexicon: DataFrame | None, limit: int = 20_000) -> list[tuple[str, str]]:
    """The fixes in the order in which they are applied; refused if there are too many to send around."""
    if lexicon is None:
        return list(STATIC_FIXES)
    rows = variants(lexicon).orderBy("place").limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} variants")
    return [*STATIC_FIXES, *((r["variant"], r["term"]) for r in rows)]


class Fixes:
    """Fixes in their order as one automaton; built once per Python worker, not shipped."""

    def __init__(self, fixes: list[tuple[str, str]]):
        self.fixes, self._tree = fixes, None

    def __getstate__(self):
        return self.fixes

    def __setstate__(self, fixes):
        self.fixes, self._tree = fixes, None

    def __call__(self, text: str) -> tuple[str, int, list[str]]:
        """The text with each fix made everywhere before a later one is looked for, how many there were, and which."""
        if self._tree is None:
            self._tree = ahocorasick.Automaton()
            for k, (bad, _) in reversed(list(enumerate(self.fixes))):
                self._tree.add_word(bad, k)
            if self.fixes:
                self._tree.make_automaton()
        done, said, last = 0, [], -1
        # What is in the text is found in one pass; a fix may bring about a later one, so it is looked at again.
        while self.fixes and (due := min((k for _, k in self._tree.iter(text) if k > last), default=None)) is not None:
            bad, good = self.fixes[due]
            times, text, last = text.count(bad), text.replace(bad, good), due
            done += times
            said.append(f"{bad}→{good}×{times}")
        return text, done, said


def fix_confusions(text: Column | str, fixes: list[tuple[str, str]]) -> Column:
    """struct(text, n_fixes, fixes): each fix replaces all its places before the next one is looked for."""
    apply = Fixes(fixes)

    @F.pandas_udf("struct<text:string,n_fixes:int,fixes:array<string>>")
    def fixed(values: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([(None, None, None) if v is None else apply(v) for v in values], columns=["text", "n_fixes", "fixes"]).astype({"n_fixes": "Int32"})

    return fixed(F.col(text) if isinstance(text, str) else text)


def clean(df: DataFrame, text: str = "text", lexicon: DataFrame | None = None, enabled: bool = True) -> DataFrame:
    """Adds clean_text, noise_before, noise_after, n_fixes, n_space, n_garbage and fixes (at most 50)."""
    if not enabled:
        score = tx.noise_score(text)
        return df.withColumns({"clean_text": F.col(text), "noise_before": score, "noise_after": score, "n_fixes": F.lit(0), "n_space": F.lit(0), "n_garbage": F.lit(0), "fixes": F.array().cast("array<string>")})
    fixes = fix_list(lexicon)
    before = df.withColumn("_n", tx.normalize(text)).withColumn("_raw", fix_confusions(text, fixes)["n_fixes"]).withColumn("_f", fix_confusions(F.col("_n")["text"], fixes))
    return before.withColumns({
        "clean_text": F.col("_f")["text"],
        "noise_before": tx.noise_score(text, F.col("_raw")),
        "noise_after": tx.noise_score(F.col("_f")["text"]),
        "n_fixes": F.col("_f")["n_fixes"],
        "n_space": F.col("_n")["n_space"],
        "n_garbage": F.col("_n")["n_garbage"],
        "fixes": F.slice(F.col("_f")["fixes"], 1, 50),
    }).drop("_n", "_f", "_raw")


def corrupt(df: DataFrame, text: str = "text", key: str = "doc_id", seed: int = 42) -> DataFrame:
    """Adds corrupted: a seeded simulation of scanning noise, the same for the same key and text.

    About a tenth of confusable characters change, one gap follows each twentieth CJK character;
    marks change, characters double and junk signs appear now and then.
    """
    swap: dict[str, str] = {}
    for a, b in CONFUSABLE.split():
        swap.setdefault(a, b)
        swap.setdefault(b, a)
    marks = dict(zip("，。；：！？", "、．：;!?", strict=True))

    @F.pandas_udf("string")
    def noisy(values: pd.Series, keys: pd.Series) -> pd.Series:
        import zlib

        out = []
        for v, k in zip(values, keys, strict=True):
            if v is None:
                out.append(None)
                continue
            rng = np.random.default_rng([seed, zlib.crc32(str(k).encode())])
            draw, gap = rng.random(len(v)), rng.random(len(v))
            parts, last = [], 0
            # Nothing happens to any other character.
            at = np.flatnonzero((draw < 0.10) | (gap < 0.045))
            for i, r, g in zip(at.tolist(), draw[at].tolist(), gap[at].tolist(), strict=True):
                c = v[i]
                parts.append(v[last:i])
                parts.append(swap[c] if c in swap and r < 0.10 else marks[c] if c in marks and r < 0.03 else c * 2 if r < 0.034 else c)
                if "一" <= c <= "鿿" and g < 0.045:
                    parts.append(" ")
                elif g < 0.004:
                    parts.append("□�◆"[int(g * 3000) % 3])
                last = i + 1
            parts.append(v[last:])
            out.append("".join(parts))
        return pd.Series(out, dtype=object)

    return df.withColumn("corrupted", noisy(text, F.col(key).cast("string")))
