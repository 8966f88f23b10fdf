"""Known terms: a lexicon table, longest-match recognition, importance of a text."""

from __future__ import annotations

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmere.config import Lexicon

# Kinds of terms in the order in which they win, and their weights.
KINDS = {"formula": 1.0, "herb": 0.9, "pattern": 0.85, "disease": 0.85, "western_disease": 0.6, "symptom": 0.7, "meridian": 0.45, "other": 0.3}

ENTITIES = "array<struct<text:string,type:string,start:int,end:int>>"


def unique_terms(lexicon: DataFrame) -> DataFrame:
    """term, type: terms of two characters or more, each with the kind that wins."""
    order = F.create_map(*[x for k, name in enumerate(KINDS) for x in (F.lit(name), F.lit(k))])
    best = Window.partitionBy("term").orderBy(F.coalesce(order[F.col("type")], F.lit(len(KINDS))), "type")
    return lexicon.where("length(term) >= 2").withColumn("_r", F.row_number().over(best)).where("_r = 1").select("term", "type")


# A small lexicon to begin with, of names that any textbook of the field has.
SEED = {
    "herb": "人参 黄芪 党参 白术 甘草 当归 熟地黄 白芍 川芎 麻黄 桂枝 柴胡 葛根 薄荷 石膏 知母 黄连 黄芩 黄柏 大黄 芒硝 茯苓 泽泻 猪苓 附子 干姜 半夏 陈皮 枳实 厚朴 杏仁 桔梗 丹参 桃仁 红花 酸枣仁 远志 龙骨 牡蛎 天麻",
    "formula": "麻黄汤 桂枝汤 小柴胡汤 大承气汤 白虎汤 四君子汤 四物汤 六味地黄丸 补中益气汤 归脾汤 逍遥散 银翘散 桑菊饮 二陈汤 五苓散 真武汤 理中丸 血府逐瘀汤 酸枣仁汤 炙甘草汤",
    "symptom": "发热 恶寒 头痛 咳嗽 气喘 心悸 失眠 健忘 眩晕 口渴 盗汗 自汗 胸闷 胁痛 腹痛 腹胀 便秘 泄泻 水肿 腰酸",
    "pattern": "气虚证 血虚证 阴虚证 阳虚证 风寒表证 风热表证 脾虚湿盛证 肝郁气滞证 肝阳上亢证 心脾两虚证 痰湿内阻证 瘀血内停证",
    "disease": "感冒 咳嗽病 哮病 胸痹 不寐 胃痛 泄泻病 便秘病 黄疸 水肿病 消渴 中风 头痛病 痹证",
    "western_disease": "高血压 糖尿病 冠心病 支气管炎 慢性胃炎 肝炎 贫血 过敏性鼻炎 偏头痛 类风湿关节炎",
    "meridian": "肺经 大肠经 胃经 脾经 心经 小肠经 膀胱经 肾经 心包经 三焦经 胆经 肝经",
}


def seed(spark) -> DataFrame:
    """term, type of the built-in lexicon, where no other one is at hand."""
    return spark.createDataFrame([(t, k) for k, words in SEED.items() for t in words.split()], "term string, type string")


def add_terms(lexicon: DataFrame, extra: DataFrame) -> DataFrame:
    """The lexicon with more terms of kinds it already has."""
    known = lexicon.select("type").distinct()
    return lexicon.select("term", "type").unionByName(extra.join(known, "type", "left_semi").select("term", "type")).distinct()


class Matcher:
    """Terms as an automaton; built once per Python worker, not shipped."""

    def __init__(self, terms: dict[str, str]):
        self.terms = terms
        self._tree: ahocorasick.Automaton | None = None

    def __getstate__(self):
        return self.terms

    def __setstate__(self, terms):
        self.terms, self._tree = terms, None

    def find(self, text: str) -> list[tuple[str, str, int, int]]:
        """Longest matches from left to right, none within another: text, type, start, end."""
        if not self.terms or not text:
            return []
        if self._tree is None:
            self._tree = ahocorasick.Automaton()
            for term in self.terms:
                self._tree.add_word(term, len(term))
            self._tree.make_automaton()
        longest: dict[int, int] = {}
        for end, n in self._tree.iter(text):
            start = end - n + 1
            if longest.get(start, 0) < n:
                longest[start] = n
        out, at = [], 0
        for start in sorted(longest):
            if start >= at:
                n = longest[start]
                word = text[start : start + n]
                out.append((word, self.terms[word], start, start + n))
                at = start + n
        return out


def matcher(lexicon: DataFrame, config: Lexicon | None = None) -> Matcher:
    """The lexicon as an automaton, after a check that it is small enough to be sent to all tasks."""
    limit = (config or Lexicon()).max_terms
    rows = unique_terms(lexicon).limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"a lexicon of more than {limit} terms isn't broadcast")
    return Matcher({r["term"]: r["type"] for r in rows})


def entities(lexicon: DataFrame, text: Column | str, config: Lexicon | None = None) -> Column:
    """Terms in a text by longest match: array of struct(text, type, start, end)."""
    shared = lexicon.sparkSession.sparkContext.broadcast(matcher(lexicon, config))

    @F.pandas_udf(ENTITIES)
    def found(values: pd.Series) -> pd.Series:
        m = shared.value
        return values.map(lambda v: [{"text": w, "type": k, "start": a, "end": b} for w, k, a, b in m.find(v)], na_action="ignore")

    return found(F.col(text) if isinstance(text, str) else text)


def entity_texts(found: Column) -> Column:
    """Distinct terms in the order in which they are first seen."""
    return F.array_distinct(F.transform(found, lambda e: e["text"]))


def by_type(found: Column) -> Column:
    """map of kind to its distinct terms in first-seen order; kinds in first-seen order too."""
    kinds = F.array_distinct(F.transform(found, lambda e: e["type"]))
    return F.map_from_entries(F.transform(kinds, lambda k: F.struct(k, F.array_distinct(F.transform(F.filter(found, lambda e: e["type"] == k), lambda e: e["text"])))))


def importance(found: Column, config: Lexicon | None = None) -> Column:
    """Saturating weight of the distinct terms of a text, from base to base plus bonus."""
    c = config or Lexicon()
    weight = F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])
    distinct = F.array_distinct(F.transform(found, lambda e: F.struct(e["type"], e["text"])))
    raw = F.aggregate(distinct, F.lit(0.0), lambda a, e: a + F.coalesce(weight[e["type"]], F.lit(0.3)))
    return F.round(F.least(F.lit(1.0), c.base_importance + c.entity_bonus * (1 - F.exp(-raw / 2))), 4)


def python_importance(found: list[tuple[str, str, int, int]], config: Lexicon) -> float:
    """importance for operators that go step by step."""
    import math

    raw = sum(KINDS.get(k, 0.3) for k, _ in {(k, w) for w, k, _, _ in found})
    return round(min(1.0, config.base_importance + config.entity_bonus * (1 - math.exp(-raw / 2))), 4)


def vocabulary(seed: DataFrame, entries: DataFrame, questions: DataFrame, extra: DataFrame | None = None) -> DataFrame:
    """term, type from a seed lexicon, textbook entries (term, type), the diseases of question
    records (pipe-separated) and extra terms; terms of 2 to 12 characters beyond the seed."""
    fit = lambda df: df.select(F.trim("term").alias("term"), "type").where("length(term) between 2 and 12")
    diseases = questions.select(F.explode(F.split("related_diseases", r"[|]")).alias("term"), F.lit("western_disease").alias("type"))
    all_ = seed.select("term", "type").where("term is not null").unionByName(fit(entries)).unionByName(fit(diseases))
    if extra is not None:
        all_ = all_.unionByName(extra.select("term", "type"))
    return all_.distinct()
