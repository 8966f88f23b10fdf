"""Problem 3: broken prompt and response pairs.

Method: a pushdown parser over fences, brackets, quotations, list marks and markup finds answers
that break off inside a construct; greedy string tiling finds answers that repeat the question;
scripts and function words give the languages; a grammar of declining and courtesy sentences
finds refusals. An answer that merely lacks a final mark is told from one that breaks off by the
endings of all answers: for the last tokens of such an answer (known terms and numbers made
alike) it is counted, over the whole corpus, how often a sentence ends after them.

A record has at most one defect, in the order empty, copy, refusal, language, truncated.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from difflib import SequenceMatcher

import ahocorasick
import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmere.llm.language import language
from quillmere.llm.p1_unify import look_of
from quillmere.session import cut


@dataclass(frozen=True)
class Settings:
    #: Least length of a tile, and share of answer and question that tiles must cover in a copy.
    tile: int = 3
    copied: float = 0.8
    #: Contexts of the last tokens, longest first; how often one must occur; share that ends.
    contexts: tuple[int, ...] = (8, 6, 4, 3, 2, 1)
    least_seen: int = 4
    ends: float = 0.1
    #: Terms of the lexicon made alike; a larger lexicon is refused rather than broadcast.
    max_terms: int = 200_000


# ---------------------------------------------------------------- empty
TAG = re.compile(r"<[^<>]{0,40}>|&[a-z]{2,8};|&#\d+;")
LEAD = re.compile(r"^\s*(?:答案?|回答|回复|问题?|提问|您问的是|你问的是|您的问题是|你的问题是|re|q|a|question|answer)\s*[:：]\s*", re.I)
FILLER = re.compile(
    r"(?:暂|尚|目前|还)?(?:没有|无|未有)(?:回答|答案|回复|内容|数据|资料|解答)?|待(?:补充|完善|回答|填写?|定|续|答|更新|回复)|空(?:白)?|略|未(?:填写?|答|回答|知)|省略|同上|"
    r"n ?a|null|none|nil|nan|tbd|todo|tba|undefined|empty|blank|no answer|not available|unknown|无答案"
)


def is_empty(answer: str | None) -> bool:
    if answer is None:
        return True
    text = TAG.sub(" ", look_of(answer))
    text = LEAD.sub("", text)
    bare = "".join(c if unicodedata.category(c)[0] in "LN" else " " for c in text.lower()).split()
    return not bare or bool(FILLER.fullmatch(" ".join(bare)))


# ---------------------------------------------------------------- copy
def _letters(text: str) -> str:
    return "".join(c for c in look_of(text).casefold() if unicodedata.category(c)[0] in "LN")


def tiled(pattern: str, text: str, least: int) -> int:
    """Greedy string tiling: how many characters of text are covered by tiles of pattern, each
    character of either used once; longest tiles first."""
    free_p, free_t = [(0, len(pattern))], [(0, len(text))]
    covered = 0
    while True:
        best = None
        for a0, a1 in free_p:
            for b0, b1 in free_t:
                if min(a1 - a0, b1 - b0) < max(least, (best or (0, 0, 0))[2] + 1):
                    continue
                m = SequenceMatcher(None, pattern[a0:a1], text[b0:b1], autojunk=False).find_longest_match()
                if m.size >= least and (best is None or m.size > best[2]):
                    best = (a0 + m.a, b0 + m.b, m.size)
        if best is None:
            return covered
        a, b, size = best
        covered += size
        for free, at in ((free_p, a), (free_t, b)):
            k = next(i for i, (x, y) in enumerate(free) if x <= at and at + size <= y)
            x, y = free.pop(k)
            free.extend(s for s in ((x, at), (at + size, y)) if s[1] - s[0] >= least)


def is_copy(question: str | None, answer: str, s: Settings) -> bool:
    if not question:
        return False
    q, a = _letters(question), _letters(LEAD.sub("", answer))
    if len(q) < s.tile or len(a) < s.copied * len(q):
        return False
    # Cheap upper bound on what tiles can cover, before tiling: the letters in common.
    have, given = Counter(a), Counter(q)
    times = -(-len(a) // len(q))
    if sum(min(k, times * given[c]) for c, k in have.items()) < s.copied * len(a):
        return False
    # However often the question is repeated: whole repetitions go first, the rest piece by piece.
    rest = a.replace(q, "\0")
    covered = whole = (len(a) - len(rest.replace("\0", ""))) // len(q) * len(q)
    used = q if whole else ""
    for piece in rest.split("\0"):
        for k in range(0, len(piece), 3 * len(q)):
            part = piece[k : k + 3 * len(q)]
            pattern = q * max(1, round(len(part) / len(q)))
            tiles = tiled(pattern, part, s.tile)
            covered += tiles
            if not used and tiles >= s.copied * len(q):
                used = q
    return bool(used) and covered >= s.copied * len(a)


# ---------------------------------------------------------------- refusal
SENTENCE = re.compile(r"[^。！？!?\n；;]+[。！？!?；;]*")
# The terminals of the grammar of declining. Each is a set of words, as alternatives.
TERMINALS = {
    "inability": "无法|不能|没法|没有?办法|不便|不宜|恕|难以|拒绝|无权|不可以|不予|不会|不得|不方便",
    "act": "回答|作答|解答|答复|回应|回复|提供|给出|判断|讨论|诊断|协助|帮助|帮您|帮你|帮忙|评论|评价|告知|透露|处理|受理|满足|建议|推荐|说明|介绍",
    "silence": "无可奉告|恕难|不便(?:作答|回答|多言)",
    "lacking": "不具备",
    "standing": "资[格质]",
    "within": "不在",
    "beyond": "超出",
    "range": "范围",
    "shut": "(?:已|被|予以)(?:关闭|停用|禁止|屏蔽)",
    "channel": "问答|提问|咨询|问题|功能|话题",
    "cannot": "can't|can’t|cannot|can not|unable to|won't|won’t|not able to|not allowed to|refuse to|must decline to|decline to|not something i can|outside (?:of )?(?:my|the) scope|beyond (?:my|the) scope|can(?:no|')t be (?:answered|discussed)",
    "regret": "抱歉|对不起|不好意思|很遗憾|谅解|sorry|apolog",
    "wish": "祝您?|早日康复|换一?个(?:话题|问题)|尽力配合|感谢您|谢谢|thank you|feel free|another (?:topic|question)|happy to help with",
    "turn_to": "咨询|另询|前往|联系|求助|询问",
    "expert": "专业|医师|医生|门诊|机构|人员|医院",
    "ask": "please (?:ask|consult|see|contact|speak|talk)|professional",
    "warning": "代替面诊|延误病情",
    "need": "需要由",
    "in_person": "当面|资质",
    "but": r"不过|但是|然而|仅供参考|一般来说|通常|可先|可以先|\bhowever\b|\bin general\b|\bgenerally\b",
    "dose": r"\d+(?:\.\d+)?\s*(?:克|毫升|毫克|片|粒|丸|mg|ml|g)(?![a-z])",
}
# What a sentence can be, by productions of terminals; a number is the most characters between two of them.
PRODUCTIONS = {
    "decline": ["inability 24 act", "silence", "lacking 20 standing", "within 10 range", "beyond 20 range", "shut 8 channel", "cannot"],
    "courtesy": ["regret", "wish", "turn_to 14 expert", "ask", "warning", "need 24 in_person"],
    "substance": ["but", "dose"],
}


def _compiled(rules: list[str]) -> re.Pattern[str]:
    """The productions of one symbol as a pattern."""
    part = lambda x: f".{{0,{x}}}?" if x.isdigit() else f"(?:{TERMINALS[x]})"
    return re.compile("|".join("".join(map(part, rule.split())) for rule in rules), re.I)


GRAMMAR = {symbol: _compiled(rules) for symbol, rules in PRODUCTIONS.items()}


def is_refusal(answer: str) -> bool:
    """All sentences decline or are mere courtesy, and at least one declines. A sentence that turns
    to general advice, or that names a dose, has substance whatever else it says."""
    text = LEAD.sub("", look_of(answer))
    parts = [p for sentence in SENTENCE.findall(text) for p in re.split(r"(?<=[a-z])\. ", sentence) if any(map(str.isalpha, p))]
    if any(GRAMMAR["substance"].search(p) for p in parts):
        return False
    declines = [bool(GRAMMAR["decline"].search(p)) for p in parts]
    return any(declines) and all(d or GRAMMAR["courtesy"].search(p) for d, p in zip(declines, parts, strict=True))


# ---------------------------------------------------------------- language
# Names by which a question asks for a language.
ASKED = {
    "en": "英文|英语|English|anglais|Englisch", "zh": "中文|汉语|华语|Chinese|Mandarin", "ja": "日文|日语|Japanese", "ko": "韩文|韩语|Korean", "de": "德文|德语|German",
    "fr": "法文|法语|French", "vi": "越南文|越南语|Vietnamese", "th": "泰文|泰语|Thai", "hi": "印地语|Hindi", "ar": "阿拉伯文|阿拉伯语|Arabic", "es": "西班牙文|西班牙语|Spanish", "ru": "俄文|俄语|Russian",
}
_ASK = {k: re.compile(rf"(?:用|以|译成|译为|翻译成|翻成|写成|换成)(?:{v})|(?:in|into) (?:{v})\b|(?:{v})(?:回答|怎么[说讲介]|表达|翻译)", re.I) for k, v in ASKED.items()}


def is_other_language(question: str | None, answer: str) -> bool:
    q, a = language(question), language(answer)
    if q is None or a is None or q == a or "latin" in (q, a) and not {q, a} & {"zh", "ja", "ko", "th", "hi", "ar", "ru"}:
        return False
    return not any(pattern.search(question) for lang, pattern in _ASK.items() if lang == a)


# ---------------------------------------------------------------- truncation
OPEN = {"(": ")", "（": "）", "[": "]", "【": "】", "「": "」", "『": "』", "“": "”", "《": "》", "〈": "〉", "{": "}", "«": "»", "〔": "〕"}
MARKUP = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9]*)\b[^<>]*?(/?)(>|$)")
# Elements that need no end.
VOID = frozenset(("br", "hr", "img", "p", "li", "input", "td", "tr", "th", "wbr", "dd", "dt"))
#: Signs the parser stops at; all others it passes over.
SIGN = re.compile("```|[<\"" + "".join(re.escape(c) for pair in OPEN.items() for c in pair) + "]")
CLOSE = {v: k for k, v in OPEN.items()}
END = re.compile(r"[。！？!?।॥؟～~]$|[.](?<![\d][.])$|(?<=\d)[.]$")
ITEM = re.compile(r"(?:^|(?<=[\s，,；;：:。]))(?:[(（]?\d{1,2}[)）.、]|[①-⑳]|[-*•])\s*$")
ELLIPSIS = re.compile(r"[\s…]+$|\s*\.{2,}\s*$|[。]{2,}$")
DANGLING = re.compile(r"[，,、：:；;—–\-/+=（(「『“《【\[{<]$")


def parsed(text: str) -> str | None:
    """Pushdown parse: the construct the text breaks off in, or None.

    Fences, markup elements, brackets and quotations, straight ones too, are pushed and popped; a
    list mark with nothing behind it is an open construct too. A closing mark without an opening
    one and marks used as list numbers are passed over, and so is a straight mark that stands
    for inches.
    """
    stack: list[str] = []
    k = 0
    while m := SIGN.search(text, k):
        k, c = m.end(), m[0]
        inside = stack[-1] if stack else None
        if c == "```":
            stack.pop() if inside == c else stack.append(c)
        elif inside == "```":
            continue
        elif c == "<":
            if element := MARKUP.match(text, m.start()):
                if not element[4]:
                    return "markup"
                name = "<" + element[2].lower()
                if element[1]:
                    if name in stack:
                        del stack[len(stack) - 1 - stack[::-1].index(name) :]
                elif not element[3] and name[1:] not in VOID:
                    stack.append(name)
                k = element.end()
        elif c == '"':
            if c in stack:
                del stack[len(stack) - 1 - stack[::-1].index(c) :]
            elif not text[m.start() - 1 : m.start()].isdigit():
                stack.append(c)
        elif c in OPEN:
            stack.append(c)
        elif CLOSE[c] in stack:
            del stack[len(stack) - 1 - stack[::-1].index(CLOSE[c]) :]
    if ITEM.search(text):
        return "list"
    return stack[-1] if stack else None


TOKEN = re.compile(r"[A-Za-zÀ-ɏḀ-ỿ]+(?:['’][A-Za-z]+)?|\d+(?:[.:]\d+)*|\S")


class Alike:
    """Tokens of a text in which known terms are one token of their kind and numbers are alike."""

    def __init__(self, terms: dict[str, str]):
        self.kinds = {t: "\x01" + k for t, k in terms.items() if len(t) > 1}
        self.tree = ahocorasick.Automaton()
        for t in self.kinds:
            self.tree.add_word(t, t)
        if self.kinds:
            self.tree.make_automaton()

    def __call__(self, text: str) -> list[str]:
        found = list(self.tree.iter_long(text)) if self.kinds else []
        out: list[str] = []
        at = 0
        for end, term in [*found, (len(text) + 0, None)]:
            start = end - len(term) + 1 if term else len(text)
            out += ["\x02" if x[0].isdigit() else x.lower() for x in TOKEN.findall(text[at:start])]
            if term:
                out.append(self.kinds[term])
                at = end + 1
        return out


STOPS = frozenset("。！？!?")


def _sentences_of(text: str) -> list[tuple[str, bool]]:
    """Sentences and whether each has its end mark; only the last can lack it."""
    parts = re.split(r"(?<=[。！？!?])\s*|(?<=[a-z]\.)\s+(?=[A-Z])|\n+", text)
    out = []
    for p in parts:
        p = p.strip()
        if p:
            ended = p[-1] in STOPS or p.endswith(".") and not p.endswith("..")
            out.append((p.rstrip("。！？!?.") if ended else p, ended))
    return out


def _id(tokens: list[str]) -> int:
    return xxhash.xxh3_64_intdigest("\x00".join(tokens)) - (1 << 63)


def tail_of(answer: str) -> tuple[str, bool] | None:
    """The last sentence, if it lacks an end mark, without marks it trails off in; and whether
    those marks show that it breaks off. None for answers that end properly."""
    text = TAG.sub(" ", look_of(answer)).strip()
    rest = ELLIPSIS.sub("", text)
    if rest == text and re.search(r"[。！？!?।॥؟～~”』」》]$|[)）](?<!\d[)）])$|[.]$", text):
        return None
    if re.search(r"[。！？!?]$", rest):
        return None
    open_end = bool(DANGLING.search(rest))
    rest = re.sub(r"[，,、：:；;\s—–\-]+$", "", rest)
    last = re.split(r"[。！？!?\n]", rest)[-1].strip()
    last = re.split(r"(?<=[a-z]\.)\s+(?=[A-Z])", last)[-1]
    return (last, open_end) if last else None


def _judge(question: str | None, answer: str | None, look: str, tokens_of, s: Settings) -> tuple[str | None, list[int]]:
    """The defect of one record, or the contexts of its last tokens if only these can tell."""
    if is_empty(answer):
        return "empty", []
    if is_copy(question, answer, s):
        return "copy", []
    if is_refusal(answer):
        return "refusal", []
    if is_other_language(question, answer):
        return "language", []
    if parsed(look.strip()) is not None:
        return "truncated", []
    left = tail_of(answer)
    if left is None:
        return None, []
    if left[1]:
        return "truncated", []
    tokens = ["\x03", *tokens_of(left[0])]
    return None, [_id(tokens[-n:]) for n in s.contexts]


def _one_pass(s: Settings, alike):
    """Of each batch the records with a defect or an open end, and how often each context of
    tokens occurs in ended sentences and how often the sentence ends there."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens_of = alike.value
        for batch in batches:
            out = []
            sentences: Counter[str] = Counter()
            for key, q, a in zip(batch["id"], batch["question"], batch["answer"], strict=True):
                look = look_of(a) if a else ""
                defect, tail = _judge(q, a, look, tokens_of, s)
                if defect or tail:
                    out.append((key, defect, tail))
                sentences.update(x for x, whole in _sentences_of(TAG.sub(" ", look)) if whole)
            yield pd.DataFrame(out, columns=["id", "defect", "tail"]).assign(context=None, seen=None, ended=None)
            seen: Counter[int] = Counter()
            ended: Counter[int] = Counter()
            for sentence, times in sentences.items():
                tokens = ["\x03", *tokens_of(sentence)]
                for n in s.contexts:
                    for end in range(2 if n == s.contexts[0] else max(2, n), len(tokens) + 1):
                        seen[h := _id(tokens[max(0, end - n) : end])] += times
                        if end == len(tokens):
                            ended[h] += times
            yield pd.DataFrame({"id": None, "defect": None, "tail": None, "context": list(seen), "seen": list(seen.values()), "ended": [ended[h] for h in seen]})

    return run


def defects(df: DataFrame, lexicon: DataFrame | None = None, s: Settings | None = None) -> DataFrame:
    """id, defect for the defective records of df (id, question, answer).

    lexicon: term, type of known names that are made alike when endings are counted. Repeated
    rows give one row; where an id comes with different texts, its first defect in the order of
    the module's list counts. A null question makes no copy and no language defect. Endings
    that occur too rarely in the corpus to be judged give no defect, unless even the last word
    occurs nowhere else.
    """
    s = s or Settings()
    spark = df.sparkSession
    terms: dict[str, str] = {}
    if lexicon is not None:
        known = lexicon.select("term", "type").where("term is not null").distinct().limit(s.max_terms + 1).collect()
        if len(known) > s.max_terms:
            raise ValueError(f"a lexicon of more than {s.max_terms} terms is not broadcast; pass the part that occurs in answers")
        terms = {look_of(r["term"]): r["type"] or "" for r in sorted(known)}
    alike = spark.sparkContext.broadcast(_Lazy(terms))
    rows = df.select("id", F.col("question").cast("string").alias("question"), F.col("answer").cast("string").alias("answer")).where("id is not null")
    kind = dict(rows.dtypes)["id"]
    made = cut(rows.mapInPandas(_one_pass(s, alike), f"id {kind}, defect string, tail array<long>, context long, seen long, ended long"))
    flagged = made.where("defect is not null").select("id", "defect")
    tails = made.where("id is not null and defect is null").select("id", F.posexplode("tail").alias("n", "context"))
    endings = made.where("context is not null").groupBy("context").agg(F.sum("seen").alias("seen"), F.sum("ended").alias("ended"))
    judged = tails.join(endings.join(tails.select("context").distinct(), "context", "left_semi"), "context", "left")
    enough = F.coalesce(F.col("seen"), F.lit(0)) >= s.least_seen
    cut_off = (
        judged.groupBy("id")
        .agg(
            F.min(F.when(enough, F.struct("n", (F.col("ended") / F.col("seen")).alias("share")))).alias("longest"),
            F.max(F.coalesce("seen", F.lit(0))).alias("most"),
        )
        .where((F.col("longest.share") < s.ends) | (F.col("longest").isNull() & (F.col("most") == 0)))
        .select("id", F.lit("truncated").alias("defect"))
    )
    order = F.create_map(*[x for k, d in enumerate(("empty", "copy", "refusal", "language", "truncated")) for x in (F.lit(d), F.lit(k))])
    return flagged.unionByName(cut_off).groupBy("id").agg(F.min(F.struct(order[F.col("defect")].alias("k"), "defect")).alias("d")).select("id", "d.defect")


class _Lazy:
    """Builds the automaton once per Python worker; it isn't pickled."""

    def __init__(self, terms: dict[str, str]):
        self.terms = terms
        self.made: Alike | None = None

    def __getstate__(self):
        return self.terms

    def __setstate__(self, terms):
        self.terms, self.made = terms, None

    def __call__(self, text: str) -> list[str]:
        if self.made is None:
            self.made = Alike(self.terms)
        return self.made(text)
