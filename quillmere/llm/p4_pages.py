"""Problem 4: noise in text from scanned pages.

Method: a vocabulary of words and of short character sequences is counted over all documents.
For a word that is not in it, or is rare, a Levenshtein automaton is intersected with a trie of
the vocabulary, so that every entry within one edit is found; letter groups that scanning takes
for each other are one edit too. A Chinese character is judged by its two neighbours: all
characters that the vocabulary holds between them are its candidates. How much commoner a
candidate is in this context ranks them, and less is asked of characters that this corpus
confuses: pairs of which one stands in the frames of the other far oftener than by chance. Page furniture (running heads, page numbers) is told by the title
of the record, by section labels counted over the corpus and by form; it is removed, words cut
at line ends are joined and lines are flowed into paragraphs.

Kinds of noise: broken_word, misread, running_head, page_number.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmere.llm.p1_unify import IGNORABLE, look_with_spaces
from quillmere.llm.scripts import Simplifier, simplified
from quillmere.session import cut

KINDS = ("broken_word", "misread", "running_head", "page_number")
#: Kinds of source whose texts come from pages.
PAGES = ["pdf", "pdf_scan", "ocr_scan"]


@dataclass(frozen=True)
class Settings:
    #: Words and sequences must make up this share of all; bounds the vocabulary by its inverse.
    word_share: float = 2e-6
    sequence_share: float = 4e-7
    pair_share: float = 4e-7
    label_share: float = 1e-5
    #: Words rarer than this share are looked up like unknown ones.
    rare_share: float = 1e-5
    #: Characters are confused if one stands in this many frames of the other at least, in this share of all such frames, and so
    #: many times oftener than by chance.
    least_frames: int = 3
    frame_share: float = 1e-5
    lift: float = 12.0
    #: ... and so many times oftener in texts of pages than their share of all text lets expect, where that is known.
    page_lift: float = 1.5
    #: ... and occur this often at least.
    least_word: int = 4
    least_sequence: int = 5
    least_pair: int = 2
    least_label: int = 3
    #: How many times commoner than the text's reading a candidate must be, and one that is confused with it.
    commoner: float = 25.0
    alike: float = 5.0


# Signs that scanning leaves behind.
JUNK = re.compile("[\ufffd□■◆▯▮▪◇●▲★\ue000-\uf8ff]")
# Letter groups that scanning mistakes for each other, as read and as meant.
GROUPS = [("0", "o"), ("1", "l"), ("1", "i"), ("!", "i"), ("!", "l"), ("|", "l"), ("|", "i"), ("5", "s"), ("8", "b"), ("6", "b"), ("9", "g"), ("b", "h"), ("h", "b"), ("rn", "m"), ("m", "rn"), ("cl", "d"), ("d", "cl"), ("vv", "w"), ("ii", "u"), ("c", "e"), ("e", "c"), ("u", "n"), ("n", "u"), ("f", "t"), ("t", "f"), ("q", "g"), ("ri", "n"), ("li", "h")]

# Characters that stand for each other in ordinary writing; a change among them isn't a misreading.
INSTEAD = [frozenset(x) for x in ("不未无非没勿", "一二三四五六七八九十百", "克钱两分斤", "上下左右前后", "男女")]

# Latin letters of like drawing.
LIKE_LETTERS = frozenset(a + b for group in ("iljtf", "aoec", "hnbk", "vyuw", "nur", "gqy", "bd", "mn", "sz", "pq", "xk") for a in group for b in group if a != b)

HYPHEN = "-\u2010\u2011¬\u00ad–"
TOKEN = re.compile(r"[A-Za-zÀ-ɏḀ-ỿ0-9!|]*[A-Za-zÀ-ɏḀ-ỿ][A-Za-zÀ-ɏḀ-ỿ0-9!|]*")
WORD = re.compile(r"[a-zà-ɏḁ-ỿ]{2,}")
#: Looked for at the beginning of a word only, so that a very long one is read once.
BROKEN = re.compile(rf"(?<![A-Za-zÀ-ɏḀ-ỿ0-9!|])([A-Za-zÀ-ɏḀ-ỿ0-9!|]+)([{HYPHEN}])[ \t]*\n\s*([a-zà-ɏḁ-ỿ0-9!|]+)")
NUMBER = r"\d[\d ]{0,6}|[ivxlc]{1,7}|[一二三四五六七八九十百〇零]{1,5}"
PAGE = re.compile(rf"[\[(（〔【<·•.—–\-~=\s]*(?:第|page|pg?\.?|p\.|s\.)?\s*(?:{NUMBER})\s*(?:页|頁|/\s*\d+)?[\])）〕】>·•.—–\-~=\s]*", re.I)
HEAD = re.compile(r"(?:(?P<before>\d[\d ]{0,6})\s{2,})?(?P<title>\S.*?)(?:\s*[·•|]\s*(?P<section>\S[^·•|]*?))?(?:\s{2,}(?P<after>\d[\d ]{0,6}))?")
END = re.compile("[。！？!?….”』」）)：:；;，,、]$")
HEADING = re.compile(r"#{1,6}\s")
CHAPTER = re.compile(r"(?m)^#{1,6}\s+第[一二三四五六七八九十百\d]+[章节回篇]\s+(\S{1,12})\s*$")
HAN = (0x4E00, 0xA000)
_HAN = re.compile("[㐀-鿿]")


#: What a text may hold that is spelled in more than one way; most texts hold none of it.
_VARIED = re.compile(f"[{IGNORABLE}\u0300-\u036f\u0370-\u04ff\u1100-\u11ff\u13a0-\u13ff\u2000-\u200a\u202f\u205f\u00a0\u3000\u2e80-\u2fdf\uf900-\ufaff\ufb00-\ufb06\uff10-\uff19\uff21-\uff3a\uff41-\uff5a\uff61-\uff9f\r]")
_KEPT = re.compile("[…℃！-／：-＠［-｀｛-～]")
_KEPT_BACK = re.compile("[\ue100-\ue1ff]")
_KEPT_AS = {c: chr(0xE100 + k) for k, c in enumerate("…℃" + "".join(map(chr, [*range(0xFF01, 0xFF10), *range(0xFF1A, 0xFF21), *range(0xFF3B, 0xFF41), *range(0xFF5B, 0xFF5F)])))}
_KEPT_OF = {v: k for k, v in _KEPT_AS.items()}


def plain_form(text: str) -> str:
    """One spelling of letters and characters, with the marks of the text and its line ends kept."""
    text = re.sub("\u00ad(?=[ \t]*\n)", "-", text)
    if not _VARIED.search(text):
        return text
    held = _KEPT.sub(lambda m: _KEPT_AS[m[0]], text)
    return _KEPT_BACK.sub(lambda m: _KEPT_OF.get(m[0], m[0]), look_with_spaces(held))


# ---------------------------------------------------------------- vocabulary
def _sequence_codes(text: str) -> np.ndarray:
    """Code points in which all digits are one and all Latin letters are one; spaces go."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    c = c[c != 32]
    c[(c >= 48) & (c < 58)] = 48
    c[((c >= 65) & (c < 91)) | ((c >= 97) & (c < 123))] = 97
    return c


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a << 21 | b


def _triple(a: np.ndarray, b: np.ndarray, mid: np.ndarray) -> np.ndarray:
    return (a << 42 | b << 21 | mid).astype(np.int64)


PAIR, SEQUENCE, WORDS, LABEL, TOTAL, PAGED = range(6)


def _counts(simple: Simplifier, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pairs and triples around Chinese characters, words, and labels of sections."""
    for batch in batches:
        words: Counter[str] = Counter()
        labels: Counter[str] = Counter()
        codes = []
        flags: list[bool] = []
        for text, title, page in zip(batch["text"], batch["title"], batch["page"], strict=True):
            if not text:
                continue
            flags += [bool(page), False]
            text = simple(text)
            words.update(WORD.findall(text.lower()))
            codes += [_sequence_codes(text), np.array([10, 10], np.int64)]
            labels.update(set(CHAPTER.findall(text)))
            if title and " · " in text:
                title = simple(title)
                labels.update({m["section"].casefold() for line in text.split("\n") if " · " in line and (m := HEAD.fullmatch(line.strip())) and m["section"] and m["title"].casefold() == title.casefold()})
        frames = []
        paged = np.array(flags, bool)
        if codes:
            c = np.concatenate(codes)
            han = (c >= HAN[0]) & (c < HAN[1])
            both = han[1:] | han[:-1]
            for kind, keys in ((PAIR, _pair(c[:-1], c[1:])[both]), (SEQUENCE, _triple(c[:-2], c[2:], c[1:-1])[han[1:-1]])):
                values, n = np.unique(keys, return_counts=True)
                frames.append(pd.DataFrame({"kind": kind, "key": values, "word": None, "n": n}))
            frames.append(pd.DataFrame({"kind": [TOTAL, TOTAL, TOTAL], "key": [PAIR, WORDS, LABEL], "word": None, "n": [int(han.sum()), sum(words.values()), len(batch)]}))
            if paged.any():
                # What stands in texts of pages is counted once more, by itself.
                of_page = np.repeat(paged, [len(x) for x in codes])
                inside = of_page[1:-1] & han[1:-1]
                values, n = np.unique(_triple(c[:-2], c[2:], c[1:-1])[inside], return_counts=True)
                frames.append(pd.DataFrame({"kind": PAGED, "key": values, "word": None, "n": n}))
                frames.append(pd.DataFrame({"kind": [TOTAL], "key": [PAGED], "word": None, "n": [int((of_page & han).sum())]}))
        for kind, counter in ((WORDS, words), (LABEL, labels)):
            frames.append(pd.DataFrame({"kind": kind, "key": 0, "word": list(counter), "n": list(counter.values())}))
        yield pd.concat(frames).astype({"word": object})


class Trie:
    """Words by letters; near() intersects it with the automaton of all strings within one edit."""

    def __init__(self, words: dict[str, int]):
        self.root: dict = {}
        for w in words:
            node = self.root
            for c in w:
                node = node.setdefault(c, {})
            node[""] = w

    def near(self, word: str, groups: list[tuple[str, str]] = ()) -> dict[str, bool]:
        """All words one edit (or none) away, and whether groups of letters alone explain the difference.

        Trie and automaton are walked together. A state of the automaton is a set of (letters
        read, edits made, changed groups, letters of a group still to come). Groups, as read and
        as meant, are one edit; a second group may be changed if no other edit is made.
        """
        found: dict[str, bool] = {}
        n = len(word)
        by_first: dict[str, list[tuple[str, str]]] = {}
        for bad, good in groups:
            if bad in word:
                by_first.setdefault(good[0], []).append((bad, good))
        start = {(0, 0, 0, "")}
        if n:
            start.add((1, 1, 0, ""))  # a first letter too many in the text
        stack: list[tuple[dict, set]] = [(self.root, start)]
        while stack:
            node, state = stack.pop()
            for c, child in node.items():
                if c == "":
                    ends = [(e, g) for i, e, g, left in state if not left and (i == n or n - i == 1 and e + g == 0)]
                    if ends:
                        at_end = any(i == n and e == 0 and not left for i, e, g, left in state)
                        found[child] = at_end
                    continue
                after = set()
                for i, e, g, left in state:
                    if left:
                        if left[0] == c:
                            after.add((i, e, g, left[1:]))
                        continue
                    if i < n and word[i] == c:
                        after.add((i + 1, e, g, ""))
                    if e == 0 and g < 2:
                        for bad, good in by_first.get(c, ()):
                            if word.startswith(bad, i):
                                after.add((i + len(bad), 0, g + 1, good[1:]))
                    if e + g == 0:
                        after.add((i, 1, 0, ""))  # a letter the text lacks
                        if i < n:
                            after.add((i + 1, 1, 0, ""))  # another letter in the text
                            if i + 1 < n and word[i + 1] == c:
                                after.add((i + 2, 1, 0, ""))  # a letter too many in the text
                if after:
                    stack.append((child, after))
        return found


@dataclass
class Vocabulary:
    words: dict[str, int]
    labels: frozenset[str]
    pairs: tuple[np.ndarray, np.ndarray]
    triples: tuple[np.ndarray, np.ndarray]
    commoner: float
    alike: float
    simple: Simplifier
    #: Words of a lower count are rare.
    rare: float = 0.0
    #: Confused characters, what was meant << 21 | what is read, and the characters read.
    confused: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    #: For each pair of neighbours, the commonest count of a character between them.
    tops: tuple[np.ndarray, np.ndarray] | None = None
    trie: Trie | None = None
    seen: dict[str, str | None] = field(default_factory=dict)

    def __getstate__(self):
        return {**self.__dict__, "trie": None, "tops": None, "seen": {}}

    def _tops(self) -> tuple[np.ndarray, np.ndarray]:
        if self.tops is None:
            keys, n = self.triples
            around, starts = np.unique(keys >> 21, return_index=True)
            self.tops = around, np.maximum.reduceat(n, starts) if len(starts) else n
        return self.tops

    def correct_word(self, token: str) -> str | None:
        """What a token was before it was misread; None if it may stand as it is."""
        low = token.lower()
        if low in self.seen:
            return self.seen[low]
        if len(self.seen) > 200_000:
            self.seen.clear()
        self.seen[low] = found = self._correct(low)
        return found

    def _correct(self, low: str) -> str | None:
        own = self.words.get(low, 0)
        odd = not low.isalpha()
        if sum(c.isalpha() for c in low) < 2 or (not odd and len(low) < 4):
            return None
        if self.trie is None:
            self.trie = Trie(self.words)
        if odd or own <= self.rare:
            near = self.trie.near(low, GROUPS)
        else:
            # A common word can only be a misreading by a group of letters; other edits lead to other words.
            near = {low[:k] + good + low[k + len(bad) :]: True for bad, good in GROUPS for k in range(len(low)) if low.startswith(bad, k)}
        if odd:
            for bad, good in GROUPS[:5]:
                low = low.replace(bad, good)
            near[low] = True
        likely = {w: self.words[w] / (self.commoner if grouped else self._asked(low, w)) for w, grouped in near.items() if w in self.words}
        likely.pop(low, None) if not odd else None
        best = min(likely, key=lambda w: (-likely[w], w), default=None)
        if best is None:
            return None
        return best if likely[best] >= max(1, own) or (odd and near[best] and self.words[best] > own) else None

    def _asked(self, low: str, word: str) -> float:
        """How often a word one edit away must occur to be what was meant."""
        same = next((k for k, (a, b) in enumerate(zip(low, word, strict=False)) if a != b), min(len(low), len(word)))
        if len(low) == len(word) and low[same] + word[same] in LIKE_LETTERS:
            return self.commoner
        # Another ending is a form of the word and a lost beginning a part of one, not a misreading.
        if same >= min(len(low), len(word)) - 1 or (same == 0 and len(low) != len(word)):
            return math.inf
        # The shorter a word, the likelier is another word one letter away.
        return self.commoner * 4 ** max(1, 7 - len(low))

    def _count(self, table: tuple[np.ndarray, np.ndarray], keys: np.ndarray) -> np.ndarray:
        k, n = table
        if not len(k):
            return np.zeros(len(keys), np.int64)
        at = np.minimum(np.searchsorted(k, keys), len(k) - 1)
        return np.where(k[at] == keys, n[at], 0)

    def correct_characters(self, c: np.ndarray) -> list[tuple[int, int]]:
        """Positions of Chinese characters that were misread, and what they were."""
        if len(c) < 3:
            return []
        mid = np.flatnonzero((c[1:-1] >= HAN[0]) & (c[1:-1] < HAN[1])) + 1
        left = self._count(self.pairs, _pair(c[mid - 1], c[mid]))
        if not len(mid):
            return []
        here = self._count(self.triples, _triple(c[mid - 1], c[mid + 1], c[mid]))
        top = self._count(self._tops(), _pair(c[mid - 1], c[mid + 1]))
        # What is asked of a candidate is less where the character is known to be mistaken for another.
        asked = np.where(np.isin(c[mid], self.confused & ((1 << 21) - 1)), self.alike, self.commoner)
        rare = (top >= asked * np.maximum(1, here)) & ((here == 0) | (top >= 4 * asked))
        mid, left, here = mid[rare], left[rare], here[rare]
        keys, n = self.triples
        lo = np.searchsorted(keys, _triple(c[mid - 1], c[mid + 1], np.zeros(len(mid), np.int64)))
        hi = np.searchsorted(keys, _triple(c[mid - 1], c[mid + 1], np.full(len(mid), (1 << 21) - 1, np.int64)))
        out = []
        for k in range(len(mid)):
            options = slice(lo[k], hi[k])
            count = n[options]
            i = int(mid[k])
            others = keys[options] & ((1 << 21) - 1)
            # A candidate must be far commoner beside both neighbours, not only between them.
            beside = np.minimum(self._count(self.pairs, _pair(np.full(len(others), c[i - 1]), others)) / max(1, left[k]), self._count(self.pairs, _pair(others, np.full(len(others), c[i + 1]))) / max(1, int(self._count(self.pairs, _pair(c[i : i + 1], c[i + 1 : i + 2]))[0])))
            instead = next((group for group in INSTEAD if chr(c[i]) in group), frozenset())
            written = np.array([chr(d) in instead for d in others], bool)
            alike = np.isin(_pair(others, np.full(len(others), c[i])), self.confused)
            least = np.where(alike, self.alike, self.commoner)
            good = ~written & (count >= least * max(1, here[k])) & (beside >= least) & (others != c[i]) & (others >= HAN[0]) & (others < HAN[1])
            if good.any():
                out.append((i, int(others[good][(count[good] * np.where(alike[good], 1000, 1)).argmax()])))
        return out


def confusions(counts: DataFrame, s: Settings) -> DataFrame:
    """meant, read: characters of which the second stands in frames of the first far oftener than by chance.

    counts: kind, key, n of all sequences. A frame is a pair of neighbours; a character that is
    far rarer in it than the commonest one stands there instead of it. Chance is what the
    numbers of frames of both characters alone let expect. Where it is counted what stands in texts
    of pages, it must stand there for the most part: ordinary writing varies everywhere.
    """
    frame = (F.col("key").bitwiseAND(F.lit(~((1 << 21) - 1)))).alias("frame")
    mid = F.col("key").bitwiseAND(F.lit((1 << 21) - 1)).alias("mid")
    seen = counts.where(F.col("kind") == SEQUENCE).select(frame, mid, "n")
    top = seen.groupBy("frame").agg(F.max(F.struct("n", "mid")).alias("top")).where(F.col("top.n") >= s.commoner).select("frame", F.col("top.mid").alias("meant"), F.col("top.n").alias("most"))
    on_pages = counts.where(F.col("kind") == PAGED).select(frame, mid, F.col("n").alias("on_pages"))
    totals = {r["key"]: r["n"] for r in counts.where((F.col("kind") == TOTAL) & F.col("key").isin(PAIR, PAGED)).collect()}
    share = totals.get(PAGED, 0) / max(1, totals.get(PAIR, 0))
    instead = seen.join(top, "frame").where((F.col("mid") != F.col("meant")) & (F.col("n") * s.commoner <= F.col("most")))
    han = lambda c: (F.col(c) >= HAN[0]) & (F.col(c) < HAN[1])
    instead = instead.where(han("meant") & han("mid")).join(on_pages, ["frame", "mid"], "left")
    pairs = cut(instead.groupBy("meant", F.col("mid").alias("read")).agg(F.count("*").alias("frames"), (F.sum(F.coalesce("on_pages", F.lit(0))) / F.sum("n")).alias("on_pages")))
    of = lambda side: pairs.groupBy(side).agg(F.sum("frames").alias(f"of_{side}"))
    total = pairs.agg(F.sum("frames")).collect()[0][0] or 0
    least = max(s.least_frames, total * s.frame_share)
    # Bounded: no more than 1 / frame_share pairs reach that share of all frames.
    return (
        pairs.where(F.col("frames") >= least).join(of("meant"), "meant").join(of("read"), "read")
        .where(F.col("frames") * total >= s.lift * F.col("of_meant") * F.col("of_read"))
        .where(F.col("on_pages") >= min(0.9, s.page_lift * share))
        .select("meant", "read")
    )


def vocabulary(documents: DataFrame, s: Settings) -> Vocabulary:
    """Counts over all documents (title, text, and if known source_type); what is collected is bounded by the shares."""
    spark = documents.sparkSession
    page = F.coalesce(F.col("source_type").isin(PAGES), F.lit(False)) if "source_type" in documents.columns else F.lit(False)
    given = documents.select(F.col("title").cast("string").alias("title"), F.col("text").cast("string").alias("text"), page.alias("page")).where("text is not null")
    simple = Simplifier(simplified(spark))
    counts = cut(given.mapInPandas(lambda batches: _counts(simple, batches), "kind int, key long, word string, n long").groupBy("kind", "key", "word").agg(F.sum("n").alias("n")))
    totals = {r["key"]: r["n"] for r in counts.where(F.col("kind") == TOTAL).collect()}
    all_ = lambda what: totals.get(what, 0)
    least = {PAIR: max(s.least_pair, all_(PAIR) * s.pair_share), SEQUENCE: max(s.least_sequence, all_(PAIR) * s.sequence_share), WORDS: max(s.least_word, all_(WORDS) * s.word_share), LABEL: max(s.least_label, all_(LABEL) * s.label_share)}
    enough = F.lit(False)
    for kind, n in least.items():
        enough = enough | ((F.col("kind") == kind) & (F.col("n") >= n))
    # Bounded: of a total, no more than one by its share can reach the share.
    kept = counts.where(enough)
    rows = kept.select("kind", "key", "word", "n").toPandas()
    part = lambda kind: rows[rows["kind"] == kind].sort_values("key")
    arrays = lambda kind: (part(kind)["key"].to_numpy(np.int64), part(kind)["n"].to_numpy(np.int64))
    words = part(WORDS)
    return Vocabulary(
        dict(zip(words["word"], map(int, words["n"]), strict=True)),
        frozenset(w.casefold() for w in part(LABEL)["word"]),
        arrays(PAIR), arrays(SEQUENCE), s.commoner, s.alike, simple, all_(WORDS) * s.rare_share,
        np.sort(np.array([r["meant"] << 21 | r["read"] for r in confusions(counts, s).collect()], np.int64)),
    )


# ---------------------------------------------------------------- one record
def _near(a: str, b: str) -> bool:
    """Equal but for spaces, letter case and a few misread characters."""
    if abs(len(a) - len(b)) > max(4, len(b) // 4):
        return False
    a, b = ("".join(x.split()).casefold() for x in (a, b))
    if a == b:
        return bool(a)
    allowed = max(1, len(b) // 5)
    if not a or abs(len(a) - len(b)) > allowed or len(b) < 3 or len(set(b) - set(a)) > allowed:
        return False
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1] <= allowed


def furniture(line: str, title: str | None, labels: frozenset[str]) -> frozenset[str]:
    """Kinds of page furniture that a line is; empty for lines of the text."""
    bare = JUNK.sub("", line).strip()
    if not bare or HEADING.match(bare):
        return frozenset()
    if len(bare) <= 18 and PAGE.fullmatch(bare):
        return frozenset(("page_number",))
    if bare.casefold() in labels:
        return frozenset(("running_head",))
    if not title or len(bare) > len(title) + 40 or len(bare) + 4 < len(title):
        return frozenset()
    m = HEAD.fullmatch(bare)
    if m and (_near(m["title"], title) or _near(bare, title)):
        return frozenset(("running_head", "page_number")) if m["before"] or m["after"] else frozenset(("running_head",))
    return frozenset()


def _glue(before: str, after: str) -> str:
    """What joins two lines, by the characters around the line end."""
    if before[-1:].isalpha() and after[:1].isalpha() and not _HAN.search(before[-1:] + after[:1]):
        return " "
    around = before[-20:] + after[:20]
    return "" if len(_HAN.findall(around)) * 4 >= len(around) else " "


@dataclass
class Repaired:
    text: str
    kinds: frozenset[str]


def repair(text: str, title: str | None, v: Vocabulary, is_chunk: bool = False) -> Repaired:
    """Continuous paragraphs of one record, and the kinds of noise found in it."""
    kinds: set[str] = set()
    flat = v.simple(plain_form(text))
    lines = flat.split("\n")
    head = ""
    if is_chunk and lines and lines[0].startswith("〈") and lines[0].rstrip().endswith("〉"):
        head = lines.pop(0)
        path = head.strip()[1:-1].split(" > ")[0].strip()
        title = path or title
    title = v.simple(plain_form(title)).strip() if title else None
    body = []
    for line in lines:
        short = len(line) <= 60 or title is not None and len(line) <= len(title) + 44
        found = furniture(line, title, v.labels) if short else frozenset()
        kinds |= found
        if found and JUNK.search(line):
            kinds.add("misread")
        if not found:
            body.append(line)
    joined = "\n".join(body)
    if JUNK.search(joined):
        kinds.add("misread")
        joined = JUNK.sub("", joined)
    # Words cut at line ends.
    def join(m: re.Match[str]) -> str:
        left, right = m[1], m[3]
        whole = (left + right).lower()
        if m[2] == "-" and whole not in v.words and v.correct_word(whole) is None and left.lower() in v.words and right.lower() in v.words:
            return f"{left}-{right}"
        kinds.add("broken_word")
        return left + right

    joined = BROKEN.sub(join, joined)
    # Lines into paragraphs: lines of Chinese are cut anywhere, others between words.
    body = joined.split("\n")
    width = max((len(x) for x in body), default=0)
    flowed: list[str] = []
    for line, after in zip(body, [*body[1:], ""], strict=True):
        glue = _glue(line.rstrip(), after.lstrip())
        if not line.strip():
            flowed.append("\n")
        elif HEADING.match(line) or re.fullmatch(r"【.{1,12}】\s*", line):
            flowed += ["\n", line.strip(), "\n"]
        else:
            flowed.append(line if glue == "" else line.strip() + " ")
            if len(line) < 0.6 * width and END.search(line.rstrip()):
                flowed.append("\n")
    plain = re.sub(r"[ ]*\n\s*", "\n", "".join(flowed)).strip()
    plain = re.sub("(?<=[㐀-鿿，。、；：！？]) +(?=[㐀-鿿，。、；：！？])", "", plain)
    # Words and characters that were misread. What the record itself cuts off can't be judged.
    edge = (0, len(plain))

    def mend(m: re.Match[str]) -> str:
        token = m[0].rstrip("!|")
        if not token or is_chunk and (m.start() == edge[0] or m.end() == edge[1]):
            return m[0]
        meant = v.correct_word(token)
        if meant is None or re.fullmatch(r"\d+[A-Za-z]{1,3}|[A-Za-z]\d+", token):
            return m[0]
        kinds.add("misread")
        return (meant.capitalize() if token[:1].isupper() else meant) + m[0][len(token) :]

    plain = TOKEN.sub(mend, plain)
    if _HAN.search(plain):
        keep = np.array([c != " " for c in plain], bool)
        wrong = v.correct_characters(_sequence_codes(plain))
        if wrong:
            kinds.add("misread")
            places = np.flatnonzero(keep)
            chars = list(plain)
            for at, meant in wrong:
                chars[places[at]] = chr(meant)
            plain = "".join(chars)
    return Repaired((head + "\n" if head else "") + plain, frozenset(kinds))


# ---------------------------------------------------------------- tables
def _repair_rows(shared, with_text: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        v = shared.value
        for batch in batches:
            out = []
            for tab, key, title, text, chunk in zip(batch["record_table"], batch["record_key"], batch["title"], batch["text"], batch["is_chunk"], strict=True):
                done = repair(text, title, v, chunk)
                out.append((tab, key, sorted(done.kinds), done.text if with_text else None))
            yield pd.DataFrame(out, columns=["record_table", "record_key", "kinds", "repaired"])

    return run


def repaired(records: DataFrame, documents: DataFrame, with_text: bool = True, s: Settings | None = None) -> DataFrame:
    """record_table, record_key, kinds, repaired for page texts.

    records: record_table, record_key, title, text, is_chunk. documents: all documents, from
    which the vocabulary is counted. Null keys and texts are left out, an empty text stays empty
    and has no noise; equal rows give one row.
    """
    s = s or Settings()
    v = vocabulary(documents, s)
    shared = records.sparkSession.sparkContext.broadcast(v)
    given = records.select("record_table", F.col("record_key").cast("string").alias("record_key"), F.col("title").cast("string").alias("title"), F.col("text").cast("string").alias("text"), "is_chunk")
    given = given.where("record_key is not null and text is not null")
    return given.mapInPandas(_repair_rows(shared, with_text), "record_table string, record_key string, kinds array<string>, repaired string").distinct()


def kinds_found(records: DataFrame, documents: DataFrame, s: Settings | None = None) -> DataFrame:
    """record_table, record_key, noise_kind: one row for each kind of noise of a record."""
    done = repaired(records, documents, with_text=False, s=s)
    return done.select("record_table", "record_key", F.explode("kinds").alias("noise_kind")).distinct()


