"""Problem 8: the reading level of each document.

Method: a familiar-word formula. Each level has a list of words that are familiar to its
readers, taken from document frequencies; a sentence is measured, for each level, by the share
of its words outside that level's list plus how far its length is from the level's average
sentence. It was written for the level with the smallest measure, and a document has the level
of most of its sentences. Words are pairs of neighbouring Chinese characters, or English words.

The first lists come from the documents that people labelled, the final ones from all documents
of the corpus, counted by the level their sentences got from the first lists. Lists hold words
of at least ``least_share`` of a level's sentences or documents, which bounds their size by
the words of an average text divided by that share, however large the corpus is.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmere.llm.language import language
from quillmere.llm.p1_unify import look_of
from quillmere.session import cut

LEVELS = 4


@dataclass(frozen=True)
class Settings:
    #: A word is familiar at a level if its share there is at least this part of its largest share.
    lift: float = 0.55
    least_share_documents: float = 0.02
    least_share_sentences: float = 0.0005
    #: Weight of the length term, and the share of unfamiliar words from which a sentence has no level.
    length_weight: float = 0.04
    unrated: float = 0.8
    #: The first lists are fitted on at most so many labelled documents, drawn by hash; bounds what is broadcast.
    max_labels: int = 50_000
    seed: int = 5


TAG = re.compile(r"<[^<>]{0,60}>|&[a-z]{2,8};")
SPLIT = re.compile(r"[。！？!?]+|\n+|(?<=[A-Za-z)\"”])\.(?=\s|$)|\.(?=\s+[A-Z])")
WORD = re.compile(r"[a-z]+(?:['’][a-z]+)?")


def language_of(text: str | None) -> str | None:
    """zh or en for texts that get a level, else None."""
    found = language(TAG.sub(" ", text)) if text else None
    return found if found in ("zh", "en") else "en" if found == "latin" else None


_ids: dict[str, int] = {}


def _word_id(word: str) -> int:
    if (found := _ids.get(word)) is None:
        if len(_ids) > 500_000:
            _ids.clear()
        found = _ids[word] = xxhash.xxh3_64_intdigest(word) >> 1 | 1 << 62
    return found


@dataclass
class Words:
    """Word ids of texts, sentence by sentence; only sentences with words count."""

    ids: np.ndarray
    #: For each sentence where its words start, how many they are, and the number of its text.
    starts: np.ndarray
    lengths: np.ndarray
    text: np.ndarray

    @property
    def sentence(self) -> np.ndarray:
        """The number of the sentence of each word."""
        return np.repeat(np.arange(len(self.lengths)), self.lengths)


def _sentences(text: str, lang: str) -> str:
    """A text with one sentence a line."""
    flat = TAG.sub("\n", look_of(text))
    return SPLIT.sub("\n", flat.lower() if lang == "zh" else flat)


def words_of(texts: list[str], lang: str) -> Words:
    """The words of several texts at once: pairs of neighbouring Chinese characters, or English words."""
    lines = [_sentences(t, lang) for t in texts]
    if lang == "zh":
        c = np.frombuffer("\n".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        han = (c >= 0x3400) & (c < 0xA000)
        pairs = np.flatnonzero(han[1:] & han[:-1])
        ids, line = c[pairs] << 21 | c[pairs + 1], np.cumsum(c == 10)[pairs]
    else:
        found = [list(map(_word_id, WORD.findall(x))) for x in "\n".join(lines).lower().split("\n")]
        line = np.repeat(np.arange(len(found)), list(map(len, found)))
        ids = np.fromiter((w for x in found for w in x), np.int64, len(line))
    used, starts, lengths = np.unique(line, return_index=True, return_counts=True)
    # Texts follow each other, each with its number of lines.
    last = np.cumsum([x.count("\n") + 1 for x in lines]) if lines else np.empty(0, np.int64)
    return Words(ids, starts, lengths, np.searchsorted(last, used, "right"))


@dataclass
class Lists:
    """Sorted word ids with a mask of the levels they are familiar at, and mean log lengths."""

    ids: np.ndarray
    masks: np.ndarray
    log_length: np.ndarray


def make_lists(counts: pd.DataFrame, totals: np.ndarray, log_length: np.ndarray, least: float, s: Settings) -> Lists:
    """counts: word and n1 to n4, how many documents or sentences of each level have the word."""
    n = counts[[f"n{k}" for k in range(1, LEVELS + 1)]].to_numpy(np.float64)
    share = n / np.maximum(totals, 1)
    top = share.max(axis=1, keepdims=True)
    familiar = (share >= s.lift * top) & (top >= least)
    masks = (familiar * (1 << np.arange(LEVELS))).sum(axis=1).astype(np.uint8)
    words = counts["word"].to_numpy(np.int64)
    kept = np.flatnonzero(masks)
    order = kept[np.argsort(words[kept], kind="stable")]
    return Lists(words[order], masks[order], log_length)


def rate(words: Words, lists: Lists, s: Settings) -> np.ndarray:
    """Level 0 to 3 of each sentence, -1 for those without a level."""
    if not len(words.ids) or not len(lists.ids):
        return np.full(len(words.lengths), -1)
    at = np.minimum(np.searchsorted(lists.ids, words.ids), len(lists.ids) - 1)
    masks = np.where(lists.ids[at] == words.ids, lists.masks[at], 0)
    inside = np.add.reduceat((masks[:, None] >> np.arange(LEVELS) & 1).astype(np.int64), words.starts, axis=0)
    outside = 1 - inside / words.lengths[:, None]
    off = np.abs(np.log(words.lengths)[:, None] - lists.log_length[None, :])
    level = (outside + s.length_weight * np.minimum(off, 2)).argmin(axis=1)
    level[outside.min(axis=1) >= s.unrated] = -1
    return level


def document_levels(levels: np.ndarray, words: Words, lists: Lists, count: int) -> np.ndarray:
    """Level 1 to 4 of each of count texts: of most of its sentences; of equal numbers the one with
    more words, then the lower. Without a rated sentence, the level whose average sentence is
    nearest in length; without any words the first."""
    rated = np.flatnonzero(levels >= 0)
    place = words.text[rated] * LEVELS + levels[rated]
    n = np.bincount(place, minlength=count * LEVELS).reshape(count, LEVELS)
    size = np.bincount(place, weights=words.lengths[rated], minlength=count * LEVELS).reshape(count, LEVELS)
    found = (n * float(1 << 31) + size).argmax(axis=1) + 1
    sentences = np.bincount(words.text, minlength=count)
    logs = np.bincount(words.text, weights=np.log(words.lengths), minlength=count) / np.maximum(sentences, 1)
    near = np.abs(logs[:, None] - lists.log_length[None, :]).argmin(axis=1) + 1
    return np.where(n.any(axis=1), found, np.where(sentences > 0, near, 1))


LANGS = ("zh", "en")


def _read(batch: pd.DataFrame, langs: tuple[str, ...] = LANGS) -> Iterator[tuple[str, np.ndarray, Words]]:
    """By language the rows of a batch in it, and their words."""
    told = [language_of(t) for t in batch["text"]]
    for lang in langs:
        rows = np.array([k for k, x in enumerate(told) if x == lang], np.int64)
        if len(rows):
            yield lang, rows, words_of([batch["text"].iloc[k] for k in rows], lang)


def _tally(lang: str, words: Words, unit: np.ndarray, level: np.ndarray) -> list[pd.DataFrame]:
    """In how many units of each level each word occurs. unit: of each word; level: of each unit, -1 for none."""
    order = np.lexsort((words.ids, unit))
    ids, unit = words.ids[order], unit[order]
    new = np.ones(len(ids), bool)
    new[1:] = (ids[1:] != ids[:-1]) | (unit[1:] != unit[:-1])
    ids, at = ids[new], level[unit[new]]
    out = []
    for k in range(LEVELS):
        found, n = np.unique(ids[at == k], return_counts=True)
        # Word 0 counts the units.
        out.append(pd.DataFrame({"lang": lang, "word": np.append(found, 0), "level": k, "n": np.append(n, (level == k).sum()).astype(np.float64)}))
    return out


def _logs(lang: str, lengths: np.ndarray, level: np.ndarray) -> pd.DataFrame:
    """Sums of the log lengths of units by level, as word -1."""
    rated = level >= 0
    return pd.DataFrame({"lang": lang, "word": -1, "level": np.arange(LEVELS), "n": np.bincount(level[rated], weights=lengths[rated], minlength=LEVELS)})


COUNTED = "lang string, word long, level int, n double"


def _labelled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Distinct words of labelled documents, one unit a document."""
    for batch in batches:
        given, out = batch["level"].to_numpy() - 1, []
        for lang, rows, words in _read(batch):
            n = np.bincount(words.text, minlength=len(rows))
            means = np.bincount(words.text, weights=np.log(words.lengths), minlength=len(rows)) / np.maximum(n, 1)
            out += [*_tally(lang, words, words.text[words.sentence], given[rows]), _logs(lang, means, given[rows])]
        if out:
            yield pd.concat(out)


def _lists_from(counted: DataFrame, least: float, s: Settings) -> dict[str, Lists]:
    """Lists of each language; only words that reach the least share at some level leave the cluster."""
    wide = cut(counted.groupBy("lang", "word").agg(*[F.sum(F.when(F.col("level") == k, F.col("n")).otherwise(0.0)).alias(f"n{k + 1}") for k in range(LEVELS)]))
    heads = {(r["lang"], r["word"]): np.array([r[f"n{k}"] for k in range(1, LEVELS + 1)]) for r in wide.where("word in (0, -1)").collect()}
    lists = {}
    for lang in LANGS:
        totals = heads.get((lang, 0), np.zeros(LEVELS))
        logs = np.where(totals > 0, heads.get((lang, -1), np.zeros(LEVELS)) / np.maximum(totals, 1), 1e9)
        enough = [F.col(f"n{k + 1}") >= max(2.0, least * float(totals[k])) for k in range(LEVELS) if totals[k] > 0]
        if not enough:
            continue
        some = enough[0]
        for e in enough[1:]:
            some = some | e
        words = wide.where((F.col("lang") == lang) & (F.col("word") > 0) & some).toPandas()
        lists[lang] = make_lists(words, totals, logs, least, s)
    return lists


def levels(documents: DataFrame, labels: DataFrame, s: Settings | None = None) -> DataFrame:
    """doc_id, reading_level for every document in Chinese or English that is not empty.

    labels: doc_id, reading_level. Null and impossible labels are ignored, repeated rows of one
    annotator count once, and the commonest level of a document counts (of equals the middle,
    rounded down). Without any label there is no scale and no row. A doc_id that comes with
    several texts gets the level of its first text in order.
    """
    s = s or Settings()
    spark = documents.sparkSession
    kind = dict(documents.dtypes)["doc_id"]
    rows = documents.select("doc_id", F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null")
    votes = labels.select("doc_id", F.col("reading_level").cast("int").alias("level"), *([F.col("annotator")] if "annotator" in labels.columns else [])).where(f"level between 1 and {LEVELS} and doc_id is not null").distinct()
    by_level = votes.groupBy("doc_id", "level").agg(F.count("*").alias("n"))
    best = by_level.groupBy("doc_id").agg(F.max("n").alias("n"))
    agreed = by_level.join(best, ["doc_id", "n"]).groupBy("doc_id").agg(F.floor(F.avg("level")).cast("int").alias("level"))
    # A bounded sample, so the texts needn't be shuffled to meet their labels.
    agreed = agreed.orderBy(F.xxhash64(F.lit(s.seed), "doc_id"), "doc_id").limit(s.max_labels)
    first = _lists_from(rows.join(F.broadcast(agreed), "doc_id").select("level", "text").mapInPandas(_labelled, COUNTED), s.least_share_documents, s)
    if not first:
        return spark.createDataFrame([], f"doc_id {kind}, reading_level int")
    rough = spark.sparkContext.broadcast(first)

    def by_sentence(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lists = rough.value
        for batch in batches:
            out = []
            for lang, _, words in _read(batch, tuple(lists)):
                level = rate(words, lists[lang], s)
                out += [*_tally(lang, words, words.sentence, level), _logs(lang, np.log(words.lengths), level)]
            if out:
                yield pd.concat(out)

    final = _lists_from(rows.select("text").mapInPandas(by_sentence, COUNTED), s.least_share_sentences, s)
    shared = spark.sparkContext.broadcast(final or first)

    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lists = shared.value
        for batch in batches:
            keys = batch["doc_id"].to_numpy()
            for lang, rows, words in _read(batch, tuple(lists)):
                told = document_levels(rate(words, lists[lang], s), words, lists[lang], len(rows))
                ids = [xxhash.xxh3_64_intdigest(batch["text"].iloc[k].encode("utf-8", "surrogatepass")) >> 1 for k in rows]
                yield pd.DataFrame({"doc_id": keys[rows], "reading_level": told, "text_id": ids})

    found = rows.mapInPandas(decide, f"doc_id {kind}, reading_level int, text_id long")
    return found.groupBy("doc_id").agg(F.min(F.struct("text_id", "reading_level")).alias("m")).select("doc_id", F.col("m.reading_level").alias("reading_level"))
