"""Problem 6: evaluation texts that leak into training texts.

Method: n-grams of the test items seed the search. A document and an item that share, near one
diagonal, as many seeds as a copy with few edits must keep (q-gram lemma) are aligned by
Smith-Waterman; the alignment decides. Of the places where a document may hold an item, those
with the rarest seed are aligned first, by the number of such places in the corpus in which the
seed stands; rarity rules none out, as copies of a leaked passage make its own seeds frequent.

Both sides are compared by letters and digits only, after unification of width, case and
look-alikes and with traditional characters simplified. A question leaks if all of it is found
with at most ``edits`` changed characters; an answer if a connected stretch of at least
``part`` of it is. The items are indexed and sent to all tasks in blocks of at most
``block_letters``; each block reads the documents once. Documents are never shuffled and each is
read whole; what is kept of them between scan and alignment is the places found.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmere.llm.p1_unify import look_of
from quillmere.llm.scripts import Simplifier, simplified
from quillmere.session import cut


@dataclass(frozen=True)
class Settings:
    edits: int = 2
    part: float = 0.5
    #: Seed length for items mainly in Chinese, Japanese or Korean, and for others.
    dense_seed: int = 7
    sparse_seed: int = 16
    #: Letters of the items of one block; an index takes about 30 bytes a letter.
    block_letters: int = 4_000_000


#: Seed lengths in use, so that few passes over a text serve all items.
LENGTHS = (1, 2, 3, 4, 5, 7, 10, 13, 16)


_WORDLESS = re.compile(r"[\W_]+")
_DENSE = re.compile("[぀-ヿ㐀-鿿가-힯]")


def letters(text: str | None, simple: Simplifier) -> str:
    return simple(_WORDLESS.sub("", look_of(text)).casefold()) if text else ""


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


_BASE = 0x9E3779B97F4A7C15
_ODD = 0xD6E8FEB86659FD93
_ALL = (1 << 64) - 1


def _grams(codes: np.ndarray, lengths: tuple[int, ...]) -> dict[int, np.ndarray]:
    """64-bit hashes of all n-grams of a code array, for each n: made of those of 1, 2, 4, ... letters."""
    out: dict[int, np.ndarray] = {}
    with np.errstate(over="ignore"):
        powers = [codes.astype(np.uint64) * np.uint64(_BASE)]
        while 2 ** len(powers) <= max(lengths, default=0):
            half, k = powers[-1], 2 ** (len(powers) - 1)
            powers.append(half[: max(0, len(half) - k)] * np.uint64(pow(_ODD, k, _ALL + 1)) + half[k:] if len(half) > k else half[:0])
        for n in lengths:
            count = len(codes) - n + 1
            if count <= 0:
                out[n] = np.empty(0, np.uint64)
                continue
            made, at = np.zeros(count, np.uint64), 0
            for bit in reversed(range(n.bit_length())):
                if n >> bit & 1:
                    made = made * np.uint64(pow(_ODD, 1 << bit, _ALL + 1)) + powers[bit][at : at + count]
                    at += 1 << bit
            out[n] = made ^ (made >> np.uint64(29))
    return out


@dataclass
class Index:
    """Seeds of a block of items: sorted hashes, and for each where it lies in which pattern."""

    qids: list[str] = field(default_factory=list)
    patterns: list[np.ndarray] = field(default_factory=list)
    whole: list[bool] = field(default_factory=list)
    owner: list[int] = field(default_factory=list)
    by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=dict)
    need: list[int] = field(default_factory=list)
    lists: dict[int, np.ndarray] = field(default_factory=dict)


def build(items: list[tuple[str, str | None, str | None]], simple: Simplifier, s: Settings) -> Index:
    ix = Index()
    gathered: dict[int, list[tuple[np.ndarray, int]]] = {}
    for qid, question, answer in items:
        for text, whole in ((question, True), (answer, False)):
            form = letters(text, simple)
            n = s.dense_seed if 2 * len(_DENSE.findall(form)) >= len(form) else s.sparse_seed
            span = len(form) if whole else math.ceil(len(form) * s.part)
            # So short that a seed is left after the edits; what is no longer than the edits must stand as it is.
            n = min(n, span // (s.edits + 1)) if span > s.edits else max(1, span)
            n = max(k for k in LENGTHS if k <= n)
            if not form:
                continue
            k = len(ix.patterns)
            ix.patterns.append(_codes(form))
            ix.whole.append(whole)
            ix.owner.append(len(ix.qids))
            # Each edit spoils at most n seeds of the span that must be there.
            ix.need.append(max(1, span - n + 1 - s.edits * n))
            gathered.setdefault(n, []).append((_grams(ix.patterns[k], (n,))[n], k))
        ix.qids.append(qid)
    for n, parts in gathered.items():
        hashes = np.concatenate([h for h, _ in parts])
        pattern = np.concatenate([np.full(len(h), k, np.int32) for h, k in parts])
        offset = np.concatenate([np.arange(len(h), dtype=np.int32) for h, _ in parts])
        order = np.argsort(hashes, kind="stable")
        seeds, starts = np.unique(hashes[order], return_index=True)
        ix.by_length[n] = (seeds, np.append(starts, len(hashes)), pattern[order], offset[order])
        ix.lists[n] = _sieve(seeds)
    return ix


def _sieve(seeds: np.ndarray) -> np.ndarray:
    sieve = np.zeros(1 << 22, bool)
    sieve[(seeds >> np.uint64(20)).astype(np.int64) & (len(sieve) - 1)] = True
    return sieve


def _hits(grams: np.ndarray, n: int, ix: Index) -> tuple[np.ndarray, np.ndarray]:
    """Positions of seeds among the n-grams of a text, and the numbers of the seeds."""
    seeds = ix.by_length[n][0]
    if not len(grams) or not len(seeds):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    sieve = ix.lists[n]
    maybe = np.flatnonzero(sieve[(grams >> np.uint64(20)).astype(np.int64) & (len(sieve) - 1)])
    at = np.minimum(np.searchsorted(seeds, grams[maybe]), len(seeds) - 1)
    true = seeds[at] == grams[maybe]
    return maybe[true], at[true]


def align(pattern: np.ndarray, text: np.ndarray, penalty: int = 2) -> list[tuple[int, int]]:
    """Smith-Waterman: the best local alignment as (pattern position, text position) steps.

    A step that lacks one side (-1) is a gap. Matches score 1, anything else -penalty.
    """
    rows, cols = len(pattern), len(text)
    h = np.zeros((rows + 1, cols + 1), np.int32)
    slope = penalty * np.arange(cols + 1, dtype=np.int32)
    for i in range(1, rows + 1):
        same = np.where(text == pattern[i - 1], 1, -penalty)
        row = np.maximum(0, np.maximum(h[i - 1] - penalty, np.concatenate(([0], h[i - 1, :-1] + same))))
        h[i] = np.maximum(np.maximum.accumulate(row + slope) - slope, 0)
    i, j = np.unravel_index(int(h.argmax()), h.shape)
    steps: list[tuple[int, int]] = []
    while h[i, j] > 0:
        score = h[i, j]
        if i and j and score == h[i - 1, j - 1] + (1 if pattern[i - 1] == text[j - 1] else -penalty):
            i, j = i - 1, j - 1
            steps.append((int(i), int(j)))
        elif i and score == h[i - 1, j] - penalty:
            i -= 1
            steps.append((int(i), -1))
        else:
            j -= 1
            steps.append((-1, int(j)))
    return steps[::-1]


def fewest_edits(pattern: np.ndarray, text: np.ndarray) -> int:
    """Edits that the whole pattern needs at its best place in the text."""
    steps = np.arange(len(text) + 1)
    row = np.zeros(len(text) + 1, np.int64)
    for c in pattern:
        row = np.minimum(row + 1, np.concatenate(([len(pattern)], row[:-1] + (text != c))))
        row = np.minimum.accumulate(row - steps) + steps
    return int(row.min())


def stretch(pattern: np.ndarray, text: np.ndarray, edits: int) -> tuple[int, int]:
    """Longest run of pattern characters found with at most so many edits in the best alignment,
    and the edits a find of the whole pattern needs."""
    steps = align(pattern, text)
    if not steps:
        return 0, len(pattern)
    wrong = [k for k, (a, b) in enumerate(steps) if a < 0 or b < 0 or pattern[a] != text[b]]
    bounds = [-1, *wrong, len(steps)]
    best = 0
    for lo in range(len(bounds) - 1):
        hi = min(lo + edits + 1, len(bounds) - 1)
        best = max(best, sum(1 for a, _ in steps[bounds[lo] + 1 : bounds[hi]] if a >= 0))
    return best, fewest_edits(pattern, text)


@dataclass
class Place:
    """A part of a text that may hold a pattern: letters, and the seeds that point to it."""

    pattern: int
    letters: np.ndarray
    n: int
    seeds: np.ndarray


def places(codes: np.ndarray, hits: dict[int, tuple[np.ndarray, np.ndarray]], ix: Index, s: Settings) -> Iterator[Place]:
    """Where one document holds enough seeds of a pattern near one diagonal."""
    need = np.array(ix.need)
    for n, (where, seed) in hits.items():
        if not len(where):
            continue
        _, starts, pattern_of, offset_of = ix.by_length[n]
        counts = starts[seed + 1] - starts[seed]
        flat = np.repeat(starts[seed], counts) + (np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts))
        place, number = np.repeat(where, counts), np.repeat(seed, counts)
        pattern, offset = pattern_of[flat], offset_of[flat]
        order = np.lexsort((place - offset, pattern))
        pattern, place, offset, number = pattern[order], place[order], offset[order], number[order]
        # Groups of one pattern whose neighbouring diagonals differ by few edits.
        breaks = np.flatnonzero((np.diff(pattern) != 0) | (np.diff(place - offset) > s.edits)) + 1
        first, last = np.concatenate(([0], breaks)), np.concatenate((breaks, [len(pattern)]))
        enough = last - first >= need[pattern[first]]
        for a, b in zip(first[enough], last[enough], strict=True):
            p = int(pattern[a])
            span = len(ix.patterns[p])
            lo = max(0, int(place[a:b].min()) - int(offset[a:b].max()) - 2 * s.edits - n)
            hi = min(len(codes), int(place[a:b].max()) + span + n + 2 * s.edits)
            # Long parts, of texts that repeat themselves, go piece by piece; pieces overlap by more than a pattern.
            step = 4 * span + 200
            for x in range(lo, max(lo + 1, hi - span - 4 * s.edits), step):
                y = min(hi, x + step + span + 4 * s.edits)
                inside = (place[a:b] >= x) & (place[a:b] < y)
                if inside.any():
                    yield Place(p, codes[x:y], n, np.unique(number[a:b][inside]))


def holds(place: Place, ix: Index, s: Settings) -> bool:
    """Whether the letters of a place contain enough of its pattern."""
    pattern = ix.patterns[place.pattern]
    run, cost = stretch(pattern, place.letters, s.edits)
    return cost <= s.edits if ix.whole[place.pattern] else run >= math.ceil(len(pattern) * s.part)


def _scan(batch: pd.DataFrame, ix: Index, simple: Simplifier, s: Settings) -> Iterator[tuple[int, np.ndarray, dict[int, tuple[np.ndarray, np.ndarray]]]]:
    """Of a batch the documents with seeds: row, letters, and for each seed length where which seed stands."""
    forms = [letters(t, simple) if t else "" for t in batch["text"]]
    # All texts in one array, parted by a code that no item has; grams across it are no seeds.
    sizes = np.fromiter((len(f) + 1 for f in forms), np.int64, len(forms))
    begins = np.cumsum(sizes) - sizes
    codes = _codes("\0".join(forms) + "\0")
    grams = _grams(codes, tuple(ix.by_length))
    found = {n: _hits(grams[n], n, ix) for n in ix.by_length}
    row_of = {n: np.searchsorted(begins, where, "right") - 1 for n, (where, _) in found.items()}
    for k in sorted(set().union(*(np.unique(r).tolist() for r in row_of.values()))) if row_of else ():
        own = {}
        for n, (where, seed) in found.items():
            lo, hi = np.searchsorted(row_of[n], (k, k + 1))
            own[n] = where[lo:hi] - begins[k], seed[lo:hi]
        yield k, codes[begins[k] : begins[k] + sizes[k] - 1], own


def _blocks(items: DataFrame, s: Settings) -> Iterator[list[tuple[str, str | None, str | None]]]:
    """The items in blocks of a bounded number of characters, without holding more than one block."""
    given = items.select("qid", "question", "reference_answer").where("qid is not null").distinct().orderBy("qid", "question", "reference_answer")
    block: list[tuple[str, str | None, str | None]] = []
    size = 0
    for r in given.toLocalIterator():
        block.append((r[0], r[1], r[2]))
        size += len(r[1] or "") + len(r[2] or "")
        if size >= s.block_letters:
            yield block
            block, size = [], 0
    if block:
        yield block


def leaks(documents: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", s: Settings | None = None) -> DataFrame:
    """key, qid: documents that contain an item's question or enough of its reference answer.

    items: qid, question, reference_answer. Null keys, texts and qids are skipped; repeated rows
    give one row. An empty set of items gives no row.
    """
    s = s or Settings()
    spark = documents.sparkSession
    simple = Simplifier(simplified(spark))
    kind = dict(documents.dtypes)[key]
    rows = documents.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).where("key is not null and text is not null")
    out = spark.createDataFrame([], f"{key} {kind}, qid string")
    for block in _blocks(items, s):
        shared = spark.sparkContext.broadcast((build(block, simple, s), simple))

        def scan(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            ix, simple = shared.value
            for batch in batches:
                keys = batch["key"].to_numpy()
                out = [(keys[k], ix.owner[p.pattern], p.pattern, p.letters.tobytes(), p.n, p.seeds.tolist()) for k, codes, hits in _scan(batch, ix, simple, s) for p in places(codes, hits, ix, s)]
                yield pd.DataFrame(out, columns=["key", "item", "pattern", "letters", "n", "seeds"])

        place = cut(rows.mapInPandas(scan, f"key {kind}, item int, pattern int, letters binary, n int, seeds array<long>"))
        seeds = place.select("key", "n", F.explode("seeds").alias("seed")).groupBy("n", "seed").agg(F.count("*").alias("df"))
        # No more rows than the block has seeds.
        frequency = {(r["n"], r["seed"]): r["df"] for r in seeds.collect()}
        marked = spark.sparkContext.broadcast(frequency)

        def decide(batches: Iterator[pd.DataFrame], shared=shared, marked=marked) -> Iterator[pd.DataFrame]:
            ix, _ = shared.value
            df = marked.value
            for batch in batches:
                out = []
                batch["rarest"] = [min(df.get((n, int(x)), 0) for x in seeds) for n, seeds in zip(batch["n"], batch["seeds"], strict=True)]
                for (_, item), group in batch.sort_values("rarest", kind="stable").groupby(["key", "item"], sort=False):
                    if any(holds(Place(p, np.frombuffer(x, np.uint32), n, None), ix, s) for p, x, n in zip(group["pattern"], group["letters"], group["n"], strict=True)):
                        out.append((group["key"].iloc[0], ix.qids[item]))
                yield pd.DataFrame(out, columns=[key, "qid"])

        out = out.unionByName(place.mapInPandas(decide, f"{key} {kind}, qid string"))
    return out.distinct()
