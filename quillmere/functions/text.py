"""Text expressions. All but three are SQL expressions that stay in the JVM.

Every function takes a column and gives a column; null gives null unless said otherwise.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

CJK = r"\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{f900}-\x{faff}"
CJK_CORE = r"\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}"
CJK_MARKS = r"\x{3000}-\x{303f}\x{ff00}-\x{ffef}"
GARBAGE = r"[\x{fffd}\x{25a1}\x{25a0}\x{25c6}\x{2605}\x{e000}-\x{f8ff}]"
CONTROL = r"[\x{00}-\x{08}\x{0b}\x{0c}\x{0e}-\x{1f}\x{7f}]"
#: White space as Unicode counts it.
SPACE = r"[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
PYTHON_SPACE = re.compile("[ \t\n\x0b\f\r\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")

# Words that search leaves out.
STOPWORDS = tuple("的 了 是 在 和 与 及 或 而 等 为 对 之 其 者 也 于 以 则 乃 但 且 夫 盖".split())


def _c(column: Column | str) -> Column:
    return F.col(column) if isinstance(column, str) else column


def squeeze(text: Column | str) -> Column:
    """The text without any white space."""
    return F.regexp_replace(_c(text), SPACE + "+", "")


def python_squeeze(text: str) -> str:
    """squeeze for Python code."""
    # Python splits at four control characters too, which aren't white space in SQL.
    return "".join(text.split()) if not any(c in text for c in "\x1c\x1d\x1e\x1f") else PYTHON_SPACE.sub("", text)


def strip(text: Column) -> Column:
    """The text without white space at its ends."""
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def count_tokens(text: Column | str) -> Column:
    """Estimated tokens: one for each CJK character and mark, one for each four letters of a word."""
    t = _c(text)
    words = F.aggregate(F.regexp_extract_all(t, F.lit("[A-Za-z0-9]+"), F.lit(0)), F.lit(0), lambda a, w: (a + F.ceil(F.length(w) / F.lit(4.0))).cast("int"))
    return (F.regexp_count(t, F.lit(f"[{CJK}]")) + F.regexp_count(t, F.lit(f"[{CJK_MARKS}]")) + words).cast("int")


def python_tokens(text: str) -> int:
    """count_tokens for Python code that needs it step by step."""
    n = run = 0
    for c in text:
        o = ord(c)
        if o < 128 and c.isalnum():
            n += run % 4 == 0
            run += 1
            continue
        run = 0
        n += 0x3400 <= o <= 0x4DBF or 0x4E00 <= o <= 0x9FFF or 0xF900 <= o <= 0xFAFF or 0x3000 <= o <= 0x303F or 0xFF00 <= o <= 0xFFEF
    return n


def python_truncate(text: str, limit: int) -> str:
    """The longest prefix of at most limit tokens, in one pass: tokens never decrease with length."""
    n = run = 0
    for k, c in enumerate(text):
        o = ord(c)
        if o < 128 and c.isalnum():
            n += run % 4 == 0
            run += 1
        else:
            run = 0
            n += 0x3400 <= o <= 0x4DBF or 0x4E00 <= o <= 0x9FFF or 0xF900 <= o <= 0xFAFF or 0x3000 <= o <= 0x303F or 0xFF00 <= o <= 0xFFEF
        if n > limit:
            return text[:k]
    return text


def truncate_to_tokens(text: Column | str, limit: int) -> Column:
    """The longest prefix of at most limit tokens; texts that fit never leave the JVM's batch."""

    @F.pandas_udf("string")
    def cut(values: pd.Series) -> pd.Series:
        return values.map(lambda v: python_truncate(v, limit), na_action="ignore")

    return cut(_c(text))


def split_sentences(text: Column | str) -> Column:
    """Sentences with their end mark; a line break ends one, a Latin full stop doesn't."""
    return F.filter(F.transform(F.split(_c(text), r"(?<=[。！？；!?;\n])"), strip), lambda x: x != "")


def split_paragraphs(text: Column | str) -> Column:
    return F.filter(F.transform(F.split(_c(text), r"\n"), strip), lambda x: x != "")


def evidence_sentences(text: Column | str) -> Column:
    """Sentences of at least six characters, without the title line of a chunk."""
    body = F.regexp_replace(strip(_c(text)), r"^〈[^〉]*〉\s*", "")
    return F.filter(F.transform(F.split(body, r"(?<=[。！？；\n])"), strip), lambda x: F.length(x) >= 6)


def clauses(text: Column | str) -> Column:
    return F.filter(F.transform(F.split(_c(text), r"[。！？；\n，,]"), strip), lambda x: F.length(x) >= 4)


def claims(answer: Column | str) -> Column:
    """Statements of an answer without their citation marks."""
    bare = F.regexp_replace(_c(answer), r"〔\d+〕|\[[\w#]+\]", "")
    return F.filter(F.transform(F.split(bare, r"[。！？；\n]"), strip), lambda x: F.length(x) >= 8)


def garbage_count(text: Column | str) -> Column:
    return F.regexp_count(_c(text), F.lit(GARBAGE))


WIDE = "".join(chr(c) for a, b in ((0xFF10, 0xFF1A), (0xFF21, 0xFF3B), (0xFF41, 0xFF5B)) for c in range(a, b))
NARROW = "".join(chr(ord(c) - 0xFEE0) for c in WIDE)
CJK_GAP = rf"(?<=[{CJK_CORE}])[ \t\x{{3000}}]+(?=[{CJK_CORE}])"


def normalize(text: Column | str) -> Column:
    """struct(text, n_space, n_garbage): control and garbage signs out, digits and letters
    narrow, no gaps between CJK characters, single spaces, at most one blank line."""
    t = _c(text)
    bare = F.translate(F.regexp_replace(F.regexp_replace(t, CONTROL, ""), GARBAGE, ""), WIDE, NARROW)
    tight = F.regexp_replace(F.regexp_replace(F.regexp_replace(bare, CJK_GAP, ""), r"[ \t]{2,}", " "), r"\n{3,}", "\n\n")
    return F.struct(tight.alias("text"), F.regexp_count(bare, F.lit(CJK_GAP)).alias("n_space"), garbage_count(t).alias("n_garbage"))


def noise_score(text: Column | str, n_fixes: Column | int = 0) -> Column:
    """Share of garbage, gaps (times .6) and repairs (times 1.2) in a text, at most 1; 0 for an empty one."""
    t = _c(text)
    n = n_fixes if isinstance(n_fixes, Column) else F.lit(n_fixes)
    raw = (garbage_count(t) + 0.6 * F.regexp_count(t, F.lit(CJK_GAP)) + 1.2 * n) / F.greatest(F.length(t), F.lit(1))
    return F.when(t.isNull(), None).when(F.length(t) == 0, 0.0).otherwise(F.floor(F.least(F.lit(1.0), raw) * 10000 + 0.5) / 10000)


def bigrams(text: Column | str) -> Column:
    """Distinct pairs of neighbouring characters, white space left out; none for a single character."""
    # A look-ahead finds the pairs that overlap too, in one pass; not from within a surrogate pair.
    return F.array_distinct(F.regexp_extract_all(squeeze(_c(text)), F.lit(r"(?s)(?=([^\x{DC00}-\x{DFFF}].))"), F.lit(1)))


def statement_bigrams(text: Column | str) -> Column:
    """As bigrams, but a single character stands for itself."""
    s = squeeze(_c(text))
    return F.when(F.length(s) == 1, F.array(s)).otherwise(bigrams(text))


def jaccard(a: Column, b: Column) -> Column:
    """Common share of two sets; 0 if either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(both / (F.size(a) + F.size(b) - both))


def coverage(part: Column, whole: Column) -> Column:
    """Share of one set that is in another; 0 for an empty set."""
    return F.size(F.array_intersect(part, whole)) / F.greatest(F.size(part), F.lit(1))


#: Found at each place by looking ahead, so that pairs may overlap.
TOKEN = rf"(?=([{CJK_CORE}]{{2}}|(?<![{CJK_CORE}])[{CJK_CORE}](?![{CJK_CORE}])|(?<![a-z0-9])[a-z0-9]+))"


def tokens(text: Column | str) -> Column:
    """Search tokens in order, repeats kept: words and numbers in lower case, and for CJK text
    each pair of neighbouring characters (a lone character stands for itself)."""
    found = F.regexp_extract_all(F.lower(_c(text)), F.lit(TOKEN), F.lit(1))
    stop = F.array(*map(F.lit, STOPWORDS))
    return F.filter(found, lambda x: ~F.array_contains(stop, x))


# Chinese numerals that are read; larger compounds are not.
NUMERALS = {"一": 1.0, "二": 2.0, "两": 2.0, "三": 3.0, "四": 4.0, "五": 5.0, "六": 6.0, "七": 7.0, "八": 8.0, "九": 9.0, "十": 10.0, "半": 0.5}


def chinese_number(text: Column | str) -> Column:
    """A numeral as a number: digits, one to ten, a half, and eleven to nineteen; else null."""
    t = _c(text)
    one = F.create_map(*[F.lit(x) for pair in NUMERALS.items() for x in pair])
    teen = F.lit(10.0) + one[F.substring(t, 2, 1)]
    return F.coalesce(F.expr("cast(null as double)") if t is None else t.try_cast("double"), one[t], F.when((F.length(t) == 2) & t.startswith("十"), teen))


def repaired_json(text: Column | str, schema: str) -> Column:
    """The object within a text that may be fenced or surrounded by talk, by its schema; null if there is none."""
    return F.from_json(F.nullif(F.regexp_extract(_c(text), r"(?s)\{.*\}", 0), F.lit("")), schema)


#: Blocks of at least this many characters are looked for through the places of their first ones.
SEED = 8
#: Characters of either side whose blocks are looked for at once.
TOGETHER = 1 << 15
# Odd factors of the hash of SEED characters, and of the number of a pair.
FACTORS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def _numbered(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each part begins, and the number of the part that each place belongs to."""
    return np.concatenate(([0], np.cumsum(lengths))), np.repeat(np.arange(len(lengths)), lengths)


def _seed_runs(codes: np.ndarray, la: np.ndarray, lb: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All blocks of at least SEED characters that can't be made longer: where they begin in a and
    in b, and their size, in order of a and b; and which pairs repeat themselves too much.

    codes holds all a, then all b.
    """
    n, na = len(la), int(la.sum())
    ends, owner = _numbered(np.concatenate((la, lb)))
    bits = np.uint64(len(codes).bit_length())
    low = (np.uint64(1) << bits) - np.uint64(1)
    h = codes[:-1] * FACTORS[0] + codes[1:] * FACTORS[1]
    h = h[:-2] + h[2:] * FACTORS[2]
    h = h[:-4] + h[4:] * FACTORS[3]
    place = np.flatnonzero(owner[: len(h)] == owner[SEED - 1 :])
    key = h[place] + (owner[place] % n).astype(np.uint64) * FACTORS[4]
    key = np.sort(key & ~low | place.astype(np.uint64))
    place = (key & low).astype(np.int64)
    key >>= bits
    first = np.flatnonzero(np.diff(key, prepend=~key[:1]))
    in_a = np.add.reduceat(place < na, first, dtype=np.int64) if len(first) else first
    in_b = np.diff(first, append=len(place)) - in_a
    met = (in_a > 0) & (in_b > 0)
    first, in_a, in_b = first[met], in_a[met], in_b[met]
    pair = owner[place[first]]
    heavy = np.bincount(pair, in_a * in_b, n) > np.minimum(16 * (la + lb), np.maximum(2 * (la + lb), 1 << 20))
    kept = ~heavy[pair]
    first, in_a, in_b = first[kept], in_a[kept], in_b[kept]
    once = (in_a == 1) & (in_b == 1)
    i, j = place[first[once]], place[first[once] + 1]
    if not once.all():
        first, in_a, in_b = first[~once], in_a[~once], in_b[~once]
        at, which = _numbered(in_a * in_b)
        k = np.arange(at[-1]) - at[which]
        i = np.concatenate((i, place[first[which] + k // in_b[which]]))
        j = np.concatenate((j, place[first[which] + in_a[which] + k % in_b[which]]))
    # Equal hashes may be of different characters, or of another pair.
    same = owner[j] - owner[i] == n
    for k in range(SEED):
        same &= codes[i + k] == codes[j + k]
    i, j = i[same], j[same]
    # On a diagonal, one that follows another goes on with its block.
    key = np.sort((j - i) << np.int64(bits) | i)
    begin = np.flatnonzero(np.diff(key, prepend=-2) != 1)
    size = np.diff(begin, append=len(key)) + SEED - 1
    i, diagonal = key[begin] & np.int64(low), key[begin] >> np.int64(bits)
    order = np.lexsort((diagonal, i))
    return i[order], (i + diagonal)[order], size[order], heavy


def _taken(i: np.ndarray, j: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The blocks that remain of these where the longest is taken, then the first in a, then the
    first in b, and the same is done on both sides of it; for all parts of all pairs at once."""
    taken = [(i[:0], j[:0], size[:0])]
    # Where all blocks before and all behind lie on their sides of a place in a and in b, they don't meet.
    apart = (np.maximum.accumulate(i + size)[:-1] <= i[1:]) & (np.maximum.accumulate(j + size)[:-1] <= np.minimum.accumulate(j[::-1])[::-1][1:])
    part = np.cumsum(np.concatenate(([0], apart)))[: len(i)]
    while len(i):
        first = np.diff(part, prepend=-1) != 0
        part = np.cumsum(first) - 1
        most = np.maximum.reduceat(size, np.flatnonzero(first))
        best = np.flatnonzero(size == most[part])
        place = np.minimum.reduceat(i[best] << 32 | j[best], np.flatnonzero(np.diff(part[best], prepend=-1)))
        x, y = place >> 32, place & 0xFFFFFFFF
        taken.append((x, y, most))
        x, y = x[part], y[part]
        before = np.minimum(size, np.minimum(x - i, y - j))
        skip = np.maximum(0, np.maximum(x - i, y - j) + most[part])
        behind = size - skip
        a, b = np.flatnonzero(before >= SEED), np.flatnonzero(behind >= SEED)
        part = np.concatenate((2 * part[a], 2 * part[b] + 1))
        order = np.argsort(part, kind="stable")
        part, i, j, size = part[order], *(np.concatenate(v)[order] for v in ((i[a], (i + skip)[b]), (j[a], (j + skip)[b]), (before[a], behind[b])))
    i, j, size = (np.concatenate(v) for v in zip(*taken, strict=True))
    order = np.argsort(i)
    return i[order], j[order], size[order]


def _without_seeds(a: str, b: str) -> int:
    """Characters in the matching blocks of two texts that have none of SEED characters in common."""
    if len(a) * len(b) > 2500:
        return _long_without_seeds(a, b)
    total, todo = 0, [(a, b, SEED - 1)]
    while todo:
        a, b, most = todo.pop()
        for n in range(min(len(a), len(b), most), 0, -1):
            for i in range(len(a) - n + 1):
                if (j := b.find(a[i : i + n])) >= 0:
                    total += n
                    if i and j:
                        todo.append((a[:i], b[:j], n))
                    if i + n < len(a) and j + n < len(b):
                        todo.append((a[i + n :], b[j + n :], n))
                    break
            else:
                continue
            break
    return total


def _long_without_seeds(a: str, b: str) -> int:
    """_without_seeds by the places of all short blocks: within a part whose blocks have at most n
    characters those of n follow each other from left to right, so that one pass finds them all;
    shorter ones lie between them."""
    total, parts = 0, [(0, len(a), 0, len(b))]
    for n in range(SEED - 1, 0, -1):
        later = []
        for a0, a1, b0, b1 in parts:
            if a1 - a0 >= n and b1 - b0 >= n:
                last = {b[j : j + n]: j for j in range(b0, b1 - n + 1)}
                i = a0
                while i <= a1 - n:
                    if last.get(a[i : i + n], -1) < b0:
                        i += 1
                        continue
                    j = b.find(a[i : i + n], b0, b1)
                    total += n
                    if i > a0 and j > b0:
                        later.append((a0, i, b0, j))
                    a0 = i = i + n
                    b0 = j + n
            if a0 < a1 and b0 < b1:
                later.append((a0, a1, b0, b1))
        parts = later
    return total


def _matching(pairs: list[tuple[str, str]]) -> tuple[list[int], list[bool]]:
    """Characters in the matching blocks of pairs that are looked at together, and which pairs
    repeat themselves too much for that; no text is empty."""
    a, b = "".join(x for x, _ in pairs), "".join(y for _, y in pairs)
    text = a + b
    la, lb = np.array([len(x) for x, _ in pairs]), np.array([len(y) for _, y in pairs])
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    i, j, size, heavy = _seed_runs(codes, la, lb)
    at_a, owner = _numbered(la)
    at_b = len(a) + _numbered(lb)[0]
    i, j, size = _taken(i, j, size)
    total = np.bincount(owner[i], size, len(pairs))
    # The parts between the blocks of a pair, and before the first and after the last one.
    light = np.flatnonzero(~heavy)
    of = np.concatenate((owner[i], light))
    begins = np.concatenate((i, at_a[light + 1])), np.concatenate((j, at_b[light + 1]))
    order = np.argsort(begins[0] * 2 + (np.arange(len(of)) < len(i)), kind="stable")
    of, a1, b1 = of[order], begins[0][order], begins[1][order]
    new = np.diff(of, prepend=-1) != 0
    a0, b0 = (np.where(new, at[of], np.roll(e[order], 1)) for at, e in ((at_a, np.concatenate((i + size, at_a[light + 1]))), (at_b, np.concatenate((j + size, at_b[light + 1])))))
    open_ = (a0 < a1) & (b0 < b1)
    single = open_ & (a1 - a0 == 1) & (b1 - b0 == 1)
    np.add.at(total, of[single], codes[a0[single]] == codes[b0[single]])
    open_ &= ~single
    for k, w, x, y, z in zip(*(v[open_].tolist() for v in (of, a0, a1, b0, b1)), strict=True):
        total[k] += _without_seeds(text[w:x], text[y:z])
    return total.astype(np.int64).tolist(), heavy.tolist()


def _by_longest(a: str, b: str) -> tuple[int, list[tuple[str, str]]]:
    """Characters in the longest matching blocks of two texts, and the parts between those blocks.

    Those of the same size follow each other from left to right, so that one pass takes them all.
    """
    na, nb, n = len(a), len(b), len(a) + len(b)
    rank = np.unique(np.frombuffer((a + b).encode("utf-32-le", "surrogatepass"), np.uint32), return_inverse=True)[1].astype(np.int64)
    # rank tells the parts of wide characters apart; two of them, which may overlap, any longer part up to twice as long.
    wide = 1

    def keys(size: int) -> tuple[np.ndarray, np.ndarray]:
        key = rank[: n - size + 1] * n + rank[size - wide : n - wide + 1]
        return key[: na - size + 1], key[na:]

    def met(size: int) -> bool:
        return size <= min(na, nb) and bool(np.isin(*keys(size)).any())

    if not met(1):
        return 0, []
    while met(2 * wide):
        rank = np.unique(rank[:-wide] * n + rank[wide:], return_inverse=True)[1]
        wide *= 2
    low, high = wide, 2 * wide
    while high - low > 1:
        low, high = (middle, high) if met(middle := (low + high) // 2) else (low, middle)
    in_a, in_b = keys(low)
    begins = np.flatnonzero(np.isin(in_a, in_b))
    order = np.argsort(in_b, kind="stable")
    last = order[np.searchsorted(in_b[order], in_a[begins], side="right") - 1]
    total = a0 = b0 = 0
    parts = []
    for i, most in zip(begins.tolist(), last.tolist(), strict=True):
        if i >= a0 and most >= b0:
            j = b.find(a[i : i + low], b0)
            total += low
            parts.append((a[a0:i], b[b0:j]))
            a0, b0 = i + low, j + low
    parts.append((a[a0:], b[b0:]))
    return total, [(x, y) for x, y in parts if x and y]


def _groups(pairs: Iterable[tuple[int, str, str]]) -> Iterator[list[tuple[int, str, str]]]:
    """Numbered pairs by as many as are looked at together."""
    some: list[tuple[int, str, str]] = []
    letters = 0
    for pair in pairs:
        size = max(len(pair[1]), len(pair[2]))
        if some and letters + size > TOGETHER:
            yield some
            some, letters = [], 0
        some.append(pair)
        letters += size
    if some:
        yield some


def matching_ratios(pairs: Iterable[tuple[str, str]]) -> list[float]:
    """What difflib.SequenceMatcher(None, a, b, autojunk=False).ratio() gives for each pair, in far
    less time for texts that are much alike.

    The longest common block is taken, the earliest in a and then in b, and the same is done on
    both sides of it. Blocks of SEED characters or more are found for many pairs at once; pairs
    that repeat themselves too much are first cut at their longest blocks.
    """
    out: list[float] = []

    def differing() -> Iterator[tuple[int, str, str]]:
        for a, b in pairs:
            out.append(1.0 if a == b else 0.0)
            if a and b and a != b:
                yield len(out) - 1, a, b

    for asked in _groups(differing()):
        total, todo = dict.fromkeys((k for k, *_ in asked), 0), asked
        while todo:
            later = []
            for some in _groups(todo):
                for (k, a, b), found, heavy in zip(some, *_matching([(a, b) for _, a, b in some]), strict=True):
                    if heavy:
                        found, parts = _by_longest(a, b)
                        later += [(k, *part) for part in parts]
                    total[k] += found
            todo = later
        for k, a, b in asked:
            out[k] = 2.0 * total[k] / (len(a) + len(b))
    return out


def matching_ratio(a: str, b: str) -> float:
    """matching_ratios of a single pair."""
    return matching_ratios([(a, b)])[0]


def char_accuracy(truth: Column | str, text: Column | str) -> Column:
    """Matching-block similarity of two whole texts, white space left out."""

    @F.pandas_udf("double")
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        known = [x is not None and y is not None for x, y in zip(a, b, strict=True)]
        found = iter(matching_ratios((python_squeeze(x), python_squeeze(y)) for x, y in zip(a[known], b[known], strict=True)))
        return pd.Series([next(found) if k else None for k in known], dtype="float64")

    return ratio(_c(truth), _c(text))
