"""Problem 5: sentence boundaries across languages and scripts.

Method: marks that do not end a sentence (in decimals, URLs, initials, abbreviations, list
numbers, quotations, brackets and ellipses) are masked with private-use placeholders of equal
length, each line is split at the terminators that remain, and the units are read from the
original text by position. Everything is a SQL expression; no row leaves the JVM and only
positions are shuffled.

A heading line is one unit, as is the rest of any line without an end mark. White space and
invisible characters around a unit do not belong to it. A null or blank text has no unit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Placeholders, one code point each, so that positions stay true: a masked full stop, another
# masked mark, an invisible character, the bracket of a list number, a closing mark that ends
# a sentence.
#: ... and an emoji, as look-behind can't see characters beyond the basic plane.
DOT, MARK, GONE, ITEM, FACE = (chr(0xE000 + k) for k in range(5))
#: ... of each kind of quotation mark and bracket, so that one kind doesn't close another.
CUT_OF = {b: chr(0xE010 + k) for k, b in enumerate("”」』)\"")}
CUT = "".join(CUT_OF.values())

SPACES = "".join(map(chr, [9, 11, 12, 13, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
# Marks and letters that are read as another one, mapped one to one.
LIKE_FROM = "．！？｡（）｢｣＂АВЕЅІЈКМНОРСТХаеѕіјорсухΑΒΕΖΗΙΚΜΝΟΡΤΥΧοѵν"
LIKE_TO = ".!?。()「」\"ABESIJKMHOPCTXaesijopcyxABEZHIKMNOPTYXovv"
#: ... and full-width digits and letters.
WIDE_FROM = "".join(chr(c + 0xFEE0) for c in range(0x30, 0x7B) if chr(c).isalnum())
WIDE_TO = "".join(chr(c) for c in range(0x30, 0x7B) if chr(c).isalnum())
INVISIBLE = r"[\x{00AD}\x{034F}\x{061C}\x{180B}-\x{180F}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{206F}\x{FE00}-\x{FE0F}\x{FEFF}\x{E0100}-\x{E01EF}]"

# Abbreviations whose full stop does not end a sentence.
ANY_NEXT = (
    "Mr Mrs Ms Dr Prof Rev Hon St Mt Capt Col Gen Lt Gov Fig Figs Sect Sec Chap Vol Vols Eq Eqs Ref Refs approx cf vs viz eds esp resp incl excl ca est "
    "ssp subsp var sp spp syn cv bzw vgl Vgl Abb Nr Tel Str Hr Fr evtl ggf inkl Kap Bd Aufl Hrsg Anm Mme Mlle env chap av apr boul janv févr avr juil sept oct nov déc ex "
    "TS ThS GS PGS BS डॉ प्रो श्री"
)
NUMBER_NEXT = "No Nos no nos p pp Ch ch Art art Bl Nr S"
MONTHS = "Januar|Februar|März|April|Mai|Juni|Juli|August|September|Oktober|November|Dezember|Jan|Feb|Jun|Jul|Aug|Sep|Okt|Nov|Dez"

HAN = r"\x{2E80}-\x{2FDF}\x{3400}-\x{9FFF}\x{F900}-\x{FAFF}"
KANA = r"\x{3040}-\x{30FF}"
THAI = r"\x{0E00}-\x{0E7F}"
EMOJI = r"\x{1F000}-\x{1FAFF}\x{2600}-\x{27BF}"
ENDS = "。！？!?।॥؟۔～~" + FACE
INNER = f"[.…{ENDS}]"
CLOSERS = "”’」』)»】〗"
LETTER = r"\p{L}\p{M}"


def _to(t: Column, pattern: str, by: str) -> Column:
    return F.regexp_replace(t, F.lit(pattern), F.lit(by))


def _if(t: Column, has: str, made: Column) -> Column:
    """made, where the text has a character at all; spares the regular expression elsewhere."""
    return F.when(F.contains(t, F.lit(has)), made).otherwise(t)


def _numbers_and_words(t: Column) -> Column:
    """Masks full stops in list numbers, decimals, dates, initials and abbreviations."""
    t = _to(t, rf"^([\s{GONE}]*[(]?\d{{1,3}})[.](?=[^\d])", "$1" + DOT)
    t = _to(t, rf"(?<=\d)[.](?=\d)|(?<=\b\d{{1,2}})[.](?= (?:{MONTHS})\b)", DOT)
    # Single letters in a chain, then the end of the chain, then a lone initial.
    t = _to(t, rf"(?<![{LETTER}\d])(\p{{L}}\p{{M}}{{0,2}})[.](?= ?\p{{L}}\p{{M}}{{0,2}}[.])", "$1" + DOT)
    t = _to(t, rf"(?<={DOT} ?\p{{L}})[.](?= ?[\p{{Ll}}\p{{N}},;)(])", DOT)
    t = _to(t, rf"(?<![{LETTER}\d])(\p{{Lu}})[.](?=\s*\S)", "$1" + DOT)
    t = _to(t, r"(?<![\p{L}\p{M}\d])([\x{0600}-\x{06FF}])[.](?= \p{L})", "$1" + DOT)
    t = _to(t, rf"(?<![{LETTER}])({ANY_NEXT.replace(' ', '|')})[.](?=\s*\S)", "$1" + DOT)
    t = _to(t, rf"(?<![{LETTER}])({NUMBER_NEXT.replace(' ', '|')})[.](?= ?\d)", "$1" + DOT)
    t = _to(t, r"(?<=\bet al)[.](?=\s*\S)|(?<=\bp)[.](?= ex)|(?<=[\p{L}\p{N}])[.](?=[a-z\d])|(?<=[\p{Lu}\p{N}])[.](?=[A-Z])", DOT)
    # An ellipsis with more of the line behind it ends nothing.
    t = _to(t, r"[.](?=[.])", MARK)
    return _to(t, rf"(?<={MARK})[.](?= *\S)", MARK)


def _before(t: Column, signs: str, closing: str, opening: str | None = None) -> Column:
    """Masks marks in the parts of a line that a closing sign ends, however long they are.

    The line is parted behind each of the signs, so every character is looked at once. With an
    opening sign, only parts that this sign brings in count.
    """
    parts = F.split(t, f"(?<=[{signs}])")
    ends = lambda x, cls: x.rlike(f"[{cls}]$")

    def masked(x: Column, i: Column) -> Column:
        inside = ends(x, closing)
        if opening is not None:
            inside = inside & (i > 0) & ends(F.get(parts, i - 1), opening)
        return F.when(inside, _to(x, INNER, MARK)).otherwise(x)

    return F.array_join(F.transform(parts, masked), "")


def _pair(a: str, b: str):
    """Masks marks within a pair of quotation marks; one brought in by a colon may end its sentence."""

    def step(t: Column) -> Column:
        own = CUT_OF[b]
        cut = _to(t, f"([：:]{GONE}*{a}[^{a}{b}]*{INNER}){b}(?!{GONE}*[，,、；;：。！？!?)」』”])", "$1" + own)
        return _if(t, a, _before(cut, a + b + own, b + own))

    return step


def _bracket(a: str, b: str):
    """Masks marks within brackets; a bracket that stands alone is a sentence."""

    def step(t: Column) -> Column:
        inside = _before(t, a + b, b, a)
        if b == r"\)":
            inside = _to(inside, rf"(?<=(?:^|[.{ENDS}{CUT}])[ {GONE}]{{0,3}})({a}[^{a}{b}]*{MARK}){b}(?![，,、；;：:])", "$1" + CUT_OF[")"])
        return _if(t, b[-1], _if(t, a[-1], inside))

    return step


def _plain_quotes(t: Column) -> Column:
    parts = F.split(t, '"')

    def joined(x: Column, i: Column) -> Column:
        # After a quotation in plain marks a new sentence may start with a capital.
        new = (i % 2 == 0) & x.rlike(r"^ +\p{Lu}") & F.get(parts, i - 1).rlike(f"{INNER}$")
        sign = F.when(i == 0, F.lit("")).when(new, F.lit(CUT_OF['"'])).otherwise(F.lit('"'))
        return F.concat(sign, F.when(i % 2 == 1, _to(x, INNER, MARK)).otherwise(x))

    return F.when(F.contains(t, F.lit('"')) & (F.size(parts) % 2 == 1), F.array_join(F.transform(parts, joined), "")).otherwise(t)


def _spaces(t: Column) -> Column:
    """A line break in place of a space that parts two clauses, in Thai and in Chinese chat."""
    left = f"[{HAN}{ENDS}.…{MARK}{CUT}”」)]"
    parted = _to(t, f"(?<={left}) (?= *[{HAN}“「(])", "\n")
    thai = _to(t, f"(?<=[{THAI}{ENDS}]) (?= *[{THAI}])", "\n")
    return F.when(F.contains(t, F.lit(" ")) & t.rlike(f"[{THAI}]"), thai).when(F.col("_chat") & F.contains(t, F.lit(" ")) & ~t.rlike(f"[{KANA}]"), parted).otherwise(t)


#: The masks in their order; each is a projection of its own, so none is computed twice.
STEPS = [
    lambda t: F.translate(t, SPACES + LIKE_FROM + WIDE_FROM, " " * len(SPACES) + LIKE_TO + WIDE_TO),
    # An emoji ends what stands before it; at the start of a line there is nothing yet.
    lambda t: _to(_to(_to(t, INVISIBLE, GONE), f"[{EMOJI}]", FACE), rf"^(\s*){FACE}", "$1" + MARK),
    lambda t: _to(_to(t, r"^(\s*\d{1,3})[)]", "$1" + ITEM), r"(?<=[。！？；;:：])( *\d{1,3})[)]", "$1" + ITEM),
    lambda t: _to(t, r"(?<=\d)[～~](?=\d)", MARK),
    lambda t: F.when(t.rlike(r"://|www\."), _to(t, r"((?:://|www\.)|\G(?!^))([^\s。！？，；”」).!?~]*)[.!?~](?=[^\s。！？，；”」)])", "$1$2" + MARK)).otherwise(t),
    lambda t: _if(t, ".", _numbers_and_words(t)),
    _pair("“", "”"), _pair("「", "」"), _pair("『", "』"),
    lambda t: _if(t, "«", _before(t, "«»", "»")),
    lambda t: _if(t, "„", _before(t, "„“”", "“”")),
    _bracket("【", "】"), _bracket("《", "》"), _bracket(r"\(", r"\)"),
    _plain_quotes,
    _spaces,
]

#: Where a masked line is split.
SPLIT = (
    f"(?<=[{ENDS}{CUT}])(?!{GONE}*[.…{ENDS}{CUT}{CLOSERS}])"
    rf"|(?<=[.])(?!{GONE}*[.…{ENDS}{CUT}{CLOSERS}\p{{Ll}}\p{{Lo}}\p{{N}}，,;:：；、])"
    rf"|(?<=[.])(?=[{HAN}{KANA}])"
    f"|(?<=[.{ENDS}][{CLOSERS}])(?![.…{ENDS}{CUT}{CLOSERS}，,、；;：:])"
    r"|(?<=\n)"
)


def _with_ends(lines: DataFrame) -> DataFrame:
    """Adds _ends: where the units of each line end in its text."""
    masked = lines.withColumn("_t", F.col("_line"))
    for step in STEPS:
        masked = masked.withColumn("_t", step(F.col("_t")))
    heading = F.col("_line").rlike(rf"^\s*{INVISIBLE}*\s*[#＃]")
    pieces = F.when(heading, F.array("_t")).otherwise(F.split("_t", SPLIT))
    # Projections of their own: within the functions below a split would be made again for each run.
    made = masked.withColumn("_pieces", pieces).withColumn("_runs", _runs(F.col("_pieces")))
    # Each run of pieces starts where those before it end.
    made = made.withColumn("_from", _sums(F.transform("_runs", lambda run: F.aggregate(run, F.lit(0), lambda n, x: (n + F.length(x)).cast("int")))))
    ends = F.zip_with(
        "_runs",
        "_from",
        lambda run, begin: F.aggregate(
            run,
            F.struct((F.col("_start") + begin).cast("int").alias("at"), F.array().cast("array<int>").alias("ends")),
            lambda acc, x: F.struct(
                (acc["at"] + F.length(x)).cast("int").alias("at"),
                F.when(
                    x.rlike(rf"[^\s{GONE}]"),
                    F.concat(acc["ends"], F.array((acc["at"] + F.length(F.regexp_replace(x, F.lit(rf"[\s{GONE}]+$"), F.lit("")))).cast("int"))),
                ).otherwise(acc["ends"]).alias("ends"),
            ),
            lambda acc: acc["ends"],
        ),
    )
    return made.withColumn("_ends", F.flatten(ends))


def _runs(parts: Column, size: int = 256) -> Column:
    """An array in runs, so that summing up over a very long one copies only a run at each step."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.greatest(F.size(parts), F.lit(1)) - 1) / size).cast("int")), lambda k: F.slice(parts, k * size + 1, F.lit(size)))


def _sums(lengths: Column) -> Column:
    """For each element the sum of those before it."""
    return F.aggregate(
        lengths,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("all")),
        lambda acc, n: F.struct((acc["at"] + n).cast("int").alias("at"), F.concat(acc["all"], F.array(acc["at"])).alias("all")),
        lambda acc: acc["all"],
    )


def _lines(df: DataFrame, keys: list[str], text: str, chat: Column | None) -> DataFrame:
    """keys, chat, start, line: the lines that are not blank, with the position each starts at."""
    given = df.where(F.col(text).isNotNull()).select(*keys, (F.lit(False) if chat is None else chat).alias("_chat"), F.split(text, "\n").alias("_all")).withColumn("_runs", _runs(F.col("_all")))
    lengths = lambda run: F.transform(run, lambda x: F.length(x) + 1)
    begins = _sums(F.transform("_runs", lambda run: F.aggregate(lengths(run), F.lit(0), lambda n, x: (n + x).cast("int"))))
    both = F.zip_with("_runs", begins, lambda run, begin: F.arrays_zip(F.transform(_sums(lengths(run)), lambda at: begin + at).alias("start"), run.alias("line")))
    return given.select(*keys, "_chat", F.explode(F.flatten(both)).alias("_one")).select(*keys, "_chat", F.col("_one")["start"].alias("_start"), F.col("_one")["line"].alias("_line")).where("trim(_line) <> ''")


def sentences(df: DataFrame, keys: list[str], text: str = "text", chat: Column | None = None) -> DataFrame:
    """keys, end_pos: one row for each sentence; rows of the same key and text give them once.

    end_pos counts code points from the start of the text to the end of the sentence. chat
    marks rows in which a space between Chinese clauses parts them. Other columns are ignored.
    """
    # An inner explode would push a filter on the whole masked expression below every projection.
    ends = _with_ends(_lines(df, keys, text, chat)).select(*keys, F.explode_outer("_ends").alias("end_pos"))
    return ends.where("end_pos is not null").distinct()


def sentence_texts(df: DataFrame, keys: list[str], text: str = "text", chat: Column | None = None) -> DataFrame:
    """keys, end_pos, sentence: the sentences with their original characters."""
    lines = _with_ends(_lines(df, keys, text, chat))
    begins = F.concat(F.array(F.col("_start")), F.col("_ends"))
    parts = F.transform(F.col("_ends"), lambda e, i: F.struct(e.alias("end_pos"), F.trim(F.substring(F.col("_line"), begins[i] - F.col("_start") + 1, e - begins[i])).alias("sentence")))
    units = lines.select(*keys, F.explode_outer(parts).alias("_part")).select(*keys, "_part.end_pos", "_part.sentence")
    return units.where("end_pos is not null").distinct()
