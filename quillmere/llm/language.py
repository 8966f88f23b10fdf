"""Which language a text is written in, from its scripts and, for Latin script, its function words."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np

# Code points of scripts that name a language by themselves, and of Latin letters, as ranges.
SCRIPTS = {
    "ja": "぀-ヿㇰ-ㇿｦ-ﾝ", "ko": "가-힯ᄀ-ᇿ㄰-㆏", "zh": "\u3400-\u9fff\uf900-\ufaff\u2e80-\u2fdf\U00020000-\U0003ffff", "th": "฀-๿", "hi": "ऀ-ॿ", "ar": "؀-ۿݐ-ݿ", "ru": "Ѐ-ӿ", "el": "Ͱ-Ͽ", "he": "֐-׿", "latin": "A-Za-zÀ-ɏḀ-ỿ",
}
_NAMES = list(SCRIPTS)
#: The script of each code point, by its place in the list; one more than all for any other.
_SCRIPT_OF = np.full(0x110000, len(_NAMES), np.uint8)
for _k, _ranges in enumerate(SCRIPTS.values()):
    for _a, _b in zip(_ranges[::3], _ranges[2::3], strict=True):
        _SCRIPT_OF[ord(_a) : ord(_b) + 1] = _k
WORD = re.compile("[a-zà-ɏḁ-ỿ]+(?:['’][a-zà-ɏ]+)?")

# The commonest function words of languages in Latin script.
FUNCTION_WORDS = {
    "en": "the of and to in is it that for on with as was at by this be are from or an not have which you if when may your should about does how what why can will been than its who after before do i my we they he she but so no has had would could must there their these those",
    "de": "der die das und ist in den von zu mit nicht ein eine einen einem einer dem des auf für im sich wird werden bei man wer was wie warum wann gegen am an aus auch als wenn oder aber nach vor über unter nur noch sehr soll sollte kann er sie es ich wir ihr hat haben war sind zum zur durch bis ohne dass",
    "fr": "le la les de des du et est en un une que qui dans pour pas sur au aux ne se ce il elle on nous vous je plus par avec sans ou où mais si quand comment pourquoi dès vers sous entre cette ces son sa ses leur être sont a été faut peut très après avant d'où",
    "es": "el la los las de del y es en un una que se por con para no su al lo como más pero sus este esta cuando por qué hay muy sin sobre entre también hasta desde si ya o ser son fue",
    "it": "il lo la i gli le di del della dei e è in un una che si per con non da al alla come più ma sono questo questa perché quando anche o se nel nella ha",
    "pt": "o a os as de do da e é em um uma que se por com para não no na ao à como mais mas dos das quando também ou muito sem sobre entre até são foi",
    "nl": "de het een en van in is dat op te zijn voor met niet die aan er om ook als bij naar door maar over wordt kan dan nog wel geen uit",
    "id": "yang dan di dari untuk dengan ini itu pada tidak adalah atau dalam akan oleh ke juga karena bisa dapat saat lebih sudah",
    "vi": "và của là có cho không này khi một những người được các để với vì sao lại bị nên mỗi lần từ bao giờ thì mà ở ra vào trong ngoài trên dưới sau trước cũng đã đang sẽ rồi nếu nhưng hay hoặc rất",
}
_LANGUAGES_OF: dict[str, list[str]] = defaultdict(list)
for _lang, _words in FUNCTION_WORDS.items():
    for _word in dict.fromkeys(_words.split()):
        _LANGUAGES_OF[_word].append(_lang)
_MARKS = [("vi", re.compile("[ăđơưĂĐƠƯẠ-ỹ]")), ("de", re.compile("[äöüßÄÖÜ„]")), ("fr", re.compile("[èêçàùœîôûÀÈÊÇ]")), ("es", re.compile("[ñ¿¡]"))]


def language(text: str | None, least: int = 4) -> str | None:
    """A language code, or None for texts with too few letters to tell."""
    if not text:
        return None
    n = np.bincount(_SCRIPT_OF[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)], minlength=len(_NAMES))
    latin = int(n[len(_NAMES) - 1])
    counts = Counter({lang: int(k) for lang, k in zip(_NAMES[:-1], n, strict=False) if k})
    if counts.get("ja", 0) * 8 >= counts.get("zh", 0) and counts.get("ja", 0) > 1:
        counts["ja"] += counts.pop("zh", 0)
    # A Latin word has about five letters where Chinese or Japanese has one or two characters.
    best, n = counts.most_common(1)[0] if counts else (None, 0)
    weight = n * (3 if best in ("zh", "ja", "ko") else 1)
    if best and weight >= latin and n >= min(least, 2):
        return best
    if latin < least:
        return best if n else None
    words = Counter(WORD.findall(text.lower().replace("’", "'")))
    scores = Counter(dict.fromkeys(FUNCTION_WORDS, 0))
    for word, times in words.items():
        for lang in _LANGUAGES_OF.get(word, ()):
            scores[lang] += times
    # Names in Latin letters within a text of another script: no language of theirs shows.
    if best and n >= min(least, 2) and max(scores.values()) < max(2, sum(words.values()) * 0.15):
        return best
    for lang, marks in _MARKS:
        scores[lang] += 2 * len(marks.findall(text))
    top = scores.most_common(1)[0]
    return top[0] if top[1] else "latin"
