"""What is noise in a turn's text, and what may stand at its head."""

from __future__ import annotations

import regex

#: Hesitation sounds by language; `*` for every language.
HESITATIONS = {
    "*": r"h+m+|m{2,}|uh+m+",
    "en": r"u+h+|u+m+|er+|erm+|ah+",
    "de": r"ä+h+m*|ö+h+m*|e+h+m*",
    "fr": r"e+u+h+|he+u+|hu+m+",
    "es": r"e+h+m*|e{2,}h*",
    "ja": r"え+[ーっ]と|え[えー]+|あの[ーう]",
    "zh": r"嗯+|呃+",
    "hi": r"उम+|अम+",
    "th": r"เอ่อ+|อืม+",
    "ar": r"اممم*|آه+",
}
#: Words of sound notes that stand in round brackets.
SOUNDS = (
    "applause laugh phone ring cough sigh sniff noise music door slam crosstalk inaudible unclear silence laughter clap cheer pause knock beep overlap indistinct "
    "aplauso risa tose música ruido inaudible suspir silencio applaus lach hust musik tür knallt geräusch unverständlich seufz räusper applaudissement rire tousse musique bruit soupir "
    "拍手 笑 音楽 咳 笑声 掌声 音乐 ضحك تصفيق हंसी तालियां ताली เสียง หัวเราะ"
).split()
#: Frequent words by language, to tell the language of a recording that names none.
STOPWORDS = {
    "en": "the and is to we that of it was for you i this have said".split(),
    "de": "der die das und ist wir nicht ich mit zu haben ein es auf sind".split(),
    "fr": "le la les et est nous je ce une pour pas dans il qui des".split(),
    "es": "el la los las y es que en un por no nos de lo este".split(),
}
#: Patterns in the syntax that Java and Python's `regex` share: a clock time; one at the head of a text; a label before the words.
TIME = r"\d{1,3}:\d{2}(?::\d{2})?(?:[.,]\d{1,3})?"
HEAD = rf"^\s*(?:\[\s*{TIME}\s*\]|\(\s*{TIME}\s*\)|<\s*{TIME}\s*>|{TIME}(?=\s))[:,]?\s*(?:[-–—]\s+)?"
LABEL = r"^\s*((?:>+\s*)?[^:\n!?]{1,60}?)\s*:{1,2}\s+(?=\S)"
#: Marked noise (case doesn't matter), and the marks of which it has one unless it is a clock time.
NOTES = (
    r"\[[^\[\]\n]{0,80}\]|\{[^{}\n]{0,80}\}|<[^<>\n]{0,80}>|♪[^♪\n]{0,80}♪|[♪♫]+|#\p{L}[\p{L} ]{0,30}#|\*\p{L}[\p{L} ]{0,40}\*|【[^【】\n]{0,80}】|［[^［］\n]{0,80}］"
    rf"|\(+(?:[^()\n]{{0,40}}?(?:{'|'.join(SOUNDS)})[^()\n]{{0,40}})\)+|（(?:[^（）\n]{{0,20}}?(?:{'|'.join(SOUNDS)})[^（）\n]{{0,20}})）|(?<![\d.,:])\d{{1,3}}:\d{{2}}:\d{{2}}(?:[.,]\d{{1,3}})?(?![\d:])"
)
MARKS = "[{<♪♫#*(（【［"
_HESITATION = {k: regex.compile(rf"(?:{HESITATIONS['*']}" + (f"|{v})" if k != "*" else ")"), regex.I) for k, v in HESITATIONS.items()}
_KNOWN: dict[tuple[str, str], bool] = {}


def is_sound(word: str, lang: str) -> bool:
    """Whether a word is a hesitation sound of the language; what was asked is remembered."""
    hit = _KNOWN.get((lang, word))
    if hit is None:
        if len(_KNOWN) > 500_000:
            _KNOWN.clear()
        hit = _KNOWN[lang, word] = bool(_HESITATION.get(lang, _HESITATION["*"]).fullmatch(word))
    return hit


def base_language(lang: str | None) -> str:
    return (lang or "*").lower().partition("-")[0]
