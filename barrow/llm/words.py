"""Words of a page as a reader takes them, whatever the typing, layout or mark-up."""

from __future__ import annotations

import html
import re
import unicodedata

#: Latin letters that print like Cyrillic ones, capital and small.
LATIN = "ABCEHKMOPTXYaceopxy"
CYRILLIC = "АВСЕНКМОРТХУасеорху"
TO_CYRILLIC = str.maketrans(LATIN, CYRILLIC)
TO_LATIN = str.maketrans(CYRILLIC, LATIN)
#: Small Latin letters that, alone or only among themselves, may as well be Cyrillic; single letters as initials too.
_EITHER = frozenset("aceopxy")
_SINGLE = str.maketrans("kmthb", "кмтнв")

_INLINE = re.compile(r"</?(?:a|b|i|u|s|em|strong|span|font|sub|sup|mark|small|big|tt|code|wbr)\b[^<>]*>", re.I)
_TAG = re.compile(r"<[A-Za-z/!][^<>]*>")
_ODD = re.compile("[\u00ac\u00ad\u200b-\u200f\u2060\ufeff\u0300-\u036f]")
_UNSEEN = re.compile("[\u200b-\u200f\u2060\ufeff]")
_SOFT = re.compile("(?<=\\w)[\u00ad\u00ac][ \t]*(?:\r?\n)?[ \t]*(?=\\w)|\u00ad")
_BROKEN = re.compile("(?<=\\w)[-\u2010\u2011\u2012]\\s+(?=\\w)")
_MARKS = re.compile("[\u0300-\u036f]")
JOINT = "\x1f"
WORDS = re.compile(rf"[^\W_]+(?:{JOINT}[^\W_]+)*")
_LATIN_LETTER = re.compile("[A-Za-z]")
_CYRILLIC_LETTER = re.compile("[\u0400-\u04ff]")


def plain(text: str) -> str:
    """Text without mark-up, invisible characters and soft hyphens; a hyphen before white space is JOINT."""
    if "<" in text:
        text = _TAG.sub(" ", _INLINE.sub("", text))
    if "&" in text:
        text = html.unescape(text)
    if not text.isascii():
        # Signs that a compatibility form would turn into letters or that are merely common.
        text = text.replace("\u2116", " ").replace("\u00a0", " ").replace("\u2026", " ")
        if not unicodedata.is_normalized("NFKC", text):
            text = unicodedata.normalize("NFKC", text)
        if _ODD.search(text):
            text = _MARKS.sub("", _SOFT.sub("", _UNSEEN.sub("", text)))
    return _BROKEN.sub(JOINT, text)


def fold(word: str) -> str:
    """One form for all typings of a word: lower case, ё as е, look-alike letters in the script of the word."""
    if word.isascii():
        if word.isdigit():
            return word
        low = word.lower()
        if len(low) == 1:
            low = low.translate(_SINGLE)
        return low.translate(TO_CYRILLIC) if _EITHER.issuperset(low) or len(low) == 1 else low
    if _LATIN_LETTER.search(word):
        word = word.translate(TO_CYRILLIC)
    return word.lower().replace("ё", "е")


def runs(text: str) -> list[str]:
    """Unfolded runs of letters or digits; a word parted at a hyphen is one run with JOINT inside."""
    return WORDS.findall(plain(text))


def whole(run: str, known) -> list[str]:
    """Folded words of a run: one word if it has no joint or `known` has it in one piece, else its parts."""
    if JOINT not in run:
        return [fold(run)]
    parts = run.split(JOINT)
    one = fold("".join(parts))
    return [one] if known is not None and one in known else list(map(fold, parts))


def words(text: str, known: frozenset[str] | None = None) -> list[str]:
    """Folded words of a text."""
    return [w for run in runs(text) for w in whole(run, known)]
