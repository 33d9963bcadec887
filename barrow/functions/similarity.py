"""String similarity that Spark lacks, vectorised over Arrow batches: Ratcliff-Obershelp ratio and best partial ratio."""

from __future__ import annotations

from difflib import SequenceMatcher
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


@lru_cache(maxsize=100_000)
def _ratio(a: str, b: str, autojunk: bool) -> float:
    return 1.0 if a == b else SequenceMatcher(None, a, b, autojunk).ratio()


def ratio(left: Column, right: Column, autojunk: bool = True) -> Column:
    """Ratcliff-Obershelp ratio of two texts, trimmed and in lower case (MAT-08); 0 where either is empty, null or 'nan'.

    Not symmetric: the extracted value comes first, the registry's second. autojunk is difflib's own heuristic for texts
    of 200 characters and more.
    """

    @F.pandas_udf("double")
    def compare(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(a.fillna(""), b.fillna(""), strict=True):
            x, y = x.strip().lower(), y.strip().lower()
            out.append(0.0 if x in ("", "nan") or y in ("", "nan") else _ratio(x, y, autojunk))
        return pd.Series(out, dtype="float64")

    return compare(left, right)


def partial(needle: str, text: str) -> int:
    """Best ratio, 0 to 100, of the shorter text with any stretch of its length in the longer."""
    short, long = (needle, text) if len(needle) <= len(text) else (text, needle)
    if not short:
        return 0
    if short in long:
        return 100
    best = 0.0
    for block in SequenceMatcher(None, short, long, autojunk=False).get_matching_blocks():
        start = max(0, block.b - block.a)
        best = max(best, SequenceMatcher(None, short, long[start : start + len(short)], autojunk=False).ratio())
    return round(100 * best)


def best_keyword(text: Column, keywords: dict[str, list[str]], thresholds: tuple[int, ...] = (95, 90, 80)) -> Column:
    """The section whose keyword is found in the text at the highest threshold reached (MAT-17, MAT-18); null for none.

    Each text is judged by itself; among sections that reach the same threshold the best ratio wins, ties to the first.
    """

    @F.pandas_udf("string")
    def pick(texts: pd.Series) -> pd.Series:
        def one(t: str | None) -> str | None:
            if not t:
                return None
            scores = [(max(partial(k.lower(), t.lower()) for k in ks), s) for s, ks in keywords.items()]
            top = max(x for x, _ in scores)
            return next(s for x, s in scores if x == top) if any(top >= limit for limit in thresholds) else None

        return texts.map(one)

    return pick(text)


#: Kinds of work on a permit, and words a good reading of one has.
WORK_KINDS = ("раскопки", "разведки", "наблюдения")
PERMIT_WORDS = ("участке", "территории", "объект", "Красноярского", "края", "археологического", "строительство")


def work_kind(text: Column, kinds: tuple[str, ...] = WORK_KINDS) -> Column:
    """MAT-18: the kind whose name is nearest to any stretch of the text, the first of equals; null for null and empty texts."""

    @F.pandas_udf("string")
    def pick(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: max(kinds, key=lambda k: partial(k, t)) if t else None)

    return pick(text)


def better_reading(a: Column, b: Column, words: tuple[str, ...] = PERMIT_WORDS, long_enough: int = 45) -> Column:
    """MAT-20: of two readings the one that alone is long enough, else the one in which the words are found better, the second
    if equal; null counts as empty."""

    @F.pandas_udf("string")
    def pick(x: pd.Series, y: pd.Series) -> pd.Series:
        out = []
        for s, t in zip(x.fillna(""), y.fillna(""), strict=True):
            if (len(s) >= long_enough) != (len(t) >= long_enough):
                out.append(s if len(s) >= long_enough else t)
            else:
                out.append(s if sum(partial(w, s) for w in words) > sum(partial(w, t) for w in words) else t)
        return pd.Series(out, dtype=object)

    return pick(a, b)
