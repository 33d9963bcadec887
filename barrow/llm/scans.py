"""Noise in text from scanned pages (problem 3).

Line classifiers look at a line with its neighbours and tell running heads and page numbers from text; a classifier of line
pairs tells words divided at a line end from compounds parted at their own hyphen. Misread words are found over the whole
vocabulary: every word meets more frequent words through an inverted index of overlapping character q-grams, and
gradient-boosted trees rank the candidates. All models are trained here, on clean texts of the same corpus into which noise
is put on purpose.
"""

from __future__ import annotations

import random
import re
import textwrap
from collections import ChainMap, Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barrow.llm import boosting, spelling
from barrow.llm.words import TO_CYRILLIC
from barrow.session import cut

#: Clean texts from which the classifiers are trained; a bounded sample, whatever the size of the corpus.
TRAINING_TEXTS = 1200
#: Frequent words kept in memory to skip the join for most tokens; the counts of all others come by joins.
COMMON_WORDS = 30_000
#: A word can be a misreading of another only if the other is this many times as frequent.
TIMES = 8.0
#: Least probability at which a line is furniture, and a word a misreading.
FURNITURE, MISREAD, JOINED = 0.5, 0.5, 0.5
#: Length of the q-grams, and the least length of words that may be one letter apart beyond the letters that print alike.
#: One slip takes at most SLIP of a word's grams away, so two such words share one of the SLIP + 1 rarest of each.
Q, LEAST_SLIP = 3, 5
SLIP = Q + 1

#: Hyphens at line ends, the double ones of old print included; the soft ones never belong to a compound.
HYPHENS, SOFT = "-‐‑‒¬­=⸗", "¬­"
#: Signs a scanner leaves inside words.
STRAY = "■□▪●♦¤§^~|*\\{}<>¦•°"
#: Letters that scanners confuse, as pairs of one shape.
SHAPES = ("се", "ин", "тг", "лп", "вз", "шщ", "цщ", "ьы", "бь", "ыб", "эз", "хк", "хж", "ую", "жк")
_CONFUSED = {(a, b) for pair in SHAPES for a, b in (pair, pair[::-1])}
#: The same as classes: letters of one class print alike, and a misreading keeps the class of every letter.
_CLASSES = ("ес", "ин", "тг", "лп", "взэ", "шщц", "ьыб", "хкж", "ую")
CLASS_FROM, CLASS_TO = "".join(c[1:] for c in _CLASSES), "".join(c[0] * (len(c) - 1) for c in _CLASSES)
#: Digits read for letters.
DIGITS = {"0": "о", "3": "з", "6": "б", "4": "ч", "1": "і", "8": "в"}

_PAGE = re.compile(r"^[\W_]*(?:(?:стр|страница|лист|л|с|page|p)\b\.?\s*)?[\W_]*\d{1,4}[\W_]*(?:\s*(?:из|/|of)\s*\d{1,4}[\W_]*)?$", re.I)
_NUMBER = re.compile(r"^\s*\d+(?:[.,]\d+)?\s*$")
_PAGE_WORD = re.compile(r"^[\W_]*(?:стр|страница|лист|page)\b", re.I)
_HEAD = re.compile(r"шифр|инв\.|копия|архив|том\s+\d|раздел\s+\d|(?:акт|заключени|экспертиз)\D*№\s*\d+-\d+[\W_]*$|(?:—|–|-|,)\s*(?:1[89]|20)\d\d[\W_]*$|отч[её]т\s+об?\s|:\s+итоги")
_SENTENCE_END = re.compile(r"[.!?…;:][»\")\]]*\s*$")
_TOKEN = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)*")
_INLINE = re.compile(rf"([а-яёa-z]{{2,}})[{HYPHENS}][ \t]+(?=[а-яё])", re.I)
_BREAK = re.compile(rf"([^\W\d_]+)[{HYPHENS}][ \t]*$")
_DIVIDED = re.compile(rf"[^\W\d_]+[{HYPHENS}]\s+(?:[^\w\s]*\d+[^\w\s]*\s+)?[^\W\d_]*")
_MIXED = re.compile(r"[а-яё][a-z]|[a-z][а-яё]", re.I)
_STRAY = re.compile(rf"(?<=[^\W\d_])[{re.escape(STRAY)}]+(?=[^\W_])|(?<=\d)[{re.escape(STRAY)}]+(?=\d)|(?<=[^\W\d_])[■□▪♦¤^~|*\\]|[■□▪♦¤^~|*\\](?=[^\W_])")
_IN_WORD = re.compile(r"[а-яё]{2,}[0-9]|[0-9][а-яё]{2,}|[а-яё][0-9][а-яё]")
#: A number with its ending, as 5-й without the hyphen.
_LETTERED = re.compile(r"\d+[а-я]{1,2}")
_IN_NUMBER = re.compile(r"(?<![^\W_])\d+[OОоoЗзlIб]\d*(?![^\W_])|(?<![^\W_])[OОоoЗlI]\d+(?![^\W_])")
#: A digit that the scanner gave up, and an apostrophe inside a Russian word.
_LOST = re.compile(r"\?\d|\d\?+(?=[\d.,;:)]|\s+[а-яa-z])|(?<=[а-яё])['’](?=[а-яё])")


_HYPHENS = frozenset(HYPHENS)
_RIGHT = re.compile(r"\s*([а-яёa-z]+(?:-[а-яёa-z]+)*)")
_RIGHT_CAPITALS = re.compile(r"\s*([А-ЯЁA-Z]+(?:-[А-ЯЁA-Z]+)*)(?![а-яёa-z])")
#: The left part of a word parted by a hyphen, its right part ahead; SEAM stands where it is open what they make.
_JOINT = re.compile(rf"([^\W\d_]+)[{HYPHENS}]\s+(?=([^\W\d_]+(?:-[^\W\d_]+)*))")
SEAM = "\ue000"
_SEAMED = re.compile(rf"[^\W\d_]+(?:[-{SEAM}][^\W\d_]+)*")
_PARTED_ANYHOW = re.compile(rf"[{HYPHENS}]\s")
_PARTED = re.compile(rf"[{HYPHENS}][ \t]")
_LATIN = re.compile("[A-Za-z]")
_ANY_STRAY = re.compile(rf"[{re.escape(STRAY)}]")
_ANY_LOST = re.compile("[?'’]")
_TOUCHING = re.compile(r"\d[A-Za-zА-Яа-яЁё]|[A-Za-zА-Яа-яЁё]\d")

FEATURES = 27


def _width(bare: list[str]) -> float:
    sizes = sorted(map(len, filter(None, bare)))
    return max(20, sizes[int(0.8 * (len(sizes) - 1))]) if sizes else 20


def _is_page(line: str) -> bool:
    return len(line) <= 30 and bool(_PAGE.match(line))


def _is_number(line: str) -> bool:
    return len(line) <= 9 and bool(_NUMBER.match(line))


def _is_head(line: str) -> bool:
    return bool(_HEAD.search(line.lower()))


def _is_capitals(line: str) -> bool:
    return not line[1:].islower() and sum(map(str.isupper, line)) > 0.6 * max(1, sum(map(str.isalpha, line)))


def askable(bare: list[str]) -> list[int]:
    """Lines that may be furniture: shorter than a full line of the text, or worded or marked like a head or page number. The others are text."""
    width = 0.9 * _width(bare)
    return [i for i, ln in enumerate(bare) if ln and (len(ln) < width and not (ln[-1] == "." and ln[0].islower()) or ln[0] == "_" or ln[-1] == "_" or _is_page(ln) or _is_capitals(ln) or _is_head(ln)) and len(ln.split()) <= 14]


def line_features(bare: list[str], rows: list[int]) -> np.ndarray:
    """For each of the rows: its line's own shape, its neighbours' and how well the neighbours would join without it.

    bare holds the stripped lines of one text.
    """
    out = np.zeros((len(rows), FEATURES))
    if not rows:
        return out
    width = _width(bare)
    filled = [i for i, ln in enumerate(bare) if ln]
    place = {i: k for k, i in enumerate(filled)}
    n = len(filled)

    def beyond(k: int, step: int, number: bool) -> str:
        """The next line of text, past page numbers; past bare numbers too unless the line is one itself."""
        k += step
        while 0 <= k < n:
            ln = bare[filled[k]]
            if not (_is_number(ln) and not number or _is_page(ln) and not _is_number(ln)):
                return ln
            k += step
        return ""

    for r, i in enumerate(rows):
        ln = bare[i]
        k = place[i]
        before, after = bare[filled[k - 1]] if k else "", bare[filled[k + 1]] if k + 1 < n else ""
        page, number = _is_page(ln), _is_number(ln)
        prev, nxt = beyond(k, -1, number), beyond(k, 1, number)
        letters = sum(map(str.isalpha, ln))
        core = ln.strip("_ ")
        before_number, after_number = _is_number(before), _is_number(after)
        open_before = bool(prev) and not _SENTENCE_END.search(prev)
        out[r] = (
            len(ln) / width, sum(map(str.isdigit, ln)) / len(ln), sum(map(str.isupper, ln)) / max(1, letters), core[:1].islower(), core[:1].isupper(),
            bool(_SENTENCE_END.search(ln)), ln.count(" ") + 1, open_before, bool(prev) and prev[-1] in HYPHENS, nxt[:1].islower(),
            len(prev) / width, page, bool(_PAGE_WORD.match(ln)), number, _is_head(ln),
            before_number, after_number, not before_number and _is_page(before), not after_number and _is_page(after), i > 0 and not bare[i - 1],
            i + 1 < len(bare) and not bare[i + 1], np.log1p(int(re.search(r"\d+", ln).group())) if page else 0.0, prev.endswith("№"),
            ln[0] == "_" or ln[-1] == "_", ln[-1] in HYPHENS, bool(prev), bool(nxt),
        )
    return out


#: Shapes of page numbers and running heads put into clean text for training; {n}, {m} numbers, {y} a year, {w} a name.
PAGES = ("- {n} -", "— {n} —", "[{n}]", "{n}", "стр. {n}", "Лист {n}", "Страница {n} из {m}", "с. {n}", "({n})", "л. {n}", "{n}.", "Стр. {n}", "{n} / {m}")
HEADS = ("Шифр {n}/{m}", "Том {n}. Текст", "Том {n}. Приложения", "КОПИЯ ВЕРНА", "Раздел {n}. Сведения об объекте", "Глава {n}. Описание памятников", "Краевой архив. Инв. {m}", "Фонд {n}. Опись {m}", "Заключение экспертизы № {n}-{m}", "Акт ГИКЭ № {n}-{m}", "Акт государственной историко-культурной экспертизы № {n}-{m}", "Отчёт о разведке у {w}, {y}", "Отчёт о разведке у одиночного кургана {w}, {y}", "Отчёт о раскопках селища {w}, {y}", "Отчёт об исследованиях могильника {w}, {y}", "{w} А. В. Стоянка {w}", "{w} — {y}", "{w}: итоги полевого сезона", "Научный архив. Дело {m}", "Для служебного пользования")


def _with_noise(text: str, draw: random.Random) -> tuple[list[str], list[int]]:
    """Lines of a clean text wrapped, hyphenated and interleaved with furniture; 1 marks heads, 2 page numbers."""
    width = draw.randint(45, 95)
    names = [w for w in re.findall(r"[А-Я][а-яё]{4,}", text)] or ["Городище"]
    lines, labels = [], []
    furniture = draw.random() < 0.75
    for part in text.split("\n\n"):
        wrapped = textwrap.wrap(part, width) or [""]
        for k, ln in enumerate(wrapped):
            if k + 1 < len(wrapped) and draw.random() < 0.25:
                head, _, tail = wrapped[k + 1].partition(" ")
                if len(head) > 5 and head.isalpha():
                    at = draw.randint(2, len(head) - 2)
                    ln, wrapped[k + 1] = f"{ln} {head[:at]}{draw.choice(HYPHENS)}", f"{head[at:]} {tail}".strip()
            lines.append(ln)
            labels.append(0)
            if furniture and draw.random() < 0.12:
                values = {"n": draw.randint(1, 140), "m": draw.randint(2, 5000), "y": draw.randint(1890, 2024), "w": draw.choice(names)}
                put = []
                if draw.random() < 0.75:
                    put.append((draw.choice(PAGES).format(**values), 2))
                if draw.random() < 0.6:
                    shape = draw.choice(HEADS).format(**values)
                    shape = shape.upper() if draw.random() < 0.3 else shape
                    shape = f"__{shape}__" if draw.random() < 0.15 else shape
                    shape = f"{values['n']}.   {shape}" if draw.random() < 0.06 else shape
                    halves = shape.split(" ", 1)
                    put += [(s, 1) for s in (halves if len(halves) == 2 and draw.random() < 0.05 else [shape])]
                draw.shuffle(put) if draw.random() < 0.3 else None
                lines += [s for s, _ in put]
                labels += [x for _, x in put]
        if draw.random() < 0.12:
            column = [str(draw.randint(1, 99)) for _ in range(draw.randint(3, 9))]
            lines += ["Глубина залегания по квадратам, см:", *column]
            labels += [0] * (1 + len(column))
        elif draw.random() < 0.1:
            lines += [f"См. также Акт ГИКЭ № {draw.randint(1, 99)}-{draw.randint(1, 99)}, лист {draw.randint(1, 99)}, где упомянуты находки."]
            labels += [0]
        if draw.random() < 0.5:
            lines.append("")
            labels.append(0)
    return lines, labels


def line_models(texts: list[str], seed: int = 5) -> tuple[boosting.Boosted, boosting.Boosted]:
    """Classifiers of running heads and of page numbers, from clean texts, each with noise put into it twice."""
    draw = random.Random(seed)
    xs, ys = [], []
    for text in [*texts, *texts]:
        lines, labels = _with_noise(text, draw)
        bare = [ln.strip() for ln in lines]
        keep = askable(bare)
        xs.append(line_features(bare, keep))
        ys.append(np.array(labels)[keep])
    x, y = np.concatenate(xs) if xs else np.zeros((0, FEATURES)), np.concatenate(ys) if ys else np.zeros(0)
    return boosting.fit(x, y == 1), boosting.fit(x, y == 2)


_BOTH = re.compile(r"^[\W_]*(?:(?:стр|страница|лист|л|с|page)\b\.?\s*)?\d{1,4}[\W_]*?\s{2,}\S|\S\s{2,}[\W_]*(?:(?:стр|страница|лист|л|с|page)\b\.?\s*)?\d{1,4}[\W_]*$", re.I)


def furniture(texts: list[str], models: tuple[boosting.Boosted, boosting.Boosted]) -> list[tuple[list[str], np.ndarray]]:
    """Lines of each text and the kind of each: 0 text, 1 running head, 2 page number, 3 a head with its page number.

    The lines of all texts are classified together: trees over a few rows at a time would cost more than the rest.
    """
    out: list[tuple[list[str], np.ndarray]] = []
    asked: list[tuple[int, list[int]]] = []
    xs = []
    for n, text in enumerate(texts):
        lines = [ln.rstrip("\r") for ln in text.split("\n")]
        out.append((lines, np.zeros(len(lines), dtype=np.int64)))
        if len(lines) > 1:
            bare = [ln.strip() for ln in lines]
            ask = askable(bare)
            if ask:
                asked.append((n, ask))
                xs.append(line_features(bare, ask))
    if not xs:
        return out
    x = np.concatenate(xs)
    head, page = models[0].probability(x), models[1].probability(x)
    kinds_of = np.where((head >= FURNITURE) & (head >= page), 1, np.where(page >= FURNITURE, 2, 0))
    at = 0
    for n, ask in asked:
        lines, kinds = out[n]
        kinds[ask] = kinds_of[at : at + len(ask)]
        at += len(ask)
        for i in np.flatnonzero(kinds == 1):
            if _BOTH.search(lines[i].strip()):
                kinds[i] = 3
    return out


def breaks(lines: list[str], kinds: np.ndarray) -> list[tuple[int, int, str, str, str]]:
    """(line, next text line, left part, hyphen, right part) of words divided at a line end, furniture and blank lines skipped.

    The right part is small, or as the left one in capitals.
    """
    out = []
    rows = [i for i, ln in enumerate(lines) if kinds[i] == 0 and ln.strip()]
    for a, b in zip(rows, rows[1:], strict=False):
        if lines[a].rstrip(" \t")[-1:] not in _HYPHENS:
            continue
        m = _BREAK.search(lines[a])
        right = m and (_RIGHT.match(lines[b]) or len(m.group(1)) > 1 and m.group(1).isupper() and _RIGHT_CAPITALS.match(lines[b]))
        if right:
            out.append((a, b, m.group(1), lines[a].rstrip()[-1], right.group(1)))
    return out


def join_features(left: str, right: str, fill: int, known: dict[str, int]) -> list[float]:
    """Of a line pair with a word parted by a hyphen: what the corpus has of the word in one piece, of the compound and of
    either part, the parts' lengths, and how full the first line is in quarters (5 where the parts stand in one line)."""
    whole, parted = np.log1p(known.get(left + right, 0)), np.log1p(known.get(f"{left}-{right}", 0))
    return [whole, parted, whole - parted, np.log1p(known.get(left, 0)), np.log1p(known.get(right, 0)), len(left), len(right), left[-1] in "оеё", fill]


def join_model(texts: list[str], counts: Counter, scale: float, seed: int = 11) -> boosting.Boosted:
    """Tells divided words from compounds: words of clean texts divided on purpose, and their compounds parted at the hyphen.

    counts are those of the texts, held against the corpus by `scale`; the text a pair comes from counts for nothing, as a
    word of the corpus may stand nowhere else.
    """
    draw = random.Random(seed)
    xs, ys = [], []
    for text in texts:
        own = Counter(w.lower() for w in _TOKEN.findall(text))
        held = _Without(counts, own, scale)
        for w in own:
            fill = draw.choice((2, 3, 3, 3, 3, 4, 4, 5))
            if "-" in w:
                left, _, right = w.partition("-")
                xs.append(join_features(left, right, fill, held))
                ys.append(0)
            elif len(w) > 4 and draw.random() < 0.3:
                at = draw.randint(2, len(w) - 2)
                xs.append(join_features(w[:at], w[at:], fill, held))
                ys.append(1)
    if not xs or min(ys) == max(ys):
        return boosting.Boosted(5.0, [])
    return boosting.fit(np.array(xs, dtype=np.float64), np.array(ys), trees=30, depth=3)


class _Without(dict):
    """Counts without those of one text, scaled."""

    def __init__(self, counts: Counter, own: Counter, scale: float):
        super().__init__()
        self.counts, self.own, self.scale = counts, own, scale

    def get(self, word: str, default: int = 0) -> int:
        return int((self.counts.get(word, 0) - self.own.get(word, 0)) * self.scale)


def joined(pairs: list[tuple[str, str, str, int]], known: dict[str, int], model: boosting.Boosted) -> list[bool]:
    """Whether each (left, hyphen, right, fill) is a word that was divided; a soft hyphen always divides one.

    A model without trees knows no compounds: then the counts decide.
    """
    out = [h in SOFT for _, h, _, _ in pairs]
    open_ = [k for k, done in enumerate(out) if not done]
    rows = [join_features(pairs[k][0].lower(), pairs[k][2].lower(), pairs[k][3], known) for k in open_]
    if rows:
        told = model.probability(np.array(rows, dtype=np.float64)) >= JOINED if model.trees else [r[2] >= 0 for r in rows]
        for k, yes in zip(open_, told, strict=True):
            out[k] = bool(yes)
    return out


def parts_asked(left: str, right: str) -> tuple[str, ...]:
    """The words on whose counts the joining of a pair depends."""
    return left + right, f"{left}-{right}", left, right


def fullness(line: str, width: int) -> int:
    return min(4, int(4 * len(line.strip()) / width))


class Asking(dict):
    """Counts of the common words that note in `lacking` every other word they are asked for."""

    def __init__(self, known: dict[str, int]):
        super().__init__(known)
        self.lacking: set[str] = set()

    def get(self, word: str, default: int = 0) -> int:
        if not super().__contains__(word):
            self.lacking.add(word)
        return super().get(word, default)

    def __contains__(self, word: object) -> bool:
        self.get(word)
        return super().__contains__(word)


def inline_breaks(text: str) -> list[tuple[str, str, str]]:
    """(left part, hyphen, right part) of words divided inside a line."""
    if not _PARTED.search(text):
        return []
    return [(m.group(1), m.group()[len(m.group(1))], _TOKEN.match(text, m.end()).group()) for m in _INLINE.finditer(text)]


def sewn(text: str, told: dict[tuple[str, str], bool | None]) -> str:
    """A text whose words parted by a hyphen are put together.

    told has their (left, right) parts in small letters: true makes one word of them, false a compound, null leaves SEAM
    between them; parts it does not know make one word.
    """
    if not _PARTED_ANYHOW.search(text):
        return text
    return _JOINT.sub(lambda m: m.group(1) + {True: "", False: "-", None: SEAM}[told.get((m.group(1).lower(), m.group(2).lower()), True)], text)


def words_of(text: str) -> dict[str, bool]:
    """Words of a text in small letters, and whether each stands with a capital."""
    out: dict[str, bool] = {}
    for w in set(_SEAMED.findall(text)):
        low = w.lower()
        out[low] = out.get(low, False) or w[0].isupper() and not w.isupper()
    return out


def seams(word: str) -> Iterator[tuple[str, str, str]]:
    """(left part, right part, word) for each SEAM of a word, the word's other seams closed."""
    for m in re.finditer(SEAM, word):
        before, after = word[: m.start()], word[m.end() :]
        yield re.split(f"[-{SEAM}]", before)[-1], after.split(SEAM)[0], before.replace(SEAM, "") + SEAM + after.replace(SEAM, "")


def plain_misreadings(text: str) -> bool:
    """Whether a stray sign, a look-alike of the other script or a digit stands inside a word, or a letter in a number."""
    if _ANY_STRAY.search(text) and _STRAY.search(text) or _LATIN.search(text) and _MIXED.search(text) or _ANY_LOST.search(text) and _LOST.search(text):
        return True
    if not _TOUCHING.search(text):
        return False
    return bool(_IN_NUMBER.search(text)) or any(not _LETTERED.fullmatch(m.group()) for m in _IN_WORD.finditer(text.lower()))


_COUNTS = "word string, n long, capital long"


def _vocabulary(fields: DataFrame) -> DataFrame:
    """(word, n, capital): how often each word, lower case and compounds whole, stands in the texts; counted by batch first."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            counts: Counter = Counter()
            for text in pdf["text"].tolist():
                counts.update(_TOKEN.findall(_DIVIDED.sub(" ", text)))
            low: dict[str, list[int]] = {}
            for w, n in counts.items():
                held = low.setdefault(w.lower(), [0, 0])
                held[0] += n
                held[1] += n * (w[0].isupper() and not w.isupper())
            yield pd.DataFrame([(w, n, c) for w, (n, c) in low.items()], columns=["word", "n", "capital"])

    counted = fields.select("text").mapInPandas(run, _COUNTS)
    return counted.groupBy("word").agg(F.sum("n").alias("n"), F.sum("capital").alias("capital"))


def pair_features(word: str, n: float, capital: float, other: str, m: float) -> list[float] | None:
    """Of a word and a more frequent candidate: up to three letters wrong, or one added, lost or swapped; None if more."""
    added = lost = swapped = 0
    if len(word) == len(other):
        at = [k for k, (a, b) in enumerate(zip(word, other, strict=True)) if a != b]
        if not 0 < len(at) <= 3:
            return None
        alike = sum((word[k], other[k]) in _CONFUSED for k in at)
        swapped = int(len(at) == 2 and at[1] == at[0] + 1 and word[at[0]] == other[at[1]] and word[at[1]] == other[at[0]])
        if alike < len(at) and len(at) > 1 and not swapped:
            return None
        wrong, first, last = len(at), at[0], at[-1]
    elif abs(len(word) - len(other)) == 1:
        long, short = (word, other) if len(word) > len(other) else (other, word)
        first = next((k for k, (a, b) in enumerate(zip(long, short, strict=False)) if a != b), len(short))
        if long[:first] + long[first + 1 :] != short:
            return None
        added, lost = int(long == word), int(long == other)
        alike, wrong, last = 0, 1, first
    else:
        return None
    return [np.log1p(n), np.log1p(m), np.log(m / max(n, 1)), float(alike == wrong), float(wrong), float(last >= min(len(word), len(other)) - 2), len(word), capital / max(n, 1), added, lost, swapped, float(first == 0)]


def _corrupted(word: str, draw: random.Random) -> str:
    """A word as a scanner may give it: mostly letters confused, sometimes one added, lost or swapped inside."""
    out = list(word)
    if len(word) > 6 and draw.random() < 0.1:
        k = draw.randint(2, len(word) - 4)
        kind = draw.randint(0, 2)
        out[k : k + 2] = ([out[k], draw.choice("іїjl1"), out[k + 1]], [out[k]], [out[k + 1], out[k]])[kind]
        return "".join(out)
    for _ in range(draw.choice((1, 1, 1, 2, 2, 3))):
        at = [(k, b) for k, c in enumerate(out) for a, b in sorted(_CONFUSED) if a == c]
        if at:
            k, b = draw.choice(at)
            out[k] = b
    return "".join(out)


def pair_model(clean: Counter, total: int, all_words: int, seed: int = 7) -> boosting.Boosted:
    """Ranks correction candidates. clean: word counts of clean texts with `total` words of a corpus of `all_words`.

    Positive pairs are common words as a scanner may give them, at the low frequencies misreadings have; negative pairs are
    clean words beside more frequent clean words one slip away, and pieces of words divided at a line end beside the word.
    """
    draw = random.Random(seed)
    scale = max(1.0, all_words / max(1, total))
    xs: list[list[float]] = []
    ys: list[int] = []

    def put(label: int, *pair) -> None:
        row = pair_features(*pair)
        if row:
            xs.append(row)
            ys.append(label)

    words = [w for w in clean if len(w) > 1 and w.isalpha()]
    rare = lambda m: max(1, int(m * draw.choice((0.0005, 0.001, 0.003, 0.01))))
    for w in words:
        m = clean[w] * scale
        if m < 20:
            continue
        for _ in range(4):
            bad = _corrupted(w, draw)
            if bad != w and bad not in clean:
                n = rare(m)
                put(1, bad, n, 0 if draw.random() < 0.8 else n, w, m)
    index: dict[str, list[str]] = {}
    for w in words:
        for form in {w, *(w[:k] + w[k + 1 :] for k in range(len(w)))}:
            index.setdefault(form, []).append(w)
    for w in words:
        m = clean[w] * scale
        if m < 20 or len(w) < LEAST_SLIP:
            continue
        for k in {1, len(w) - 1, *(draw.randint(2, len(w) - 2) for _ in range(3))}:
            for piece in (w[:k], w[k:]):
                if len(piece) > 2 and piece not in clean:
                    near = {b for form in {piece, *(piece[:j] + piece[j + 1 :] for j in range(len(piece)))} for b in index.get(form, ())}
                    for b in sorted(near):
                        put(0, piece, rare(m), 0 if draw.random() < 0.8 else 1, b, clean[b] * scale)
    pairs = {(a, b) for near in index.values() for a in near for b in near if a != b and clean[b] >= TIMES * clean[a]}
    for a, b in sorted(pairs):
        n = max(1, int(clean[a] * scale))
        put(0, a, n, n if draw.random() < 0.5 else 0, b, clean[b] * scale)
    if not xs:
        return boosting.Boosted(-5.0, [])
    return boosting.fit(np.array(xs), np.array(ys), trees=30, depth=4)


def _grams(word: Column) -> Column:
    """array<struct<gram,place>> of a word's overlapping q-grams, an edge mark before and after it."""
    edged = F.concat(F.lit("^"), word, F.lit("$"))
    return F.transform(F.sequence(F.lit(1), F.length(edged) - (Q - 1)), lambda k: F.struct(F.substring(edged, k, F.lit(Q)).alias("gram"), k.alias("place")))


def candidates(vocabulary: DataFrame, words: DataFrame | None = None) -> DataFrame:
    """(word, other, n, m, capital): words beside those at least TIMES as frequent of which they may be a misreading.

    With `words`, a table like the vocabulary of words it lacks, only these are asked for.

    The inverted index holds the overlapping q-grams of the words' shapes, in which letters that print alike count as one:
    a misreading of any number of such letters has all grams of the right word. Words of LEAST_SLIP letters and more may be
    one slip apart besides (a letter wrong, added, lost, two swapped). Pairs so close share one of the SLIP + 1 rarest grams
    of each at places at most one apart, so the index holds no others, and common grams, which could make a hot key, only
    for words that have no rarer ones. Compounds are words, their hyphens letters; short words must be TIMES more frequent.
    """
    of = vocabulary.withColumn("asked", F.lit(words is None))
    of = of if words is None else of.unionByName(words.withColumn("asked", F.lit(True)))
    letters = of.where(F.col("word").rlike("^(?:[а-яё]+(?:-[а-яё]+)*|[a-z]+(?:-[a-z]+)*)$") & (F.length("word") > 1))
    letters = letters.select("word", "n", "capital", "asked", F.translate("word", CLASS_FROM, CLASS_TO).alias("shape"))
    opened = letters.select("word", F.inline(_grams(F.col("shape"))))
    spread = opened.groupBy("gram").agg(F.count("*").alias("df"))
    rarest = F.slice(F.sort_array(F.collect_list(F.struct("df", "gram", "place"))), 1, SLIP + 1)
    index = cut(opened.join(spread, "gram").groupBy("word").agg(rarest.alias("g")).join(letters, "word"))
    near = F.explode(F.array(*[F.col("g.place") + k for k in (-1, 0, 1)]))
    left = index.where("asked").select("word", "shape", "n", "capital", F.explode("g").alias("g")).select("word", "shape", "n", "capital", "g.gram", near.alias("place"))
    right = index.where(F.col("n") >= TIMES).select(F.col("word").alias("other"), F.col("shape").alias("o_shape"), F.col("n").alias("m"), F.explode("g").alias("g")).select("other", "o_shape", "m", "g.gram", "g.place")
    needed = F.when(F.length("word") <= 3, 10 * TIMES).otherwise(TIMES)
    close = (F.col("shape") == F.col("o_shape")) | (F.least(F.length("word"), F.length("other")) >= LEAST_SLIP) & spelling.one_slip(F.col("shape"), F.col("o_shape"))
    pairs = left.join(right, ["gram", "place"]).where((F.col("m") >= needed * F.col("n")) & (F.col("word") != F.col("other")) & close)
    return pairs.select("word", "other", "n", "m", "capital").distinct()


def misread(vocabulary: DataFrame, model: boosting.Boosted, words: DataFrame | None = None) -> DataFrame:
    """(word, reading, p): words that are a misreading of a more frequent one, with the candidate the model ranks first.

    Asked for the vocabulary's own words, or for `words` that it lacks.
    """

    def rank(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows, keep = [], []
            for k, (w, o, n, m, c) in enumerate(pdf[["word", "other", "n", "m", "capital"]].itertuples(index=False)):
                row = pair_features(w, n, c, o, m)
                if row:
                    rows.append(row)
                    keep.append(k)
            if rows:
                out = pdf.iloc[keep][["word", "other"]].rename(columns={"other": "reading"})
                yield out.assign(p=model.probability(np.array(rows)))

    ranked = candidates(vocabulary, words).mapInPandas(rank, "word string, reading string, p double").where(F.col("p") >= MISREAD)
    return ranked.groupBy("word").agg(F.max(F.struct("p", "reading")).alias("best")).select("word", F.col("best.reading").alias("reading"), F.col("best.p").alias("p"))


def training_texts(fields: DataFrame) -> list[str]:
    """At most TRAINING_TEXTS clean texts, those of least hash: the same ones in whatever order the rows come.

    The hashes alone are ordered; no task sends texts but those chosen.
    """
    is_clean = ~F.col("text").rlike(rf"(?<!\n)\n(?!\n)|[{re.escape(STRAY)}¬­]|[{HYPHENS}] ") & (F.length("text") > 200)
    hashed = fields.select("text", F.xxhash64("text").alias("h"))
    least = hashed.where(is_clean).select("h").distinct().orderBy("h").limit(TRAINING_TEXTS).agg(F.max("h")).first()[0]
    if least is None:
        return []
    rows = hashed.where(F.col("h") <= least).where(is_clean).distinct().collect()
    return [t for _, t in sorted((r["h"], r["text"]) for r in rows)][:TRAINING_TEXTS]


def _common(counts: DataFrame) -> tuple[int, bool]:
    """(least count of a common word, whether all words are common, so that nothing needs a join).

    Words are counted by powers of two of their counts, and the powers are common from the top on as long as there are at
    most COMMON_WORDS of them: nothing is ordered and no task sends more words than are kept.
    """
    power = F.floor(F.log2("n")).cast("int")
    sizes = {r["p"]: r["c"] for r in counts.groupBy(power.alias("p")).agg(F.count("*").alias("c")).collect()}
    held, least = 0, 1 << 62
    for p in sorted(sizes, reverse=True):
        held += sizes[p]
        if held > COMMON_WORDS:
            return least, False
        least = 1 << p
    return least, True


class Models:
    """What the scan of the texts needs: the classifiers, the misread words' table and the common words."""

    def __init__(self, fields: DataFrame):
        sample = [t for t in training_texts(fields) if not plain_misreadings(t)]
        self.lines = line_models(sample)
        self.vocabulary = cut(_vocabulary(fields))
        words = Counter(w.lower() for t in sample for w in _TOKEN.findall(t))
        total = max(1, sum(words.values()))
        everything = self.vocabulary.agg(F.sum("n")).first()[0] or 0
        self.joins = join_model(sample, words, max(1.0, everything / total))
        self.pairs = pair_model(words, total, everything)
        self.bad = cut(misread(self.vocabulary, self.pairs))
        self.counts = self.vocabulary.join(self.bad.select("word"), "word", "left_anti").select("word", "n")
        least, self.whole = _common(self.counts)
        self.common = {r["word"]: r["n"] for r in self.counts.where(F.col("n") >= least).collect()}


    def misreadings(self, words: DataFrame) -> DataFrame:
        """(word, reading): those of words(word, capital), a row for each text they stand in, that are misread.

        The vocabulary has the words that stand whole somewhere; those that it lacks, as every text has them divided or with
        a stray sign inside, are held against it besides.
        """
        lacking = words.join(self.vocabulary.select("word"), "word", "left_anti").groupBy("word")
        lacking = cut(lacking.agg(F.count("*").alias("n"), F.sum(F.col("capital").cast("long")).alias("capital")))
        return cut(self.bad.unionByName(misread(self.vocabulary, self.pairs, lacking))).select("word", "reading")


def findings(fields: DataFrame, keys: list[str], models: Models) -> DataFrame:
    """(keys, noise, token, capital, pair): noise found in each text, and what the common words cannot decide (noise null).

    token is a word not among the common ones, capital whether it stands with one; pair a word parted by a hyphen (left,
    right, fill), token then null or a word with SEAM for that hyphen. A text whose misreadings show without any count
    ('char' by plain_misreadings) gives no tokens: they could only say the same again.
    """
    common, lines_of, joins, whole = models.common, models.lines, models.joins, models.whole
    kinds_of = dict(fields.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows: list[tuple] = []
            texts = pdf["text"].tolist()
            of = list(pdf[keys].itertuples(index=False, name=None))
            asked: list[tuple[int, tuple[str, str, str, int]]] = []
            bodies: dict[int, tuple[str, dict[tuple[str, str], bool | None], dict[tuple[str, str], bool]]] = {}
            fills: dict[int, dict[tuple[str, str], int]] = {}
            for n, (key, text, (lines, kinds)) in enumerate(zip(of, texts, furniture(texts, lines_of), strict=True)):
                found: set[str] = set()
                if (kinds & 1).any():
                    found.add("header")
                if (kinds & 2).any():
                    found.add("page")
                body = "\n".join(ln for ln, k in zip(lines, kinds, strict=True) if k == 0) if kinds.any() else text
                pairs = breaks(lines, kinds)
                width = _width([ln.strip() for ln in lines]) if pairs else 0
                divided = {(a.lower(), h, b.lower(), fullness(lines[at], width)) for at, _, a, h, b in pairs} | {(a.lower(), h, b.lower(), 5) for a, h, b in inline_breaks(text)}
                told_of: dict[tuple[str, str], bool | None] = {}
                for d in divided:
                    if whole or d[1] in SOFT or all(w in common for w in parts_asked(d[0], d[2])):
                        asked.append((n, d))
                    else:
                        rows.append((*key, None, None, None, {"left": d[0], "right": d[2], "fill": d[3]}))
                        told_of[d[0], d[2]] = None
                        fills.setdefault(n, {})[d[0], d[2]] = d[3]
                if plain_misreadings(body):
                    found.add("char")
                else:
                    bodies[n] = body, told_of, {}
                rows += [(*key, x, None, None, None) for x in found]
            # The pairs of a batch are classified together, as its lines are.
            hyphens = set()
            for (n, d), yes in zip(asked, joined([d for _, d in asked], common, joins), strict=True):
                if yes:
                    hyphens.add(n)
                if n in bodies and bodies[n][1].setdefault((d[0], d[2]), yes) is not None and d[1] not in SOFT and not common.get(d[0] + d[2] if yes else f"{d[0]}-{d[2]}"):
                    bodies[n][2][d[0], d[2]] = not yes
            rows += [(*of[n], "hyphen", None, None, None) for n in hyphens]
            for n, (body, told_of, unsure) in bodies.items():
                held = words_of(sewn(body, told_of))
                # What a pair makes may be misread and so unknown: then it is looked for either way.
                for w, capital in (words_of(sewn(body, {**told_of, **unsure})) | held if unsure else held).items():
                    if SEAM not in w:
                        if w not in common:
                            rows.append((*of[n], None, w, capital, None))
                        continue
                    for a, b, one in seams(w):
                        if (a, b) in fills.get(n, ()):
                            rows.append((*of[n], None, one, capital, {"left": a, "right": b, "fill": fills[n][a, b]}))
            yield pd.DataFrame(rows, columns=[*keys, "noise", "token", "capital", "pair"])

    schema = ", ".join(f"{k} {kinds_of[k]}" for k in keys) + ", noise string, token string, capital boolean, pair struct<left:string,right:string,fill:int>"
    return fields.select(*keys, "text").mapInPandas(run, schema)


def _decided(pairs: DataFrame, models: Models) -> DataFrame:
    """pairs(left, right, fill), whether each is a divided word, and whether what it makes stands in the whole vocabulary."""
    model = models.joins
    names = ("whole", "parted", "left", "right")
    wanted = pairs.withColumns({"w_whole": F.concat("left", "right"), "w_parted": F.concat_ws("-", "left", "right"), "w_left": F.col("left"), "w_right": F.col("right")})
    for name in names:
        wanted = wanted.join(models.counts.select(F.col("word").alias(f"w_{name}"), F.col("n").alias(f"n_{name}")), f"w_{name}", "left")

    @F.pandas_udf("boolean")
    def yes(left: pd.Series, right: pd.Series, fill: pd.Series, *counts: pd.Series) -> pd.Series:
        out = []
        for a, b, f, *n in zip(left, right, fill, *(c.fillna(0) for c in counts), strict=True):
            out += joined([(a, "-", b, int(f))], dict(zip(parts_asked(a, b), map(int, n), strict=True)), model)
        return pd.Series(out, dtype=bool)

    told = wanted.withColumn("divided", yes("left", "right", "fill", *[f"n_{n}" for n in names]))
    return told.select("left", "right", "fill", "divided", F.when(F.col("divided"), F.col("n_whole") > 0).otherwise(F.col("n_parted") > 0).alias("sure"))


def noise(fields: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, noise): each kind of noise (hyphen, char, header, page) that occurs in a text at least once, no row twice.

    fields: keys and text; rows with equal keys count once (the first of equal copies). Null and empty texts have no
    noise. The classifiers are trained on at most TRAINING_TEXTS clean texts; vocabulary, candidates and verdicts cover
    every text whole. Other columns are not read.
    """
    own = fields.select(*keys, "text").where(F.length("text") > 0)
    models = Models(own)
    found = cut(findings(own, keys, models))
    all_found = found.where("noise is not null").select(*keys, "noise")
    words = found.where("token is not null and pair is null").select(*keys, F.col("token").alias("word"), "capital")
    if not models.whole:
        parted = found.where("pair is not null").select(*keys, "token", "capital", "pair.*")
        parted = parted.join(cut(_decided(parted.select("left", "right", "fill").distinct(), models)), ["left", "right", "fill"])
        all_found = all_found.unionByName(parted.where("token is null and divided").select(*keys, F.lit("hyphen").alias("noise")))
        one, two = F.translate("token", SEAM, ""), F.translate("token", SEAM, "-")
        forms = F.when(~F.coalesce("sure", F.lit(False)), F.array(one, two)).when(F.col("divided"), F.array(one)).otherwise(F.array(two))
        words = words.unionByName(parted.where("token is not null").select(*keys, F.explode(forms).alias("word"), "capital"))
    misread_words = words.join(models.misreadings(words).select("word"), "word", "left_semi")
    return all_found.unionByName(misread_words.select(*keys, F.lit("char").alias("noise"))).distinct()


def repair(lines: list[str], kinds: np.ndarray, known: dict[str, int], model: boosting.Boosted) -> str:
    """Continuous paragraphs: furniture out, divided words joined, wrapped lines run on, strays and letters of the other script out."""
    pairs = breaks(lines, kinds)
    width = _width([ln.strip() for ln in lines]) if pairs else 0
    told = joined([(x, h, y, fullness(lines[a], width)) for a, _, x, h, y in pairs], known, model)
    joins = {(a, b): yes for (a, b, *_), yes in zip(pairs, told, strict=True)}
    rows = [i for i in range(len(lines)) if kinds[i] == 0]
    paragraphs, current, last = [], "", None
    for i in rows:
        ln = lines[i].strip()
        if not ln:
            # A blank line that furniture left behind inside a sentence parts nothing.
            if current and _SENTENCE_END.search(current):
                paragraphs.append(current)
                current = ""
            continue
        if current and (last, i) in joins:
            current = current.rstrip()[:-1] + ln if joins[last, i] else current.rstrip() + ln
        elif current and _NUMBER.match(ln):
            current += "\n" + ln
        else:
            current = f"{current} {ln}" if current else ln
        last = i
    if current:
        paragraphs.append(current)
    out = "\n\n".join(paragraphs)

    def one_line(m: re.Match) -> str:
        (yes,) = joined([(m.group(1), m.group()[len(m.group(1))], _TOKEN.match(m.string, m.end()).group(), 5)], known, model)
        return m.group(1) if yes else m.group().rstrip()

    out = _INLINE.sub(one_line, out) if _PARTED.search(out) else out
    out = re.sub(r"(?<=[а-яё])['’](?=[а-яё])", "", _STRAY.sub("", out))
    return re.sub(r"[^\W_]*(?:[а-яё][A-Za-z0-9]|[A-Za-z0-9][а-яё])[^\W_]*", lambda m: _one_script(m.group(), known), out, flags=re.I)


def corrected(text: str, fixes: dict[str, str]) -> str:
    """A repaired text with its misread words put right."""

    def fix(m: re.Match) -> str:
        w = m.group()
        good = fixes.get(w.lower())
        return w if good is None else good.upper() if w.isupper() and len(w) > 1 else good.capitalize() if w[0].isupper() else good

    return _TOKEN.sub(fix, text)


def _one_script(word: str, known: dict[str, int]) -> str:
    fixed = "".join(DIGITS.get(c, c) for c in word.translate(TO_CYRILLIC)) if not re.fullmatch(r"\d+[а-яё]{1,2}", word, re.I) else word
    return fixed if fixed.lower() in known or not re.search(r"\d", word) else word


def repaired(fields: DataFrame, keys: list[str]) -> DataFrame:
    """fields(keys, text) with each text repaired; null stays null, empty stays empty. Keys are unique, equal rows count each.

    The texts stay where they are: what a text needs of the corpus (counts of its rare words, readings of its misread words)
    is gathered by key and joined to it, as a broadcast where the written table is small. Misread words are looked for in the
    repaired texts, after divided words are joined and strays are out, and whatever other noise a text has.
    """
    own = fields.select(*keys, "text")
    models = Models(own.where(F.length("text") > 0))
    lines_of, common, joins = models.lines, models.common, models.joins

    def to_own(table: DataFrame, other: DataFrame) -> DataFrame:
        """table with other's columns by key, null keys equal."""
        named = other.withColumnsRenamed({k: f"_{k}" for k in keys})
        return table.join(named, reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]), "left").drop(*[f"_{k}" for k in keys])

    @F.pandas_udf("array<string>")
    def asked(texts: pd.Series) -> pd.Series:
        """Words beyond the common ones on whose counts the repair of each text depends."""
        out = []
        for lines, kinds in furniture(texts.tolist(), lines_of):
            asking.lacking.clear()
            repair(lines, kinds, asking, joins)
            out.append(list(asking.lacking))
        return pd.Series(out, dtype=object)

    asking = Asking(common)
    whole = own.withColumn("counts", F.lit(None).cast("map<string,bigint>"))
    if not models.whole:
        wanted = own.where(F.length("text") > 0).select(*keys, F.explode(asked("text")).alias("word"))
        counts = wanted.distinct().join(models.counts, "word").groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("word", "n"))).alias("counts"))
        whole = to_own(own, cut(counts))

    @F.pandas_udf("text string, words array<struct<word:string,capital:boolean>>")
    def put(texts: pd.Series, counts: pd.Series) -> pd.DataFrame:
        rows: list[tuple] = []
        for text, c, lk in zip(texts, counts, furniture([t or "" for t in texts], lines_of), strict=True):
            out = repair(*lk, common if c is None else ChainMap(dict(c), common), joins) if text else text
            rows.append((out, [{"word": w, "capital": capital} for w, capital in words_of(out).items() if w not in common] if out else []))
        return pd.DataFrame(rows, columns=["text", "words"])

    done = cut(whole.select(*keys, put("text", "counts").alias("r")).select(*keys, "r.*"))
    words = done.select(*keys, F.inline("words"))
    fixes = words.join(models.misreadings(words), "word").groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("word", "reading"))).alias("fixes"))

    @F.pandas_udf("string")
    def fixed(texts: pd.Series, fix: pd.Series) -> pd.Series:
        return pd.Series([corrected(t, dict(f)) if f is not None else t for t, f in zip(texts, fix, strict=True)], dtype=object)

    return to_own(done.drop("words"), cut(fixes)).select(*keys, fixed("text", "fixes").alias("text"))
