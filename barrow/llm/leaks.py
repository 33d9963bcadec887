"""Evaluation texts leaking into training text (problem 7).

Words are canonicalised into templates: numbers, names and units become typed placeholders, the other words of the test
items stay. Windows of consecutive template words are hashed and hash-joined between items and documents. A window whose
slots, the words behind the placeholders, are the same is a leak. Windows that agree in template alone are a question put
again with other values if their slots are consistent: along one alignment of document and item, a word of the item always
stands for the same word of the document.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barrow.llm.words import JOINT, WORDS, fold, plain, whole, words
from barrow.session import cut

WINDOW = 12
#: Words of a window that must be literal for it to show a question put again; the rest may be placeholders.
LITERAL = 7
#: Hashes of test windows kept in memory by every task, to filter the scan; with more the shuffled join does without.
MOST_WINDOWS = 2_000_000
#: Distinct words a test set may have: every task keeps them, to tell literal words from names.
MOST_WORDS = 5_000_000

#: Words of measure, in folded form, that take the placeholder of units.
UNITS = frozenset("мм см дм м км га кв куб г кг т л сажени саженей сажень аршин аршина версты версту верст локтя локтей золотника пуд пуда mm cm m km ha kg g ft in yd fathom fathoms feet inches yards miles acres pounds".split())
_NUMBER, _NAME, _UNIT, _LETTER = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5))
_BASE = 0x5851F42D4C957F2D


def _hash(word: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(word)


@dataclass(frozen=True)
class Lexicon:
    """What the test set knows: every folded word, and those that are literal in a template."""

    known: frozenset[str]
    literal: frozenset[str]


def _seen(text: str) -> Iterator[tuple[str, bool, bool]]:
    """(folded word, written small, written with a capital inside a sentence) of the words of a text."""
    bare = plain(text)
    for w in set(words(text)):
        yield w, False, False
    for m in re.finditer(r"[^\W\d_]+", bare):
        small = m.group()[0].islower()
        yield words(m.group())[0], small, not small and not re.search(r"(?:^|[.!?:;…]\W*|\n\W*)$", bare[max(0, m.start() - 4) : m.start()])


def lexicon(items: DataFrame, text: str) -> Lexicon:
    """The words of a test set, folded per batch and over all before they are collected; its texts are not.

    A word is a name if it is written with a capital inside a sentence and never without one; else it is literal. More
    than MOST_WORDS distinct words are an error.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            held: dict[str, list[bool]] = {}
            for t in pdf["_text"].tolist():
                for w, small, inside in _seen(t):
                    h = held.setdefault(w, [False, False])
                    h[0] |= small
                    h[1] |= inside
            yield pd.DataFrame([(w, a, b) for w, (a, b) in held.items()], columns=["word", "small", "inside"])

    told = items.select(F.col(text).alias("_text")).where(F.length("_text") > 0).mapInPandas(run, "word string, small boolean, inside boolean")
    told = told.groupBy("word").agg(F.max("small").alias("small"), F.max("inside").alias("inside")).limit(MOST_WORDS + 1).collect()
    if len(told) > MOST_WORDS:
        raise ValueError("the test set has more distinct words than a task can keep")
    literal = (r["word"] for r in told if not r["word"].isdigit() and len(r["word"]) > 1 and r["word"] not in UNITS and (r["small"] or not r["inside"]))
    return Lexicon(frozenset(r["word"] for r in told), frozenset(literal))


def _powers(width: int) -> np.ndarray:
    return np.array([pow(_BASE, k, 1 << 64) for k in range(width - 1, -1, -1)], dtype=np.uint64)


def _rolling(codes: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all windows of a code sequence, modulo 2**64."""
    out = np.zeros(len(codes) - width + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k, p in enumerate(_powers(width)):
            out += codes[k : k + len(out)] * p
        out ^= out >> np.uint64(29)
        out *= np.uint64(0xBF58476D1CE4E5B9)
    return out


class Templates:
    """Turns texts into window hashes (template, slots); remembers the codes of runs it has seen."""

    def __init__(self, lex: Lexicon, width: int):
        self.lex, self.width = lex, width
        self._forget()

    def _forget(self) -> None:
        self.at: dict[str, int] = {}
        self.template, self.slot = np.zeros(1 << 16, dtype=np.uint64), np.zeros(1 << 16, dtype=np.uint64)

    def code(self, word: str) -> tuple[int, int]:
        """Template and slot code of a folded word."""
        if word in self.lex.literal:
            return _hash(word), 0
        kind = _NUMBER if word.isdigit() else _LETTER if len(word) == 1 else _UNIT if word in UNITS else _NAME
        return int(kind), _hash(word)

    def _learn(self, run: str) -> int:
        if run in self.at:
            return self.at[run]
        k = len(self.at)
        if k == len(self.template):
            self.template, self.slot = np.resize(self.template, 2 * k), np.resize(self.slot, 2 * k)
        self.template[k], self.slot[k] = self.code(fold(run))
        self.at[run] = k
        return k

    def codes(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        bare = plain(text)
        found = WORDS.findall(bare)
        if JOINT in bare:
            found = [w for run in found for w in (whole(run, self.lex.known) if JOINT in run else (run,))]
        if len(self.at) + len(found) >= 400_000:
            self._forget()
        get = self.at.get
        at = [get(run) for run in found]
        if None in at:
            at = [self._learn(run) if k is None else k for run, k in zip(found, at, strict=True)]
        at = np.array(at, dtype=np.int64)
        return self.template[at], self.slot[at]

    def windows(self, text: str | None, only: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(template, slots, place, slot codes) of all windows, or of those whose template is among the sorted hashes `only`.

        Slot codes are the hashes of a window's slots in order, 0 where a word is literal.
        """
        none = np.zeros(0, dtype=np.uint64)
        if not text:
            return none, none, none, none.reshape(0, self.width)
        template, slot = self.codes(text)
        if len(template) < self.width:
            return none, none, none, none.reshape(0, self.width)
        a = _rolling(template, self.width)
        at = np.arange(len(a)) if only is None else np.flatnonzero(only[np.minimum(np.searchsorted(only, a), len(only) - 1)] == a)
        if not len(at):
            return none, none, none, none.reshape(0, self.width)
        return a[at], _rolling(slot, self.width)[at], at, np.lib.stride_tricks.sliding_window_view(slot, self.width)[at]


def _patterns(codes: np.ndarray) -> np.ndarray:
    """Hash of each row's slots numbered as they first occur: equal for rows that differ in their values alone."""
    same = codes[:, :, None] == codes[:, None, :]
    numbered = np.where(codes == 0, 0, 1 + same.argmax(axis=2)).astype(np.uint64)
    with np.errstate(over="ignore"):
        return (numbered * _powers(codes.shape[1])).sum(axis=1, dtype=np.uint64)


def template_windows(df: DataFrame, key: str, text: str, lex: Lexicon, width: int = WINDOW, only: np.ndarray | None = None) -> DataFrame:
    """(key, template, slots, place, pattern, codes) of each text's windows; with `only`, those whose template is among these hashes.

    pattern tells which slots of the window are the same word, codes the words by their hashes, 0 where a word is literal;
    both are null for windows of less than LITERAL literal words.
    """
    kind = dict(df.dtypes)[key]
    literal = round(LITERAL / WINDOW * width)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        make = Templates(lex, width)
        for pdf in batches:
            rows: dict[str, list] = {"_key": [], "template": [], "slots": [], "place": [], "pattern": [], "codes": []}
            for k, t in zip(pdf["_key"].tolist(), pdf["_text"].tolist(), strict=True):
                a, b, at, codes = make.windows(t, only)
                if len(a):
                    rows["_key"] += [k] * len(a)
                    rows["template"] += a.view(np.int64).tolist()
                    rows["slots"] += b.view(np.int64).tolist()
                    rows["place"] += at.tolist()
                    few = ((codes == 0).sum(axis=1) < literal).tolist()
                    rows["pattern"] += [None if f else p for f, p in zip(few, _patterns(codes).view(np.int64).tolist(), strict=True)]
                    rows["codes"] += [None if f else c for f, c in zip(few, codes.view(np.int64), strict=True)]
            if rows["_key"]:
                out = pd.DataFrame(rows)
                yield out.assign(pattern=out["pattern"].astype("Int64"))

    picked = df.select(F.col(key).alias("_key"), F.col(text).alias("_text")).where(F.col("_key").isNotNull() & (F.length("_text") > 0))
    return picked.mapInPandas(run, f"_key {kind}, template long, slots long, place int, pattern long, codes array<long>").withColumnRenamed("_key", key)


def leaks(documents: DataFrame, items: DataFrame, *, doc: str = "doc_id", item: str = "item_id", text: str = "text", width: int = WINDOW, every: bool = False) -> DataFrame:
    """What documents have of test items: (doc, item, exact, windows), no (doc, item, exact) twice.

    exact is true where the slots agree too: the document holds `width` consecutive words of the item. Where it is false
    the document puts the item again with other values: it has windows of its template, and along one alignment each slot
    word of the item, single letters aside, always is the same word of the document. With `every` all such items are named, wherever in an item
    the window stands. Without it only the least is named of the items that have a window in common but for its values, so
    a form shared by many items makes one row for a document.
    windows counts the windows that show it. Null and empty texts, and texts of fewer than `width` words, match nothing;
    equal documents under several ids are found one by one; repeated rows give no further rows. Other columns are not read.

    Every task keeps the words of the test set and, up to MOST_WINDOWS, the hashes of its windows, which filter the
    documents' inside the scan; the hash join decides either way. No text and nothing of the corpus reaches the driver.
    """
    if doc == item:
        raise ValueError("documents and items need key columns of different names")
    kinds = dict(documents.dtypes)[doc], dict(items.dtypes)[item]
    lex = lexicon(items, text)
    own = cut(template_windows(items, item, text, lex, width).withColumnRenamed(item, "_item"))
    hashes = own.select("template").distinct().limit(MOST_WINDOWS + 1).toPandas()["template"].to_numpy(dtype=np.int64).view(np.uint64)
    if not len(hashes):
        return documents.sparkSession.createDataFrame([], f"`{doc}` {kinds[0]}, `{item}` {kinds[1]}, exact boolean, windows long")
    small = len(hashes) <= MOST_WINDOWS
    found = template_windows(documents, doc, text, lex, width, np.sort(hashes) if small else None).withColumnRenamed(doc, "_doc")
    # Without the filter the windows of all documents meet those of the items first, by a semi join.
    found = cut(found if small else found.join(own.select("template").distinct(), "template", "left_semi"))
    same = found.select("_doc", "template", "slots").distinct().join(own.select("_item", "template", "slots").distinct(), ["template", "slots"])
    same = same.groupBy("_doc", "_item").agg(F.lit(True).alias("exact"), F.countDistinct("template", "slots").alias("windows"))
    # Windows put again: not those that the test set has as they are, and with all items or one for each form (template and
    # pattern) of a window. A window meets the forms of its template with other patterns too: they tear the alignment they stand in.
    forms = own.where("pattern is not null").select("template", "pattern", F.struct("_item", "place", "codes").alias("i")).distinct()
    if not every:
        forms = forms.groupBy("template", "pattern").agg(F.min("i").alias("i"))
    other = found.where("pattern is not null").join(own.select("template", "slots").distinct(), ["template", "slots"], "left_anti")
    other = other.select("_doc", "template", "place", "codes").distinct().join(forms.drop("pattern"), "template")
    # A single letter is a preposition here and an initial there: it need not always be the same.
    letters = [int(np.uint64(_hash(w)).view(np.int64)) for w in sorted(lex.known) if len(w) == 1 and not w.isdigit()]
    pairs = other.select("_doc", F.col("i._item").alias("_item"), (F.col("place") - F.col("i.place")).alias("line"), "place", F.arrays_zip(F.col("i.codes").alias("a"), F.col("codes").alias("b")).alias("s"))
    runs = pairs.groupBy("_doc", "_item", "line").agg(F.countDistinct("place").alias("windows"))
    mapped = pairs.select("_doc", "_item", "line", F.explode("s").alias("s")).where(F.col("s.a").isin([0, *letters]) == F.lit(False)).groupBy("_doc", "_item", "line", "s.a").agg((F.min("s.b") != F.max("s.b")).alias("torn"))
    again = runs.join(mapped.where("torn").select("_doc", "_item", "line").distinct(), ["_doc", "_item", "line"], "left_anti")
    again = again.groupBy("_doc", "_item").agg(F.lit(False).alias("exact"), F.sum("windows").alias("windows"))
    return same.unionByName(again).withColumnsRenamed({"_doc": doc, "_item": item})
