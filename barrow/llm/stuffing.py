"""Keyword-stuffed and link-list pages (problem 8).

Each page gets its rank-frequency curve; SQL windows turn it into ranks and a weighted fit gives slope and residual. Both,
and the height of the curve, are held against those of prose in the same language at comparable lengths. The third measure
is the divergence of the page's words from that prose: the share of the page in repeated words that the prose hardly
knows. A page of a usual curve is stuffed if most of it diverges; the further its curve lies from prose, the less is asked.

What is prose is learned from the pages: stretches of text that repeat few of their longer words. What language a page is
in is learned from the letters of the pages by their label, as labels are missing or wrong on some.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barrow.session import cut

#: Words of a stretch of text; it is prose if words of LONG letters and more that stand in it twice are at most this share.
#: Passages of PASSAGE words that a page brings again count once.
STRETCH, LONG, REPEATED, PASSAGE = 64, 4, 0.25, 4
#: A page is prose, for the curves that others are held against, if this share of its words stands in prose.
PROSE_PAGE = 0.75
#: A repeated word diverges if it is this many times as frequent as in prose, where it has at most this share of the words.
#: At most 1 / RARE words of a language have more, so the table of known words is bounded, however large the corpus.
TIMES, RARE = 12.0, 4e-5
#: A word with this share of the page diverges however common it is in prose.
HEAVY = 0.25
#: Share of the page that must diverge where the curve is that of prose, and where it lies FAR standard deviations off it.
#: Less than half: the words that fill up lists of keywords, names above all, stand there once and do not count.
MOST, LEAST, FAR = 0.46, 0.34, 2.5
#: Prose pages a length class needs to have a curve of its own; those with less take the next shorter class's.
ENOUGH = 30
#: A label names a language if this share of the labelled pages has it: at most 1 / COMMON_LABEL languages.
COMMON_LABEL = 0.01
#: Letters are counted by their code modulo PLACES.
PLACES = 128

LINK, TAG = "‹link›", "‹tag›"
_LINK = re.compile(r"(?:https?://|www\.)[^\s<>()\[\]|,;\"']+|\b[a-z0-9-]{2,}(?:\.[a-z0-9-]+)*\.[a-z]{2,8}/[^\s<>()\[\]|,;\"']*", re.I)
_TAG = re.compile(r"#[^\W\d][\w-]*")
_MARKUP = re.compile(r"<[^<>]*>|&[a-z]+;")
_PART = re.compile(r"[^\W_]+")
_TOKEN = re.compile(r"[^\W\d_]+|\d+")


def tokens(text: str) -> tuple[list[str], int]:
    """(words, numbers) of a page: words in lower case, ё as е, numbers as a count.

    A link is LINK as often as its address has parts, a tag TAG as often as it has words. Words of up to four letters in
    front of a number and three after it are its unit or the name of its column and go with it, unless they stand again and
again beside the same few numbers, as units do not.
    """
    text = text.lower().replace("ё", "е")
    marks: list[str] = []
    if "/" in text or "www." in text:
        links = _LINK.findall(text)
        if links:
            marks += [LINK] * sum(len(_PART.findall(m)) for m in links)
            text = _LINK.sub(" ", text)
    if "<" in text or "&" in text:
        text = _MARKUP.sub(" ", text)
    if "#" in text:
        tags = _TAG.findall(text)
        if tags:
            marks += [TAG] * sum(len(_PART.findall(m)) for m in tags)
            text = _TAG.sub(" ", text)
    found = _TOKEN.findall(text)
    at = [k for k, w in enumerate(found) if w.isdigit()]
    if not at:
        return found + marks, 0
    beside: dict[str, list[tuple[int, str]]] = {}
    for k in at:
        if k and len(found[k - 1]) <= 4 and not found[k - 1].isdigit():
            beside.setdefault(found[k - 1], []).append((k - 1, found[k]))
        if k + 1 < len(found) and len(found[k + 1]) <= 3 and not found[k + 1].isdigit():
            beside.setdefault(found[k + 1], []).append((k + 1, found[k]))
    gone = set(at)
    for places in beside.values():
        if len(places) < 4 or 4 * len({number for _, number in places}) > len(places):
            gone.update(k for k, _ in places)
    return [w for k, w in enumerate(found) if k not in gone] + marks, len(at)


def _stretches(words: list[str]) -> list[list[str]]:
    n = max(1, len(words) // STRETCH)
    parts = [words[k * STRETCH : (k + 1) * STRETCH if k + 1 < n else len(words)] for k in range(n)]
    return [p for p in parts if sum(c for w, c in Counter(p).items() if c > 1 and len(w) >= LONG) <= REPEATED * len(p)]


def prose_stretches(words: list[str]) -> tuple[list[list[str]], float]:
    """The stretches of a page that are prose, and their share of its words; less than half a stretch of words has none.

    Where some stretch is none, passages that the page brings again (PASSAGE words and more) are taken out first: prose
    that was pasted twice is prose.
    """
    if 2 * len(words) < STRETCH:
        return [], 0.0
    parts = _stretches(words)
    if sum(map(len, parts)) == len(words):
        return parts, 1.0
    seen: set[tuple[str, ...]] = set()
    again = np.zeros(len(words), dtype=bool)
    for k, gram in enumerate(zip(*(words[j:] for j in range(PASSAGE)), strict=False)):
        if gram in seen:
            again[k : k + PASSAGE] = True
        else:
            seen.add(gram)
    if not again.any():
        return parts, sum(map(len, parts)) / len(words)
    words = [w for w, x in zip(words, again.tolist(), strict=True) if not x]
    parts = _stretches(words) if 2 * len(words) >= STRETCH else []
    return parts, sum(map(len, parts)) / max(1, len(words))


_PAGE = "lang string, letters array<int>, n int, numbers int, prose double, curve array<struct<f:int,m:int>>, repeated array<struct<w:string,c:int>>"


def profiles(documents: DataFrame, key: str, text: str, lang: str | None) -> DataFrame:
    """One pass over the texts: rows of kind 'page' (its counts and curve) and 'word' (words of prose by label, '' without one, summed by batch)."""
    kind = dict(documents.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            prose_words: dict[str, Counter] = {}
            rows: list[tuple] = []
            for k, label, t in zip(pdf["_key"].tolist(), pdf["_lang"].tolist(), pdf["_text"].tolist(), strict=True):
                words, numbers = tokens(t)
                counts = Counter(words)
                prose, of_page = prose_stretches(words)
                held = prose_words.setdefault(label or "", Counter())
                for part in prose:
                    held.update(part)
                codes = np.frombuffer("".join(counts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
                letters = np.bincount(codes % PLACES, minlength=PLACES).astype(np.int32)
                curve = sorted(Counter(counts.values()).items(), reverse=True)
                repeated = [{"w": w, "c": c} for w, c in counts.items() if c > 1]
                rows.append(("page", k, label, letters, len(words), numbers, of_page, [{"f": f, "m": m} for f, m in curve], repeated, None, 0))
            for label, held in prose_words.items():
                rows += [("word", None, label, None, 0, 0, 0.0, None, None, w, c) for w, c in held.items()]
            out = pd.DataFrame(rows, columns=["kind", "_key", "lang", "letters", "n", "numbers", "prose", "curve", "repeated", "word", "count"])
            yield out.astype({"_key": "Int64"}) if kind in ("bigint", "int") else out

    label = F.col(lang) if lang else F.lit(None)
    picked = documents.select(F.col(key).alias("_key"), label.cast("string").alias("_lang"), F.col(text).alias("_text")).where(F.col("_key").isNotNull() & (F.length("_text") > 0))
    return picked.mapInPandas(run, f"kind string, _key {kind}, {_PAGE}, word string, count long")


def language(pages: DataFrame) -> Column:
    """The language of a page: the common label under which its letters are likeliest, '' where no page has a label.

    The letters of all labelled pages are summed by label; the table has at most 1 / COMMON_LABEL rows.
    """
    sums = [F.sum(F.get("letters", F.lit(k))).alias(f"l{k}") for k in range(PLACES)]
    told = pages.where("lang <> ''").groupBy("lang").agg(F.count("*").alias("pages"), *sums).withColumn("share", F.expr("pages / sum(pages) over ()")).where(F.col("share") >= COMMON_LABEL).collect()
    scores = []
    for row in sorted(told, key=lambda r: r["lang"]):
        seen = np.array([row[f"l{k}"] or 0 for k in range(PLACES)], dtype=np.float64) + 0.5
        odds = np.log(seen / seen.sum()).tolist()
        weights = F.array(*map(F.lit, odds))
        scores.append(F.struct(F.aggregate(F.zip_with("letters", weights, lambda n, w: n * w), F.lit(0.0), lambda s, v: s + v).alias("score"), F.lit(row["lang"]).alias("lang")))
    return F.array_max(F.array(*scores))["lang"] if scores else F.lit("")


def rank_frequency(pages: DataFrame) -> DataFrame:
    """(key, slope, residual, top): the weighted least-squares line of ln frequency on ln rank of each page's words.

    Words of equal frequency share a block of ranks; windows number the blocks and the fit weighs each by its words.
    """
    blocks = pages.select("_key", F.explode("curve").alias("b")).select("_key", F.col("b.f").alias("f"), F.col("b.m").alias("m"))
    upto = F.expr("sum(m) over (partition by _key order by f desc rows between unbounded preceding and current row)")
    ranked = blocks.withColumn("last", upto).select("_key", F.col("m").cast("double").alias("w"), F.ln("f").alias("y"), F.ln(F.sqrt((F.col("last") - F.col("m") + 1) * F.col("last").cast("double"))).alias("x"), "f", (F.col("f") * F.col("m")).alias("n"))
    sums = ranked.groupBy("_key").agg(*[F.sum(e).alias(n) for n, e in (("w", F.col("w")), ("wx", F.expr("w*x")), ("wy", F.expr("w*y")), ("wxx", F.expr("w*x*x")), ("wxy", F.expr("w*x*y")), ("wyy", F.expr("w*y*y")), ("n", F.col("n")))], F.max("f").alias("top"))
    spread = F.expr("wxx - wx*wx/w")
    slope = F.when(spread > 1e-9, F.expr("wxy - wx*wy/w") / spread).otherwise(F.lit(0.0))
    fitted = sums.withColumn("slope", slope)
    rest = F.expr("(wyy - wy*wy/w) - slope*(wxy - wx*wy/w)") / F.col("w")
    return fitted.select("_key", "slope", F.sqrt(F.greatest(rest, F.lit(0.0))).alias("residual"), (F.col("top") / F.col("n")).alias("top"))


_CURVE = ("slope", "residual", "top")


def usual_curves(facts: DataFrame) -> DataFrame:
    """(language, size, mean and deviation of each measure) of prose pages by language and length class."""
    prose = facts.where((F.col("n") > 0) & (F.col("prose") >= PROSE_PAGE))
    own = prose.groupBy("language", "size").agg(F.count("*").alias("pages"), *[f(c).alias(f"{n}_{c}") for c in _CURVE for f, n in ((F.avg, "m"), (F.stddev_pop, "s"))])
    kept = F.when(F.col("pages") >= ENOUGH, F.struct(*[f"{n}_{c}" for c in _CURVE for n in "ms"]))
    # Every class from the shortest to the longest: 2**31 words are more than a text can hold.
    every = own.select("language").distinct().select("language", F.explode(F.sequence(F.lit(0), F.lit(31))).alias("size"))
    filled = every.join(own.select("language", "size", kept.alias("kept")), ["language", "size"], "left")
    below = F.expr("last_value(kept) ignore nulls over (partition by language order by size rows between unbounded preceding and current row)")
    above = F.expr("first_value(kept) ignore nulls over (partition by language order by size rows between current row and unbounded following)")
    return filled.select("language", "size", F.coalesce(below, above).alias("u")).select("language", "size", "u.*")


def scored(documents: DataFrame, key: str = "doc_id", text: str = "text", lang: str | None = "lang") -> DataFrame:
    """Each page's measures and the verdict: key, language, n_words, slope, residual, top, z_slope, z_residual, z_top, z,
    divergence, asked, stuffed.

    z_ are the distances of slope, residual and share of the top word from the mean of prose pages of the same language and
    length class, in standard deviations, z the greatest of them (0 where the language has too little prose to hold a page
    against); divergence is the share of the page's words and numbers in diverging words, asked the share that z asks for.
    Null and empty texts are left out, as are null keys; a page of digits alone has no words and is never stuffed. Repeated
    rows count once. lang may be None or a column that is not there. Other columns are not read.
    """
    told = cut(profiles(documents, key, text, lang if lang in documents.columns else None))
    pages = told.where("kind = 'page'")
    pages = cut(pages.withColumn("language", language(pages)).drop("kind", "word", "count", "letters", "lang").dropDuplicates(["_key"]))
    words = told.where("kind = 'word'").groupBy("lang", "word").agg(F.sum("count").alias("c"))
    # Totals by label, summed before the join: a label's words never stand in one task.
    totals = told.where("kind = 'word'").groupBy("lang").agg(F.sum("count").alias("total"))
    share = F.col("c") / F.col("total")
    known = words.join(totals, "lang").select(F.col("lang").alias("language"), "word", share.alias("share")).where(F.col("share") > RARE)
    facts = pages.select("_key", "language", "n", "prose").join(rank_frequency(pages), "_key", "left").withColumn("size", F.floor(F.log2(F.greatest("n", F.lit(1)))).cast("int"))
    facts = cut(facts)
    # 32 length classes of at most 1 / COMMON_LABEL languages.
    held = facts.join(F.broadcast(usual_curves(facts)), ["language", "size"], "left")
    far = {c: F.coalesce(F.abs(F.col(c) - F.col(f"m_{c}")) / F.greatest(F.col(f"s_{c}"), F.lit(0.02)), F.lit(0.0)) for c in _CURVE}
    held = held.withColumns({f"z_{c}": e for c, e in far.items()}).withColumn("z", F.greatest(*[f"z_{c}" for c in _CURVE]))
    own = pages.select("_key", "language", (F.col("n") + F.col("numbers")).alias("all"), F.inline("repeated")).withColumn("p", F.col("c") / F.col("all"))
    # The known words are at most 1 / RARE for each language: a broadcast of bounded size.
    own = own.join(F.broadcast(known), (F.col("w") == F.col("word")) & (own["language"] == known["language"]), "left")
    expected = F.coalesce("share", F.lit(RARE))
    marked = F.col("w").isin(LINK, TAG)
    diverging = (F.col("p") >= TIMES * expected) & (F.col("share").isNull() | (F.col("p") >= HEAVY) | marked)
    mass = own.where(diverging).groupBy("_key").agg(F.sum("p").alias("divergence"))
    out = held.join(mass, "_key", "left").withColumn("divergence", F.coalesce("divergence", F.lit(0.0)))
    asked = MOST - (MOST - LEAST) * F.least(F.col("z") / FAR, F.lit(1.0))
    return out.select(F.col("_key").alias(key), "language", F.col("n").alias("n_words"), *_CURVE, *[f"z_{c}" for c in _CURVE], "z", "divergence", asked.alias("asked"), (F.col("divergence") >= asked).alias("stuffed"))
