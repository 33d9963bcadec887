"""Variant spellings of names typed by people (problem 1).

Every distinct value is parsed into a profile: an anchor (surname, or proper name of an organisation) and two attributes
(given name and patronymic, or sort and legal form), each known in full, by its initial, or not at all. Profiles are merged and
matched again: a profile moves into the one that agrees with all it knows, if all that agree are of one mind; the merged
profile has the spellings and attributes of both and enters blocking anew, until no profile moves.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import count

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barrow.llm import pairing, spelling
from barrow.llm.words import TO_CYRILLIC, TO_LATIN
from barrow.session import cut

#: Given names.
GIVEN = frozenset(
    "александр александра алексей алина алла анастасия анатолий ангелина андрей анна антон антонина арина аркадий арсений артем артур богдан борис вадим валентин валентина валерий валерия варвара василий вера вероника виктор виктория виталий владимир владислав всеволод вячеслав галина геннадий георгий герман глеб григорий данил дарья денис дмитрий евгений евгения егор екатерина елена елизавета ефим жанна зинаида зоя иван игорь илья инна ирина карина кирилл клавдия константин кристина ксения лариса лев леонид лидия любовь людмила майя макар максим маргарита марина мария марк матвей михаил надежда наталия наталья никита николай нина оксана олег олеся ольга павел петр полина раиса ринат роман руслан светлана семен сергей софия софья станислав степан тамара тарас татьяна тимофей тимур федор филипп эдуард элла эльвира эмма юлия юрий яков яна ярослав".split()
)
#: Short and fond forms of given names; an ambiguous one has all its names.
FOND = {
    "александр": "саня шурик сашка", "александр александра": "саша шура", "алексей": "леша алеша леха", "анастасия": "настя настенька", "александра алевтина алина алла": "аля", "анатолий": "толя толик", "андрей": "андрюша дрюша", "анна": "аня анюта нюра анечка", "антон": "антоша тоша", "антонина": "тоня", "борис": "боря", "вадим": "вадик", "валентин валентина": "валя", "валерий": "валера", "валерия": "лера", "варвара": "варя", "василий": "вася", "вера": "верочка верунька", "вероника": "ника", "виктор": "витя", "виктория": "вика", "виталий": "виталик", "владимир": "вова володя", "владислав вячеслав станислав ярослав": "слава", "галина": "галя галочка", "геннадий": "гена", "георгий": "жора гоша", "григорий": "гриша", "дарья": "даша дашенька", "денис": "дениска", "дмитрий": "дима митя", "евгений евгения": "женя", "егор": "егорка", "екатерина": "катя катюша", "елена": "лена леночка", "елизавета": "лиза", "жанна": "жанночка", "зинаида": "зина", "иван": "ваня ванюша", "игорь": "игорек", "илья": "илюша", "ирина": "ира ириша", "кирилл": "кирюша", "константин": "костя", "ксения": "ксюша", "лариса": "лара", "леонид": "леня", "лидия": "лида лидочка", "любовь": "люба", "людмила": "люда мила люся", "максим": "макс", "маргарита": "рита", "марина": "мариша", "мария": "маша маруся", "михаил": "миша", "надежда": "надя наденька", "наталья": "наташа ната", "никита": "никитка", "николай": "коля", "нина": "ниночка", "олег": "олежка", "ольга": "оля оленька", "павел": "паша павлик", "петр": "петя", "полина": "поля полинка", "раиса": "рая", "роман": "рома", "светлана": "света светик", "семен": "сема", "сергей": "сережа серега", "софья": "соня", "станислав": "стас", "степан": "степа", "тамара": "тома", "татьяна": "таня танюша", "тимофей": "тима тимоша", "федор": "федя", "юлия": "юля юленька", "юрий": "юра", "яков": "яша",
}
#: Words that stand with a name but are no part of it.
TITLES = frozenset("эксперт эксперты аттестованный археолог д-р доктор канд кандидат ист исторических истор наук наука проф профессор доц доцент ведущий главный научный сотрудник сотр инженер г-н г-жа гр автор исполнитель руководитель директор зав нач".split())
#: Fillers that name nobody, folded to letters.
FILLERS = frozenset(("", "нетданных", "неуказан", "неуказана", "неуказано", "неизвестен", "неизвестно", "бн", "нет", "отсутствует", "none", "nan", "null", "na", "фио", "прочерк", "безномера", "неопределен"))
#: Legal forms of organisations.
LEGAL = frozenset("ооо ао оао зао пао нпо гау кгау гбу кгбу фгбу фгбун фгуп мбу мау мку кгку ано нко ип гуп муп чоу фгаоу фгбоу".split())
#: Romanisation, longest first.
ROMAN = (("shch", "щ"), ("sch", "щ"), ("kh", "х"), ("zh", "ж"), ("ch", "ч"), ("sh", "ш"), ("ts", "ц"), ("yu", "ю"), ("ya", "я"), ("yo", "е"), ("ye", "е"), ("iu", "ю"), ("ia", "я"), ("a", "а"), ("b", "б"), ("v", "в"), ("g", "г"), ("d", "д"), ("e", "е"), ("z", "з"), ("i", "и"), ("j", "й"), ("k", "к"), ("l", "л"), ("m", "м"), ("n", "н"), ("o", "о"), ("p", "п"), ("r", "р"), ("s", "с"), ("t", "т"), ("u", "у"), ("f", "ф"), ("h", "х"), ("c", "ц"), ("w", "в"), ("x", "кс"), ("q", "к"))

_TO_ROMAN = {letter: roman for roman, letter in reversed(ROMAN) if roman not in ("sch", "ye", "yo", "iu", "ia", "j", "h", "c", "w", "x", "q")} | {"ы": "y", "й": "y", "э": "e", "ь": "", "ъ": "", "х": "kh", "ц": "ts"}

_FULL = {short: names.split() for names, shorts in FOND.items() for short in shorts.split()}
#: Romanised names lack their soft signs.
_HARD = {n.replace("ь", ""): n for n in GIVEN if "ь" in n} | {n: n for n in GIVEN}
_PATRONYMIC = re.compile(r"(?:[оеё]в?[ивы]ч|ьич|мич|[оеё]вна|[оеё]вн|[иы]нична|ична|вич|вна|евич|ович|ивна|авна|авич|ичн|вва|енва|нва)$")
_SLIP = {n[:k] + n[k + 1 :] for n in [*GIVEN, *_FULL] if len(n) > 3 for k in range(len(n))} | GIVEN | set(_FULL)
_LETTERS = re.compile(r"[A-Za-zА-Яа-яЁё]+(?:'[A-Za-z]+)?")
_LATIN, _CYRILLIC = re.compile(r"[A-Za-z]"), re.compile(r"[А-Яа-яЁё]")


def _from_roman(word: str) -> str:
    low, out, k = word.lower().replace("'", ""), "", 0
    while k < len(low):
        for roman, letter in ROMAN:
            if low.startswith(roman, k):
                out += letter
                k += len(roman)
                break
        else:
            out += "й" if low[k] == "y" and out[-1:] in "аеиоуыэюя" and out else "ы" if low[k] == "y" else low[k]
            k += 1
    return out.upper() if word.isupper() and len(word) > 1 else out.capitalize() if word[0].isupper() else out


def cyrillic(text: str) -> str:
    """Latin words by romanisation, Latin look-alikes among Cyrillic by shape (and the reverse first); ё as е.

    A lone Latin letter is a look-alike if most letters of the text are Cyrillic.
    """
    mixed = len(_CYRILLIC.findall(text)) > len(_LATIN.findall(text))

    def word(m: re.Match) -> str:
        w = m.group()
        n = len(_LATIN.findall(w))
        if not n:
            return w
        if n == 1 and len(w) == 1 and mixed or 2 * n <= len(w):
            return w.translate(TO_CYRILLIC)
        return _from_roman(w.translate(TO_LATIN))

    return _LETTERS.sub(word, text).replace("ё", "е").replace("Ё", "Е")


def latin(word: str) -> str:
    """A Cyrillic word romanised, signs dropped."""
    return "".join(_TO_ROMAN.get(c, c) for c in word)


def latin_words(value: str) -> dict[str, str]:
    """The Latin words of a value as typed, by the Cyrillic form they are read as."""
    words = (w for w in _LETTERS.findall(value) if 2 * len(_LATIN.findall(w)) > len(w) > 1)
    typed = (w.translate(TO_LATIN) for w in words)
    return {_from_roman(w).lower().replace("ё", "е"): w.lower().replace("'", "") for w in typed}


def _patronymics() -> frozenset[str]:
    """Patronymics by rule from the given names."""
    out = {"ильич", "ильинична", "никитич", "никитична", "львович", "львовна", "павлович", "павловна", "петрович", "петровна"}
    for n in GIVEN:
        if n.endswith("ий"):
            out |= {n[:-2] + m + e for m in "ьи" for e in ("евич", "евна")}
        elif n.endswith("й"):
            out |= {n[:-1] + "евич", n[:-1] + "евна"}
        elif n.endswith("ь"):
            out |= {n[:-1] + "евич", n[:-1] + "евна"}
        elif n[-1] not in "ая":
            out |= {n + "ович", n + "овна"}
    return frozenset(out)


def anchor(word: str) -> str:
    """A name without what romanisation loses: signs and э."""
    return word.replace("ь", "").replace("ъ", "").replace("э", "е")


def _givenish(word: str) -> bool:
    return word in _HARD or word in _FULL or len(word) > 4 and (word in _SLIP or any(word[:k] + word[k + 1 :] in _SLIP for k in range(len(word))))


_TITLE_SLIPS = {t[:k] + t[k + 1 :] for t in TITLES if len(t) > 5 for k in range(len(t))}


def _mistyped_title(word: str) -> bool:
    return len(word) > 4 and (word in _TITLE_SLIPS or any(word[:k] + word[k + 1 :] in _TITLE_SLIPS | TITLES for k in range(len(word))))


def person(value: str) -> tuple | None:
    """(surname, given in full, its initial, patronymic in full, its initial), or None if it names nobody."""
    if re.sub(r"[^a-zа-яё]", "", value.lower()) in FILLERS:
        return None
    t = cyrillic(value)
    t = re.sub(r"(?<=[а-я])(?=[А-Я]\.)", " ", t).lower()
    t = re.sub(r"\b[кд]\.\s?[а-я]\.\s?н\b\.?|\bд-р\b|\bг-н\b|\bг-жа\b", " ", t)
    tokens = re.findall(r"[а-я]+(?:-[а-я]+)*\.?", t)
    tokens = [w for w in tokens if w.rstrip(".") not in TITLES and not _mistyped_title(w)]
    full = [w for w in tokens if not w.endswith(".") and len(w) > 1]
    # A stop after a long word ends the value and shortens nothing.
    full += [w.rstrip(".") for w in tokens if w.endswith(".") and len(w) > 7]
    short = [w.rstrip(".") for w in tokens if w.rstrip(".") not in full]
    if not full:
        return None
    given = father = None
    if len(full) >= 3:
        a, b, c = full[:3]
        if _givenish(a) and not _givenish(b):
            given, father, last = a, b, c
        else:
            last, given, father = a, b, c
    elif len(full) == 2:
        a, b = full
        if _givenish(a) and not _givenish(b):
            given, last = a, b
        elif not _givenish(b) and _PATRONYMIC.search(b) and not _PATRONYMIC.search(a) and not short:
            last, given = b, a
        else:
            last, given = a, b
    else:
        last = full[0]
    initials = [s[0] for s in short]
    if given is None and initials:
        g, f = initials[0], initials[1] if len(initials) > 1 else None
        return last, None, g, None, f
    names = _FULL.get(given, [_HARD.get(given, given)]) if given else [None]
    g_full = names[0] if len(names) == 1 else None
    g = names[0][0] if names[0] and len({n[0] for n in names}) == 1 else None
    return last, g_full, g, father, father[0] if father else (initials[0] if initials else None)


def _acronym(words: list[str]) -> str:
    return "".join(w[0] for w in words if w not in ("с", "и", "в", "по", "на", "для", "при")).replace("э", "е")


def organization(value: str) -> tuple | None:
    """(proper name, None, letters of the sort, None, legal form), or None if it names none.

    The sort is known by its initial letters (an acronym is taken as it is); a sort cut short with a full stop is unknown.
    """
    if re.sub(r"[^a-zа-яё]", "", value.lower()) in FILLERS:
        return None
    t = re.sub(r"[“”„‟\"]", '"', cyrillic(value))
    t = re.sub(r"\([^)]*\)?", " ", t)
    t = re.sub(r",?\s*\bг\.\s*[А-Яа-я-]+", " ", t)
    t = re.sub(r"\s+им(?:ени|\.)\s+[а-яА-Я ]+?(?=[«\"]|$)", " ", t)
    parts = [p.strip() for p in re.split(r"[«»\"]", t)]
    quoted = bool(re.search(r"[«»\"]", t))
    legal = None
    groups: list[list[str]] = []
    for n, part in enumerate(parts):
        for piece in part.split(","):
            words = re.findall(r"[а-я]+\.?", piece.lower())
            keep = [w for w in words if w.rstrip(".") not in LEGAL]
            if len(keep) < len(words):
                legal = legal or next(w.rstrip(".") for w in words if w.rstrip(".") in LEGAL)
            if keep and n == 0 and quoted and len(keep) > 1 and _acronym(keep) in LEGAL and legal is None:
                legal, keep = _acronym(keep), []
            if keep:
                groups.append(keep)
    if not groups:
        return None
    # The proper name: a quoted word by itself, else the last word of the last quoted or only group.
    proper = None
    rest: list[list[str]] = list(groups)
    if quoted:
        inside = [re.findall(r"[а-я]+\.?", p.lower()) for p in parts[1:]]
        single = [g for g in inside if len(g) == 1 and g[0].rstrip(".") not in LEGAL]
        single = single or [g for g in ([w for w in p if w.rstrip(".") not in LEGAL] for p in inside) if len(g) == 1 and len(g[0]) > 3][:1]
        alone = [g for g in groups if len(g) == 1 and any(g[0] == s[0] for s in single)]
        first = next((g for g in alone if len(g[0].rstrip(".")) > 4), alone[-1] if alone else None)
        if first:
            proper, rest = first[0], [g for g in groups if g is not first]
    if proper is None:
        # The last group of several words (a lone word after it is a town).
        group = next((g for g in reversed(groups) if len(g) > 1), groups[0])
        proper, rest = group[-1], [g[:-1] if g is group else g for g in groups]
    rest = [g for g in rest if g and (len(g) > 1 or len(g[0].rstrip(".")) <= 5 and g is not rest[-1] or g[0].rstrip(".").isalpha() and len(g[0].rstrip(".")) <= 4)]
    sort = None
    if rest:
        words = rest[0]
        if len(words) == 1 and len(words[0].rstrip(".")) <= 5:
            sort = words[0].rstrip(".").replace("э", "е")
        elif not (words[-1].endswith(".") and not any(w.endswith(".") for w in words[:-1])):
            sort = _acronym([w.rstrip(".") for w in words])
    return proper.rstrip("."), None, sort, None, legal


_PROFILE = "anchor string, roman string, typed boolean, a_full string, a_key string, b_full string, b_key string"


def parsed(values: DataFrame) -> DataFrame:
    """values(kind, name, n) with the profile of each name; names that name nobody are dropped."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for kind, name, n in pdf[["kind", "name", "n"]].itertuples(index=False):
                found = person(name) if kind == "person" else organization(name)
                if found:
                    typed = latin_words(name).get(found[0])
                    rows.append((kind, name, n, anchor(found[0]), typed or latin(found[0]), typed is not None, *found[1:]))
            yield pd.DataFrame(rows, columns=["kind", "name", "n", "anchor", "roman", "typed", "a_full", "a_key", "b_full", "b_key"])

    return values.mapInPandas(run, f"kind string, name string, n long, {_PROFILE}")


#: A rarer spelling one slip from a profile's moves into it if the profile is this many times as frequent; less is needed
#: where both attributes are known and agree, none where both agree in full.
RATIO_ALONE, RATIO_KNOWN = 4.0, 1.5
#: A spelling of a given name or patronymic is read as one that stands in this many times as many values.
RATIO_READ = 2.0
#: A given name or patronymic is taken in full if it has at least this share of all those typed in full.
COMMON = 3e-4


def _specific(full: str, key: str) -> list[Column]:
    """The keys under which a target can be met: by the full attribute, by its initial, and without it."""
    return [F.when(F.col(full).isNotNull(), F.concat(F.lit("="), F.col(full))), F.when(F.col(key).isNotNull(), F.concat(F.lit("~"), F.col(key))), F.lit("*")]


def _own(full: str, key: str) -> Column:
    return F.coalesce(*_specific(full, key))


def resolved(values: DataFrame) -> DataFrame:
    """(kind, name, entity) of values(kind, name, n): names with equal entity name the same person or organisation.

    n is how often a name stands in the data; kinds are resolved apart; a name stands in one row. Names that are null,
    empty or fillers are left out. Entities are numbers without meaning.

    Each round is two equi-joins on distinct spellings and profiles: no group is expanded into pairs. What agrees with a
    profile is summarised per key (whether all are of one mind, and the weightiest), so a surname shared by any number of
    people is one row per key.
    """
    told = cut(parsed(values.where("name is not null")))
    # A spelling counts once however many rows copy it; a name of the lexicon is read as it stands. A name that stays rare
    # may be a spelling beyond one slip: its initial is all that is taken from it. Both attributes go through one join.
    slots = F.array(F.struct(F.lit("a").alias("slot"), F.col("a_full").alias("name")), F.struct(F.lit("b").alias("slot"), F.col("b_full").alias("name")))
    counts = told.select(F.inline(slots)).where("name is not null").groupBy("slot", "name").agg(F.count("*").alias("n"))
    sure = F.col("name").isin(*sorted(GIVEN | _patronymics()))
    other = F.when(F.col("reading") != F.col("name"), F.col("reading"))
    read = spelling.readings(counts, ["slot"], RATIO_READ).groupBy("slot", "name").agg(F.collect_set(other).alias("others")).join(counts, ["slot", "name"])
    # A slip from several names is read as none of them; its initial counts if it is theirs as well.
    initials = F.array_distinct(F.transform("others", lambda o: F.substring(o, 1, 1)))
    reading = F.when(sure | (F.size("others") == 0), F.col("name")).when(F.size("others") == 1, F.element_at("others", 1))
    key = F.when(reading.isNotNull(), F.substring(reading, 1, 1)).when(F.size(initials) == 1, F.element_at(initials, 1))
    read = read.select("slot", "name", "n", reading.alias("reading"), key.alias("_key"))
    total, own = F.sum("n").over(Window.partitionBy("slot")), F.sum("n").over(Window.partitionBy("slot", "reading"))
    kept = F.when(own >= F.greatest(F.lit(2.0), COMMON * total), F.col("reading"))
    read = cut(read.select("slot", "name", "_key", kept.alias("_kept")))
    for slot in "ab":
        known = read.where(F.col("slot") == slot).select(F.col("name").alias(f"{slot}_full"), "_key", "_kept")
        given = F.col(f"{slot}_full").isNotNull()
        told = told.join(known, f"{slot}_full", "left").withColumns({f"{slot}_key": F.when(given, F.col("_key")).otherwise(F.col(f"{slot}_key")), f"{slot}_full": F.col("_kept")}).drop("_key", "_kept")
    same = ["kind", "anchor", "a_full", "a_key", "b_full", "b_key"]
    told = cut(told.withColumn("first", F.xxhash64("kind", *[F.coalesce(F.col(c), F.lit("?")) for c in same[1:]])))
    profiles = told.groupBy("first", *same).agg(F.sum("n").alias("n")).select(F.col("first").alias("id"), "kind", F.array("anchor").alias("anchors"), *same[2:], "n")
    links = told.select("kind", "name", F.col("first").alias("entity"))
    anchors = told.groupBy("kind", F.col("anchor").alias("name")).agg(F.sum("n").alias("n"))
    close = spelling.near(anchors, ["kind"], 0.0).select("kind", F.col("name").alias("anchor"), F.col("reading").alias("other"))
    # A slip of the Latin spelling (ch as hc) can be several of the Cyrillic one: names typed in Latin are compared in it too.
    romans = told.groupBy("kind", "anchor", "roman").agg(F.max("typed").alias("typed"))
    romans = romans.select("*", F.explode(spelling.slips(F.col("roman"))).alias("slip"))
    x, y = romans.where("typed").alias("x"), romans.alias("y")
    pairs = x.join(y, (F.col("x.kind") == F.col("y.kind")) & (F.col("x.slip") == F.col("y.slip")) & (F.col("x.anchor") != F.col("y.anchor"))).where(spelling.one_slip(F.col("x.roman"), F.col("y.roman")) | (F.col("x.roman") == F.col("y.roman")))
    pairs = pairs.select(F.col("x.kind").alias("kind"), F.col("x.anchor").alias("anchor"), F.col("y.anchor").alias("other"))
    close = cut(close.unionByName(pairs).unionByName(pairs.select("kind", F.col("other").alias("anchor"), F.col("anchor").alias("other"))).distinct())
    profiles = cut(profiles)
    # Each round but the first takes away a profile or is the last, so it ends; a chain of k profiles takes some k rounds.
    for turn in count():
        moves = cut(_moves(profiles, close, exact_only=turn == 0))
        if moves.isEmpty():
            if turn == 0:
                continue
            break
        links = cut(links.join(moves, F.col("entity") == F.col("source"), "left").select("kind", "name", F.coalesce("target", "entity").alias("entity")))
        joined = profiles.join(moves, F.col("id") == F.col("source"), "left").withColumn("id", F.coalesce("target", "id"))
        profiles = cut(joined.groupBy("id", "kind").agg(F.array_distinct(F.flatten(F.collect_set("anchors"))).alias("anchors"), *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("n"))).alias(c) for c in same[2:]], F.sum("n").alias("n")))
    return links


def _moves(profiles: DataFrame, close: DataFrame, exact_only: bool) -> DataFrame:
    """(source, target): profiles that merge into another in this round; no target is a source."""
    weight = F.struct((F.col("a_full").isNotNull().cast("int") + F.col("b_full").isNotNull().cast("int") + F.col("a_key").isNotNull().cast("int") + F.col("b_key").isNotNull().cast("int")).alias("known"), F.col("n"), F.col("id"))
    mine = profiles.withColumn("weight", weight).withColumn("anchor", F.explode("anchors"))
    met = mine.select("kind", "anchor", "weight", "a_full", "a_key", "b_full", "b_key", F.explode(F.array_distinct(F.array_compact(F.array(*_specific("a_full", "a_key"))))).alias("a"))
    met = met.select("*", F.explode(F.array_distinct(F.array_compact(F.array(*_specific("b_full", "b_key"))))).alias("b"))
    spread = [f(c).alias(f"{n}_{c}") for c in ("a_full", "a_key", "b_full", "b_key") for f, n in ((F.min, "lo"), (F.max, "hi"))]
    summary = met.groupBy("kind", "anchor", "a", "b").agg(F.max("weight").alias("top"), F.max(F.struct("weight", "a_full", "b_full", "a_key", "b_key")).alias("best"), *spread)
    one_mind = [F.col(f"lo_{c}").isNull() | (F.col(f"lo_{c}") == F.col(f"hi_{c}")) for c in ("a_full", "a_key", "b_full", "b_key")]
    agreed = one_mind[0]
    for e in one_mind[1:]:
        agreed = agreed & e
    summary = summary.select("kind", "anchor", "a", "b", "top", agreed.alias("agreed"))
    asking = mine.select("id", "kind", "weight", "anchor", _own("a_full", "a_key").alias("a"), _own("b_full", "b_key").alias("b"), F.lit(True).alias("exact"))
    if not exact_only:
        asking = asking.unionByName(asking.join(close, ["kind", "anchor"]).withColumn("anchor", F.col("other")).withColumn("exact", F.lit(False)).drop("other"))
    answers = asking.join(summary, ["kind", "anchor", "a", "b"])
    known = (F.col("a") != "*").cast("int") + (F.col("b") != "*").cast("int")
    in_full = F.col("a").startswith("=") & F.col("b").startswith("=")
    ratio = F.when(in_full, 0.0).when(known == 2, RATIO_KNOWN).otherwise(RATIO_ALONE)
    allowed = F.col("agreed") & (F.col("top.id") != F.col("id")) & (F.col("top") > F.col("weight")) & (F.col("exact") | (F.col("top.n") >= ratio * F.col("weight.n")))
    # An exact spelling that meets people of several minds forbids a move by a similar one.
    torn = F.max(F.col("exact") & ~F.col("agreed"))
    chosen = answers.groupBy("id").agg(torn.alias("torn"), F.max(F.when(allowed, F.struct("exact", "top"))).alias("pick")).where("pick is not null and (pick.exact or not torn)")
    wanted = chosen.select(F.col("id").alias("source"), F.col("pick.top.id").alias("target"))
    # A profile that is asked for stays this round unless it asks for nobody: targets must not move.
    return wanted.join(wanted.select(F.col("source").alias("target")), "target", "left_anti").select("source", "target")


def same_names(values: DataFrame) -> DataFrame:
    """Pairs of different stored values that name the same person or organisation: (kind, name_a, name_b), name_a < name_b.

    values(kind, name), repeated values allowed: they are counted before anything is shuffled. The pairs of one entity are
    those of its distinct spellings, not of its rows, made in salted blocks.
    """
    counted = values.where("name is not null").groupBy("kind", "name").agg(F.count("*").alias("n"))
    links = cut(resolved(counted))
    return pairing.paired(links, ["kind", "entity"], "name").select("kind", F.col("a").alias("name_a"), F.col("b").alias("name_b"))
