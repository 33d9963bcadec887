"""Same postal address written differently (problem 2).

Each address is parsed into components and expanded into all its plausible normalised forms: misspelt names take every
more frequent name one slip away, a missing district every district that has the settlement, an ambiguous street type
every type it may stand for. Combinations of the components of each form are hashed, exploded, and records that share any
hash are candidates; candidates whose house letters or blocks conflict are rejected.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barrow.llm import pairing, spelling
from barrow.llm.words import TO_CYRILLIC
from barrow.session import cut

#: Types of settlements and streets as written, by their code.
SETTLEMENTS = {"г": "г гор город", "п": "п пос поселок пгт", "с": "с село", "д": "д дер деревня", "х": "х хут хутор"}
STREETS = {"ул": "ул улица", "пер": "пер переулок", "пр-т": "пр-т пр-кт просп проспект", "пр-д": "пр-д проезд", "пр": "пр"}
#: Directions in words (nominative stem) and letters, as degrees from north.
DIRECTIONS = {"северо-восто": 45, "юго-восто": 135, "юго-запад": 225, "северо-запад": 315, "север": 0, "восто": 90, "юг": 180, "юж": 180, "запад": 270, "св": 45, "юв": 135, "юз": 225, "сз": 315, "с": 0, "в": 90, "ю": 180, "з": 270}
#: Prefixes of settlement names and their short forms.
PREFIXES = {"усть": "усть", "у": "усть", "верх": "верх", "в": "верх", "верхн": "верх", "нов": "ново", "ново": "ново", "н": "ново"}

_SETTLEMENT = {w: k for k, ws in SETTLEMENTS.items() for w in ws.split()}
_STREET = {w: k for k, ws in STREETS.items() for w in ws.split()}

_POST = re.compile(r"(?<!\d)\d{6}(?!\d)")
_REGION = re.compile(r"\b(?:край|область|обл\.?)\s+[а-я-]+(?:ий|ая)\b|\b[а-я-]+(?:ий|ая|йи|и)\s+(?:край|кр\.?|область|обл\.?)(?![а-я])")
_UNIT = r"(?:муниципальный\s+район|муниципальный\s+округ|муниц\.?\s*район|муниц\.?\s*округ|м\.?\s*р-?н|м\.?\s*о\.?|район|р-?о?н)"
_DISTRICT_AFTER = re.compile(rf"\b([а-я-]{{4,}})\s+{_UNIT}(?![а-я])\.?")
_DISTRICT_BEFORE = re.compile(r"\bрайон\s+([а-я-]{4,}?)(?=[\s,;.()]|$)")
_DISTRICT_THEN_REGION = re.compile(r"\bрайон\s+([а-я-]{4,})\s+край\s+[а-я-]+(?:ий|ая|йи)\b")
_RIVER = re.compile(r"(?:\b(?:на|у|по)\s+)?(?:\b(?:правый|левый|прав\.?|лев\.?|пр\.?|л\.?)\s*(?:берег|бер\.?)\s*)?(?:\bр\.|\bреки?\b|\bрека\b)\s*[а-я-]+")
_DIRECTION = "|".join(sorted((re.escape(d) + ("[а-я]*" if len(d) > 2 or d in ("юг", "юж") else "") for d in DIRECTIONS), key=len, reverse=True))
_SPOT = re.compile(rf"(?:\bв\s+)?[~≈]?\s*(\d+(?:[.,]\d+)?)\s*(км|м)\.?(?![а-я])\s*(?:на\s+|к\s+)?({_DIRECTION})(?![а-я-])")
_FROM = re.compile(r"\bот(?:\s+окраины)?\b|\bокраин[аы]\b")
_HOUSE = re.compile(r"(?:\b(?:дом|д)\b\.?\s*)?(?<![\d-])(\d{1,4})\s*(?:«\s*([а-я])\s*»|\"\s*([а-я])\s*\"|-?([а-я])(?![а-я.-])(?!\s*\d))?(?:\s*/\s*(\d{1,3}))?(?:\s*,?\s*\(?\b(?:корпус|корп|к|стр|строение)\b\.?\s*(\d{1,3}))?")
_WORD = re.compile(r"[а-я]+(?:-[а-я]+)*|\d+[а-я]?")
_STREET_NAME = re.compile("[а-я]{3,}(?:ая|яя)")
_TOKEN = re.compile(r"[а-я]+\.?-[а-я-]+|[а-я]+|[,;()]")


def normal(text: str) -> str:
    """Lower case, ё as е, look-alike letters in Cyrillic, one kind of dash and quote, single spaces."""
    text = re.sub(r"[A-Za-z]+", lambda m: m.group().translate(TO_CYRILLIC), text).lower().replace("ё", "е")
    text = re.sub("[‐-―−]", "-", text).replace(" ", " ")
    text = re.sub("[\"“”„'‘’`]", '"', text)
    return re.sub(r"\s+", " ", text).strip()


def _adjective(word: str) -> bool:
    return word[-1:] in "йяе" and len(word) > 3


def parse(text: str | None) -> dict | None:
    """Components of an address, or None if it names neither a building nor a spot.

    kind 'building' has street_type, street, house, letter, block; kind 'spot' has metres and degrees; both have
    settlement and, where given, settlement_type, district and post.
    """
    if not text:
        return None
    t = normal(text)
    out: dict = {"district": None, "settlement": None, "settlement_type": None, "street": None, "street_type": None, "house": None, "letter": None, "block": None, "metres": None, "degrees": None, "post": None}
    if m := _POST.search(t):
        out["post"] = m.group()
        t = _POST.sub(" ", t, count=1)
    if m := _DISTRICT_THEN_REGION.search(t):
        out["district"] = m.group(1)
        t = t[: m.start()] + " , " + t[m.end() :]
    t = _REGION.sub(" , ", t)
    if out["district"]:
        pass
    elif m := _DISTRICT_AFTER.search(t):
        out["district"] = m.group(1)
        t = t[: m.start()] + " , " + t[m.end() :]
    elif m := _DISTRICT_BEFORE.search(t):
        out["district"] = m.group(1)
        t = t[: m.start()] + " , " + t[m.end() :]
    t = _RIVER.sub(" , ", t)
    if m := _SPOT.search(t):
        out["metres"] = round(float(m.group(1).replace(",", ".")) * (1000 if m.group(2) == "км" else 1))
        name = m.group(3)
        out["degrees"] = next(v for d, v in DIRECTIONS.items() if name == d or (len(d) > 2 or d in ("юг", "юж")) and name.startswith(d))
        t = t[: m.start()] + " , " + t[m.end() :]
        t = _FROM.sub(" ", t)
        out["kind"] = "spot"
    else:
        m = None
        for m in _HOUSE.finditer(t):
            break
        if not m:
            return None
        out["house"], out["letter"], out["block"] = m.group(1).lstrip("0") or "0", m.group(2) or m.group(3) or m.group(4), m.group(5) or m.group(6)
        t = t[: m.start()] + " , " + t[m.end() :]
        out["kind"] = "building"
    tokens = _TOKEN.findall(t)
    used = [tok in ",;()" for tok in tokens]
    if out["kind"] == "building":
        for i, tok in enumerate(tokens):
            if tok in _STREET and not used[i]:
                after = i + 1 < len(tokens) and not used[i + 1] and tokens[i + 1]
                before = i > 0 and not used[i - 1] and tokens[i - 1]
                if after and (_adjective(after) or not before or not _adjective(before)):
                    pick = i + 1
                elif before:
                    pick = i - 1
                else:
                    continue
                out["street_type"], out["street"] = _STREET[tok], tokens[pick]
                used[i] = used[pick] = True
                break
        if not out["street"]:
            # A street named without its type: an adjective by itself between commas, beside a settlement named with its own.
            named = any(tok in _SETTLEMENT for tok in tokens)
            alone = [i for i, tok in enumerate(tokens) if _STREET_NAME.fullmatch(tok) and (i == 0 or used[i - 1]) and (i + 1 == len(tokens) or used[i + 1])]
            if not named or len(alone) != 1:
                return None
            out["street"] = tokens[alone[0]]
            used[alone[0]] = True
    for i, tok in enumerate(tokens):
        if used[i]:
            continue
        nxt = tokens[i + 1] if i + 1 < len(tokens) and not used[i + 1] else None
        if tok in _SETTLEMENT and nxt and (len(nxt) > 3 or nxt in PREFIXES):
            out["settlement_type"] = _SETTLEMENT[tok]
            out["settlement"] = _place(tokens, used, i + 1)
            break
    if not out["settlement"]:
        for i, tok in enumerate(tokens):
            if not used[i] and (len(tok) > 3 and tok not in _SETTLEMENT and tok not in _STREET):
                out["settlement"] = _place(tokens, used, i)
                break
    return out if out["settlement"] else None


def _place(tokens: list[str], used: list[bool], i: int) -> str:
    """Settlement name from token i on, prefixes in full and joined by a hyphen."""
    name = tokens[i].replace(".", "")
    used[i] = True
    head, _, tail = name.partition("-")
    if tail:
        return f"{PREFIXES.get(head, head)}-{tail}"
    if head in PREFIXES and i + 1 < len(tokens) and not used[i + 1]:
        used[i + 1] = True
        return f"{PREFIXES[head]}-{tokens[i + 1].replace('.', '').lstrip('-')}"
    return name


_FIELDS = ("kind", "post", "district", "settlement", "settlement_type", "street", "street_type", "house", "letter", "block", "metres", "degrees")
_SCHEMA = "rec string, raw string, kind string, post string, district string, settlement string, settlement_type string, street string, street_type string, house string, letter string, block string, metres int, degrees int"

#: A settlement within one district is a plausible reading of another one slip away at this ratio of frequencies.
RATIO_WITHIN = 1.5
#: A district is a misspelling of another within so many edits that is this many times as frequent; it has no settlements.
EDITS, RATIO_DISTRICT = 2, 20.0


def components(records: DataFrame) -> DataFrame:
    """records(rec, text), one row for each; rows that denote no location are dropped.

    A text that is no address to the parser but has a number in it stands for itself (raw), so equal texts still agree.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for rec, text in zip(pdf["rec"].tolist(), pdf["text"].tolist(), strict=True):
                found = parse(text)
                if found:
                    rows.append((rec, None, *[found[f] for f in _FIELDS]))
                elif text and re.search(r"\d", _POST.sub("", text)):
                    rows.append((rec, normal(text), *[None] * len(_FIELDS)))
            out = pd.DataFrame(rows, columns=["rec", "raw", *_FIELDS])
            yield out.astype({"metres": "Int32", "degrees": "Int32"})

    return records.select("rec", "text").mapInPandas(run, _SCHEMA)


def forms(parsed: DataFrame) -> DataFrame:
    """(rec, form, letter, block): hashes of the component combinations of every plausible form of each record's address."""
    places = parsed.where("raw is null")
    streets = places.where("street is not null").groupBy(F.col("street").alias("name")).agg(F.count("*").alias("n"))
    districts = places.where("district is not null").groupBy(F.col("district").alias("name")).agg(F.count("*").alias("n"))
    street_of = spelling.best(streets).withColumnsRenamed({"name": "street", "reading": "street_read"})
    district_of = spelling.best(districts).withColumnsRenamed({"name": "district", "reading": "district_read"})
    # Names of streets and districts are few and common: their best reading replaces them. A settlement keeps its own
    # spelling beside every reading, within its district, where small places live beside large ones.
    read = cut(places.join(street_of, "street", "left").join(district_of, "district", "left").withColumns({"street": F.coalesce("street_read", "street"), "district": F.coalesce("district_read", "district")}).drop("street_read", "district_read"))
    settled = read.where("district is not null").groupBy("district", F.col("settlement").alias("name")).agg(F.count("*").alias("n"))
    within = spelling.readings(settled, ["district"], RATIO_WITHIN).withColumnsRenamed({"name": "settlement", "reading": "settlement_read"})
    known = read.where("district is not null").join(within, ["district", "settlement"])
    anywhere = read.groupBy(F.col("settlement").alias("name")).agg(F.count("*").alias("n"))
    lost = read.where("district is null").drop("district").join(spelling.readings(anywhere, []).withColumnsRenamed({"name": "settlement", "reading": "settlement_read"}), "settlement")
    # Districts that have a settlement of that name and, where both state one, of that type.
    has = read.where("district is not null").groupBy("settlement", "district").agg(F.collect_set("settlement_type").alias("types"))
    spelt = cut(read.where("district is not null").groupBy("district").agg(F.count("*").alias("n")))
    x, y = spelt.alias("x"), spelt.alias("y")  # districts are few
    wrong = x.join(y, (F.col("y.n") >= RATIO_DISTRICT * F.col("x.n")) & (F.levenshtein("x.district", "y.district") <= EDITS)).select("x.district").distinct()
    has = has.join(wrong, "district", "left_anti")
    has = has.select(F.col("settlement").alias("settlement_read"), F.col("district").alias("d"), "types")
    found = lost.join(has, "settlement_read", "left").where(F.col("d").isNull() | F.col("settlement_type").isNull() | (F.size("types") == 0) | F.array_contains("types", F.col("settlement_type")))
    found = found.withColumnRenamed("d", "district").drop("types")
    both = known.unionByName(found.select(known.columns))
    types = F.when(F.col("street_type") == "пр", F.array(F.lit("пр-т"), F.lit("пр-д"))).when(F.col("street_type").isNull() & F.col("street").isNotNull(), F.array(*[F.lit(t) for t in STREETS if t != "пр"])).otherwise(F.array("street_type"))
    # A street has one name, whatever the gender of its type: the ending goes once the spelling is settled.
    opened = both.withColumn("street_type", F.explode(types)).withColumn("street", F.regexp_replace("street", "(?<=..)(?:ий|ый|ой|ая|яя|ое|ее)$", ""))
    # Each form counts by its components together: with the district, and with the post code where there is one.
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("-"))
    place = [part(c) for c in ("kind", "settlement_read", "street_type", "street", "house", "metres", "degrees")]
    combinations = F.array_compact(F.array(F.xxhash64(F.lit("district"), part("district"), *place), F.when(F.col("post").isNotNull(), F.xxhash64(F.lit("post"), F.col("post"), *place))))
    hashed = opened.select("rec", F.explode(combinations).alias("form"), "letter", "block")
    itself = parsed.where("raw is not null").select("rec", F.xxhash64("raw", F.lit(2)).alias("form"), F.lit(None).cast("string").alias("letter"), F.lit(None).cast("string").alias("block"))
    return hashed.unionByName(itself).distinct()


def same_places(records: DataFrame) -> DataFrame:
    """Pairs of records that denote the same building or spot: (rec_a, rec_b), rec_a < rec_b, no row twice.

    records(rec string, text string); repeated rows count once; null, empty and unspecific texts denote no location. Two
    records agree if they share a form and neither letter nor block of the house differs (none is not the same as one).
    Other columns are not read.

    A location's records are paired in salted blocks, and a pair that shares several forms is given at the least of them.
    """
    parsed = cut(components(records.select("rec", "text").where("rec is not null and text is not null").distinct()))
    places = F.sort_array(F.collect_set(F.xxhash64("form", F.coalesce("letter", F.lit("")), F.coalesce("block", F.lit("")))))
    keyed = cut(forms(parsed).groupBy("rec").agg(places.alias("places")).select("rec", "places", F.explode("places").alias("place")))
    return pairing.paired(keyed, ["place"], "rec", "places").select(F.col("a").alias("rec_a"), F.col("b").alias("rec_b"))
