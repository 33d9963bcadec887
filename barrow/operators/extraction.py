"""Structure out of page text and cell grids (STR-05, 10, 11, 14, 17, 18, GEO-07, 08, 10, 11, 15, 19)."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Headings of an expert act in their order, as patterns.
ACT_SECTIONS = (
    ("start_date", r"дата начала"), ("end_date", r"дата окончания"), ("place", r"место проведения"), ("customer", r"заказчик экспертизы"), ("expert", r"сведения об эксперте"),
    ("relation", r"отношени[яе] к заказчику"), ("aim", r"цель экспертизы"), ("object", r"объект экспертизы"), ("documents", r"перечень документов, представленных"), ("research", r"сведения о проведенных исследованиях"),
    ("facts", r"факты и сведения, выявленные"), ("literature", r"перечень[а-я ,]*литературы"), ("conclusion", r"вывод(?:ы)? экспертизы"), ("appendices", r"перечень приложений"),
)


def sections(pages: DataFrame, doc: str = "doc_id", page: str = "page_no", text: str = "text", headings=ACT_SECTIONS) -> DataFrame:
    """STR-11, AGG-09: (doc, section, body) of documents given as pages: the text from each heading to the next found.

    Headings are looked for in their order over the joined pages; one that is missing is skipped, and a heading counts at
    a line's start, a number before it allowed; it goes up to its colon, if it has one. Documents without any heading have no sections.
    """
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(page, text))), lambda p: p[text]), "\n")
    joined = pages.groupBy(doc).agg(whole.alias("_whole"))
    compiled = [(name, re.compile(rf"^[\d. ]*{pattern}(?:[^\n:]{{0,60}}:)?", re.I | re.M)) for name, pattern in headings]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for key, body in zip(pdf[doc], pdf["_whole"], strict=True):
                found, at = [], 0
                for name, pattern in compiled:
                    m = pattern.search(body.replace("ё", "е"), at)
                    if m:
                        found.append((name, m.start(), m.end()))
                        at = m.end()
                for k, (name, _, end) in enumerate(found):
                    stop = found[k + 1][1] if k + 1 < len(found) else len(body)
                    rows.append((key, k, name, body[end:stop].strip(" :\n")))
            yield pd.DataFrame(rows, columns=[doc, "pos", "section", "body"])

    return joined.mapInPandas(run, f"{doc} {dict(pages.dtypes)[doc]}, pos int, section string, body string")


def contents(text: str | None) -> list[tuple[str, int]]:
    """STR-18: (title, page) of the lines of a table of contents: a title, leaders, a page number."""
    return [(m[1].strip(), int(m[2])) for m in re.finditer(r"^(.*?\w.*?)[ .…_]{3,}(\d{1,4})\s*$", text or "", re.M)]


def split_recursive(text: str, size: int = 750, overlap: int = 100, separators: tuple[str, ...] = ("\n\n", "\n", " ", "")) -> list[tuple[int, str]]:
    """STR-05: (start, chunk) of at most `size` characters: cut at the coarsest separator that does, neighbours joined up to the size.

    A chunk repeats whole parts of the one before up to `overlap` characters. Chunks are stripped, empty ones dropped.
    """
    parts: list[tuple[int, int]] = []

    def cut(a: int, b: int, seps: tuple[str, ...]) -> None:
        if b - a <= size or not seps:
            parts.append((a, b))
            return
        sep = next((s for s in seps if s == "" or text.find(s, a, b) >= 0), "")
        rest = seps[seps.index(sep) + 1 :]
        if sep == "":
            parts.extend((k, min(k + 1, b)) for k in range(a, b))
            return
        at = a
        while at < b:
            nxt = text.find(sep, at + 1, b)
            end = b if nxt < 0 else nxt
            cut(at, end, rest) if end - at > size else parts.append((at, end))
            at = end

    cut(0, len(text), separators)
    out: list[tuple[int, str]] = []
    window: list[tuple[int, int]] = []

    def emit() -> None:
        if window:
            a, b = window[0][0], window[-1][1]
            body = text[a:b]
            lead = len(body) - len(body.lstrip())
            if body.strip():
                out.append((a + lead, body.strip()))

    for a, b in parts:
        if window and b - window[0][0] > size:
            emit()
            while window and (window[-1][1] - window[0][0] > overlap or b - window[0][0] > size):
                window.pop(0)
        window.append((a, b))
    emit()
    return out


def chunks(df: DataFrame, key: str, text: str, size: int = 750, overlap: int = 100) -> DataFrame:
    """STR-05 over a column: (key, chunk_no, start_index, chunk); null and empty texts have none."""

    @F.pandas_udf("array<struct<start:int,chunk:string>>")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"start": a, "chunk": c} for a, c in split_recursive(t, size, overlap)] if t else [])

    return df.select(F.col(key), F.posexplode(cut(F.col(text))).alias("chunk_no", "c")).select(key, "chunk_no", F.col("c.start").alias("start_index"), "c.chunk")


def is_coordinate_table(cells: Column) -> Column:
    """GEO-07: whether a grid array<array<string>> holds coordinates: headed by latitude and longitude or X and Y, or with degrees in its cells."""
    flat = F.transform(F.flatten(cells), lambda c: F.lower(F.trim(F.coalesce(c, F.lit("")))))
    has = lambda p: F.exists(flat, lambda c: c.rlike(p))
    return (has("широта") & has("долгота")) | (has("^x|^х") & has("^y|^у")) | has(r"\d+°")


def columns_of_points(cells: list[list[str]]) -> tuple[int, int, int, int] | None:
    """GEO-11: (name, latitude and longitude columns, first data row) of a grid, by heading words, else by how values begin."""
    for r, row in enumerate(cells[:3]):
        low = [(c or "").lower() for c in row]
        lat = next((k for k, c in enumerate(low) if "широт" in c), None)
        lon = next((k for k, c in enumerate(low) if "долгот" in c), None)
        if lat is not None and lon is not None:
            return next((k for k in range(len(row)) if k not in (lat, lon)), 0), lat, lon, r + 1
    for r, row in enumerate(cells[:3]):
        lat = next((k for k, c in enumerate(row) if re.match(r"\s*5\d\D", c or "")), None)
        lon = next((k for k, c in enumerate(row) if re.match(r"\s*9\d\D", c or "")), None)
        if lat is not None and lon is not None:
            return 0, lat, lon, r
    return None


def decimal_degrees(text: str | None) -> float | None:
    """GEO-02: signed decimal degrees of a coordinate in degrees, minutes and seconds, or in decimals; ten places."""
    t = (text or "").strip().replace(",", ".")
    m = re.search(r"(\d+(?:\.\d+)?)\s*°\s*(\d+(?:\.\d+)?)\s*['′’]\s*(\d+(?:\.\d+)?)", t)
    if m:
        value = float(m[1]) + float(m[2]) / 60 + float(m[3]) / 3600
    else:
        m = re.fullmatch(r"[NSEWСЮВЗ\s]*(-?\d+(?:\.\d+)?)[NSEWСЮВЗ\s]*", t, re.I)
        if not m:
            return None
        value = float(m[1])
    return round(-value if re.search("[SWЮЗ]", t, re.I) else value, 10)


def grid_points(tables: DataFrame, key: str) -> DataFrame:
    """GEO-08: (key, pos, point_name, lat, lon) of coordinate grids: tables(key, cells array<array<string>>)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for k, cells in zip(pdf[key], pdf["cells"], strict=True):
                grid = [list(r) for r in cells]
                found = columns_of_points(grid)
                if not found:
                    continue
                name, lat, lon, first = found
                for pos, row in enumerate(grid[first:]):
                    a, b = (decimal_degrees(row[c]) if c < len(row) else None for c in (lat, lon))
                    if a is not None and b is not None:
                        rows.append((k, pos, row[name], a, b))
            yield pd.DataFrame(rows, columns=[key, "pos", "point_name", "lat", "lon"])

    return tables.mapInPandas(run, f"{key} {dict(tables.dtypes)[key]}, pos int, point_name string, lat double, lon double")


def typed_points(text: Column) -> Column:
    """GEO-15: 'name; x; y' lines of an edit form as array<struct<name,x,y>>, decimal commas allowed; other lines are dropped."""
    parts = F.transform(F.split(text, r"\r?\n"), lambda ln: F.split(ln, ";"))
    number = lambda c: F.replace(F.trim(c), F.lit(","), F.lit(".")).try_cast("double")
    rows = F.transform(F.filter(parts, lambda p: F.size(p) == 3), lambda p: F.struct(F.trim(p[0]).alias("name"), number(p[1]).alias("x"), number(p[2]).alias("y")))
    return F.filter(rows, lambda r: r["x"].isNotNull() & r["y"].isNotNull())


def period_end(text: Column) -> Column:
    """STR-10: end of an act's period: the second dotted date, else the second in words (as dd.mm.yyyy), else the only one; null if none."""
    from barrow.functions.text import date_to_dots

    dotted = F.regexp_extract_all(text, F.lit(r"(\d{2}\.\d{2}\.\d{4})"), F.lit(1))
    worded = F.transform(F.regexp_extract_all(text, F.lit(r"(?iu)(«?\d{1,2}»?\s+[а-яё]+\s+\d{4})"), F.lit(1)), date_to_dots)
    return F.coalesce(F.try_element_at(dotted, F.lit(2)), F.try_element_at(worded, F.lit(2)), F.try_element_at(dotted, F.lit(1)), F.try_element_at(worded, F.lit(1)))


def title_parts(name: Column) -> dict[str, Column]:
    """STR-17: kind of work, object and year of a report's title 'Отчёт о разведке у стоянки X, 2016'; '' where missing."""
    return {
        "work": F.regexp_extract(name, r"(?iu)отч[её]т\s+об?\s+(\p{L}+)", 1),
        "object": F.trim(F.regexp_extract(name, r"(?iu)\s(?:у|на|в)\s+(.+?)(?:,\s*\d{4})?\s*$", 1)),
        "title_year": F.regexp_extract(name, r"(\d{4})\D*$", 1),
    }


def act_parts(name: Column) -> dict[str, Column]:
    """STR-14: kind, number and object of an act's name 'Акт ГИКЭ № 34-23 «…»'; '' where missing."""
    low = F.lower(name)
    return {
        "act_kind": F.when(F.contains(low, F.lit("заключение")), "заключение").when(F.contains(low, F.lit("акт")), "акт").otherwise(""),
        "act_number": F.regexp_extract(name, r"№\s*(\d+[-/]\d+)", 1),
        "act_object": F.trim(F.regexp_extract(name, r"«(.+)»", 1)),
    }


def report_title(page: Column) -> dict[str, Column]:
    """STR-17: fields of a report's title page as running text: title, town, author, permit, organisation, year, area; '' where missing."""
    got = lambda pattern, k=1: F.trim(F.regexp_replace(F.regexp_extract(page, pattern, k), r"\s+", " "))
    initials = r"(\p{Lu}\p{Ll}+\s+\p{Lu}\.\s*\p{Lu}\.|\p{Lu}\.\s*\p{Lu}\.\s+\p{Lu}\p{Ll}+)"
    return {
        "title": got(r"(?iu)(научный\s+отч[её]т[\s\S]*?\d{4}\s*г(?:\.|ода?)?)"),
        "town": got(r"(?u)\bг\.\s*(\p{Lu}[\p{L}-]+)"),
        "author": got(r"(?u)(?:[Вв]ыполнил|[Аа]втор):\s+" + initials),
        "permit": got(r"(?iu)открыт\p{L}*\s+лист\p{L}*\s*№\s*(\d+(?:-\d+)*)"),
        "organization": got(r"(?iu)((?:общество\s+с\s+ограниченной\s+ответственностью|ООО)\s*[«\"][^»\"]+[»\"])"),
        "written": got(r"(?u)\p{Lu}\p{Ll}+,?\s+(\d{4})\s*$"),
        "area": got(r"(?iu)площад\p{L}*[^\d]{0,80}?(\d+(?:[.,]\d+)?\s*(?:кв\.\s*м|м2|га))"),
    }


def object_sizes(text: Column) -> dict[str, Column]:
    """STR-13: total area, length and linear area of an object, and the areas in reserve: those in square metres or without a
    unit, taken where nothing better is found. null where missing."""
    number = r"(\d+(?: \d{3})*(?:,\d+)?\s+"
    found = lambda pattern: F.nullif(F.regexp_extract(text, "(?isu)" + pattern, 1), F.lit(""))
    return {
        "total": found(r"площад[\pL]*[^\d]{0,80}?" + number + "га)"),
        "length": found(r"протяж[\pL]*[^\d]{0,80}?" + number + r"\pL+)"),
        "linear": found(r"площ\pL+\s+лин[^\d]{0,80}?" + number + r"\pL+)"),
        "reserve": F.regexp_extract_all(text, F.lit(r"(?isu)площад[\pL]*[^\d]{0,80}?" + number + r"кв\. м)"), F.lit(1)),
    }


def act_fields(sections_: DataFrame, doc: str = "doc_id") -> DataFrame:
    """STR-14: (doc, place, customer, experts, kind, permit) of acts from their sections(doc, section, body); '' where missing.

    Place and customer lose the dashes and colons of their heading; experts are all full names or names with initials, in
    order; kind is ЗУ, НПД or Док-я by what the object's section speaks of.
    """
    body = lambda name: F.coalesce(F.max(F.when(F.col("section") == name, F.col("body"))), F.lit(""))
    held = sections_.groupBy(doc).agg(*[body(n).alias(n) for n in ("place", "customer", "expert", "object", "documents")])
    clean = lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, "[–:]", ""), r"\s+", " "))
    names = F.regexp_extract_all("expert", F.lit(r"(?u)(\p{Lu}\p{Ll}+\s+(?:\p{Lu}\p{Ll}+\s+\p{Lu}\p{Ll}+|\p{Lu}\.\s*\p{Lu}\.))"), F.lit(1))
    low = F.lower("object")
    kind = F.when(F.contains(low, F.lit("земельн")) | F.contains(low, F.lit("участ")), "ЗУ").when(F.contains(low, F.lit("раздел")) | F.contains(low, F.lit("нпд")), "НПД").when(F.contains(low, F.lit("документац")), "Док-я").otherwise("")
    return held.select(doc, clean(F.col("place")).alias("place"), clean(F.col("customer")).alias("customer"), F.array_join(F.array_distinct(names), ";\n").alias("experts"), kind.alias("kind"), F.regexp_extract("documents", r"(?iu)открыт\p{L}*\s+лист\p{L}*\s*№\s*(\d+(?:-\d+)*)", 1).alias("permit"))


def by_contents(text: str | None) -> list[tuple[str, str]]:
    """STR-18: (title, body) of a report split again by its own table of contents; titles that do not come back are left out."""
    entries = contents(text)
    if not entries:
        return []
    after = max(m.end() for m in re.finditer(r"^.*?\w.*?[ .…_]{3,}\d{1,4}\s*$", text, re.M))
    low, at, places = text.lower(), after, []
    for title, _ in entries:
        m = re.compile(r"^[\d. ]*" + r"\s+".join(map(re.escape, re.sub(r"^[\d. ]+", "", title).lower().split())), re.M).search(low, at)
        if m:
            places.append((title, m.start(), m.end()))
            at = m.end()
    return [(title, text[end : places[k + 1][1] if k + 1 < len(places) else len(text)].strip()) for k, (title, _, end) in enumerate(places)]


def split_by_contents(reports: DataFrame, key: str, text: str) -> DataFrame:
    """STR-18 over a column: (key, pos, title, body); null texts and those without a table of contents have none."""

    @F.pandas_udf("array<struct<title:string,body:string>>")
    def split(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"title": a, "body": b} for a, b in by_contents(t)])

    return reports.select(F.col(key), F.posexplode(split(F.coalesce(text, F.lit("")))).alias("pos", "_s")).select(key, "pos", "_s.title", "_s.body")
