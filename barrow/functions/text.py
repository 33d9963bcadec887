"""Text functions as column expressions. Patterns fold case with (?iu): Java's (?i) alone leaves Cyrillic as it is."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Russian months in the genitive.
MONTHS = ("января", "февраля", "марта", "апреля", "мая", "июня", "июля", "августа", "сентября", "октября", "ноября", "декабря")
#: Caption words, their category by the first keyword found, in order.
CAPTION_WORDS = r"(?:Рис\.|Рисунок|Приложение|Илл\.|Иллюстрация)"
CATEGORIES = (("общий вид участка", "object_fotos"), ("карта", "maps"), ("карты", "maps"), ("схема", "schemas"), ("схемы", "schemas"), ("спутниковый снимок", "maps"), ("шурф", "pits_fotos"), ("раскоп", "excavation_fotos"), ("зачистка", "pits_fotos"), ("врезка", "pits_fotos"), ("открытый лист", "open_list"))


def _or(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, parts, F.lit(False))


def icontains(text: Column, needle: str) -> Column:
    """Case-insensitive substring; % and _ are ordinary characters; null contains nothing."""
    return F.coalesce(F.contains(F.lower(text), F.lit(needle.lower())), F.lit(False))


def contains_any(text: Column, needles: list[str]) -> Column:
    """Whether any needle stands in the text, case kept (FLT-14)."""
    return F.coalesce(_or([F.contains(text, F.lit(n)) for n in needles]), F.lit(False))


def path_component(name: Column) -> Column:
    """A name as one path component (STR-01): letters without ё, digits and a few signs, no blanks or stops at the ends."""
    return F.btrim(F.regexp_replace(name, r"[^a-zA-Zа-яА-Я0-9 \-,«».()]", ""), F.lit(" ."))


def file_name(name: Column, longest: int = 100) -> Column:
    """A name as a file name (STR-02)."""
    safe = F.regexp_replace(F.regexp_replace(F.translate(name, '<>:"/\\|?*', "_" * 9), r"\s+", " "), "_+", "_")
    return F.when(F.length(safe) > longest, F.rtrim(F.substring(safe, 1, longest), F.lit(" ._"))).otherwise(safe)


def is_float(text: Column) -> Column:
    return F.coalesce(text.try_cast("double").isNotNull(), F.lit(False))


def is_int(text: Column) -> Column:
    return F.coalesce(F.trim(text).rlike(r"^[+-]?\d+$"), F.lit(False))


def first_words(text: Column, n: int = 400) -> Column:
    """The first n words, single-spaced (STR-04); null stays null."""
    return F.array_join(F.slice(F.split(F.trim(text), r"\s+"), 1, n), " ")


def collapse_blank_lines(text: Column) -> Column:
    return F.regexp_replace(text, "\n\n+", "\n")


def collapse_space(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def dotted_date(text: Column) -> Column:
    """yyyy-mm-dd... as dd.mm.yyyy; other spellings pass, blanks and 'nan' become '' (STR-07)."""
    bare = F.trim(F.coalesce(text, F.lit("")))
    return F.when(F.lower(bare).isin("", "nan"), "").otherwise(F.regexp_replace(bare, r"^(\d{4})-(\d{1,2})-(\d{1,2})(?:[ T].*)?$", "$3.$2.$1"))


def year(text: Column) -> Column:
    """'2023.0' as '2023' (MAT-13); blanks and 'nan' as ''."""
    bare = F.trim(F.coalesce(text, F.lit("")))
    return F.when(F.lower(bare) == "nan", "").otherwise(F.regexp_replace(bare, r"\.0+$", ""))


def is_worded_date(text: Column) -> Column:
    """Whether the text holds day, known month in words and year 1980 to 2099 (STR-08)."""
    part = F.regexp_extract(text, r"«*(\d+)»* *([а-яА-ЯёЁ]+) (\d+)", 0)
    day, month, y = (F.regexp_extract(text, r"«*(\d+)»* *([а-яА-ЯёЁ]+) (\d+)", k) for k in (1, 2, 3))
    good = (part != "") & (F.length(day) <= 2) & (F.length(y) == 4) & F.lower(month).isin(*MONTHS)
    return F.coalesce(good & (day.try_cast("int") <= 31) & y.try_cast("int").between(1980, 2099), F.lit(False))


def nearest_month(word: Column, farthest: int = 4) -> Column:
    """Number (two digits) of the month nearest by edits, at most `farthest` away, ties to the earlier; else null (MAT-19)."""
    ranked = F.array_sort(F.array(*[F.struct(F.levenshtein(F.lower(word), F.lit(m)).alias("d"), F.lit(k + 1).alias("m")) for k, m in enumerate(MONTHS)]))
    best = F.element_at(ranked, 1)
    return F.when(best["d"] <= farthest, F.lpad(best["m"].cast("string"), 2, "0"))


def date_to_dots(text: Column) -> Column:
    """Day, month in words (misspelt or not) and year as dd.mm.yyyy, '-' for what is missing (STR-09)."""
    day = F.regexp_extract(text, r"(?<!\d)(\d{1,2})(?!\d)", 1)
    y = F.regexp_extract(text, r"(\d{4})", 1)
    word = F.regexp_extract(text, r"([а-яА-ЯёЁ]+)", 1)
    dash = lambda c: F.when(c == "", "-").otherwise(c)
    month = F.when(word == "", "-").otherwise(F.coalesce(nearest_month(word), word))
    return F.when(text.isNotNull(), F.concat(dash(F.when(day != "", F.lpad(day, 2, "0")).otherwise("")), F.lit("."), month, F.lit("."), dash(y)))


def citation(text: Column) -> dict[str, Column]:
    """Name, number and date of an order cited as 'Приказ от 01.02.2024 № 123-45' (STR-12); '' where missing."""
    return {
        "order_name": F.trim(F.regexp_extract(text, r"^(\D+?)(?= от )", 1)),
        "order_number": F.regexp_extract(text, r"(№\s+\d+-*\d*)", 1),
        "order_date": F.regexp_extract(text, r"(\d{2}\.\d{2}\.\d{4})", 1),
    }


def file_parts(name: Column) -> dict[str, Column]:
    """Date, year, expert, place and kind told by a file name 'dd.mm.yyyy Expert, place.pdf' (STR-20); '' where missing."""
    stem = F.regexp_replace(F.regexp_replace(name, r"^.*/", ""), r"(?iu)\.[a-zа-я0-9]{2,4}$", "")
    date = F.regexp_extract(stem, r"(\d{1,2}\.\d{1,2}\.\d{4})", 1)
    return {
        "file_date": date,
        "file_year": F.regexp_extract(date, r"(\d{4})", 1),
        "file_expert": F.trim(F.regexp_extract(stem, r"\d{1,2}\.\d{1,2}\.\d{4}\s+([^,]+),", 1)),
        "file_place": F.trim(F.regexp_extract(stem, r",\s*(.+)$", 1)),
        "file_kind": F.when(F.contains(F.upper(stem), F.lit("ЗУ")), "ЗУ").when(F.contains(F.upper(stem), F.lit("НПД")), "НПД").otherwise(""),
    }


def _replaced(text: Column, *pairs: tuple[str, str]) -> Column:
    return reduce(lambda t, p: F.replace(t, F.lit(p[0]), F.lit(p[1])), pairs, text)


def scanned_string(text: Column) -> Column:
    """Scanner's stray signs out (STR-21)."""
    return F.trim(F.translate(text, "@=’`^‘!|$_&", "а"))


def scanned_date(text: Column) -> Column:
    return F.trim(_replaced(text, ("20242.", "2024  г."), ("20252.", "2025  г."), ("2924", "2024"), ("/", "1"), ("З", "3")))


def scanned_list_number(text: Column) -> Column:
    return _replaced(F.upper(text), ("О", "0"), ("()", "0"), ("З", "3"))


def scanned_number(text: Column) -> Column:
    return F.translate(F.replace(text, F.lit("()"), F.lit("0")), "/!|Г[ОЗбБ", "111110366")


def caption_parts(text: Column) -> dict[str, Column]:
    """Number, title and category of a figure caption (STR-15); category 'other' for captions of no keyword, null for no caption."""
    found = F.regexp_extract(text, rf"(?iu)^\s*{CAPTION_WORDS}\s*(\d+)", 1)
    title = F.trim(F.regexp_replace(text, rf"(?iu)^\s*{CAPTION_WORDS}\s*\d+[.:\s–—-]*", ""))
    low = F.lower(text)
    category = reduce(lambda c, kv: c.when(F.contains(low, F.lit(kv[0])), kv[1]), CATEGORIES[1:], F.when(F.contains(low, F.lit(CATEGORIES[0][0])), CATEGORIES[0][1]))
    return {"caption_no": found.try_cast("int"), "caption_title": F.when(found != "", title), "category": F.when(found != "", category.otherwise("other"))}


def figure_numbers(text: Column) -> Column:
    """Numbers of all figures referred to, ranges opened (1-3 gives 1, 2, 3), in order of mention (STR-16)."""
    refs = F.regexp_extract_all(text, F.lit(r"(?iu)(?:Рис\.|Рисунок|Приложение)\s*(\d[\s\d\-;,]*)"), F.lit(1))
    groups = F.flatten(F.transform(refs, lambda r: F.split(F.regexp_replace(r, r"\s", ""), "[;,]")))
    good = F.filter(groups, lambda g: g.rlike(r"^\d{1,6}(-\d{1,6})?$"))
    opened = F.transform(good, lambda g: F.sequence(F.split(g, "-").getItem(0).cast("int"), F.greatest(F.split(g, "-").getItem(0).cast("int"), F.element_at(F.split(g, "-"), -1).cast("int"))))
    return F.flatten(opened)


def linked_figures(text: Column) -> Column:
    """The text with ' [n, n]' links after each figure reference (STR-16), as plain anchors."""
    return F.regexp_replace(text, r"(?iu)((?:Рис\.|Рисунок)\s*)(\d+)(?![\d-])", r'$1$2 [<a href="#image-link-$2">$2</a>]')


def file_role(name: Column) -> Column:
    """text, images or all, told by a file name (STR-23)."""
    low = F.lower(name)
    return F.when(F.contains(low, F.lit("текст")), "text").when(F.contains(low, F.lit("приложение")) | F.contains(low, F.lit("иллюстрации")), "images").otherwise("all")


def role_stem(name: Column) -> Column:
    """What files of one report share in their names: the stem without the word of the role (STR-24)."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(name), r"\.[a-z0-9]+$", ""), r"[\s_.-]*(?:текст|приложение|иллюстрации)[\s_.-]*", " "))


def download_url(base: str, href: Column) -> Column:
    """Absolute URL with the last path part percent-encoded but for brackets (STR-25)."""
    folder, last = F.regexp_extract(href, r"^(.*)/[^/]*$", 1), F.regexp_extract(href, r"([^/]*)$", 1)
    return F.concat(F.lit(base), folder, F.lit("/"), _replaced(F.url_encode(last), ("+", "%20"), ("%28", "("), ("%29", ")")))


def is_email(text: Column) -> Column:
    return F.coalesce(text.rlike(r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}$"), F.lit(False))


def measured(text: Column) -> dict[str, Column]:
    """Area and length stated in a text (STR-13): first number with its unit after 'площад…' and after 'протяж…'; null where missing."""
    number = r"(\d+(?: \d{3})*(?:,\d+)?)\s+"
    area = rf"(?isu)площад\w*.{{0,80}}?{number}(га|кв\. м)"
    length = rf"(?isu)протяж\w*.{{0,60}}?{number}(км|м)\b"
    blank = lambda p, k: F.nullif(F.regexp_extract(text, p, k), F.lit(""))
    return {"area": F.replace(F.replace(blank(area, 1), F.lit(" ")), F.lit(","), F.lit(".")).try_cast("double"), "area_unit": blank(area, 2), "length": F.replace(F.replace(blank(length, 1), F.lit(" ")), F.lit(","), F.lit(".")).try_cast("double"), "length_unit": blank(length, 2)}
