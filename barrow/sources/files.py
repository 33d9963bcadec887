"""Files as rows: discovery, digests, manifests, office tables, page counts, HTML listings (SRC-03..10, 16, 19, 20, 22)."""

from __future__ import annotations

import io
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Words in a name that keep a file out of discovery.
SKIPPED = ("приказ", "решение")


def discovered(files: DataFrame, extensions: list[str], limit: int | None = None) -> DataFrame:
    """SRC-03, LIM-05: files(path, ...) by extension, without hidden, temporary and order files, at most `limit` of each extension by path."""
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    ext = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    kept = files.withColumn("name", name).withColumn("extension", ext).where(F.col("extension").isin(*extensions) & ~F.substring("name", 1, 1).isin("~", "."))
    for word in SKIPPED:
        kept = kept.where(~F.contains(F.lower("name"), F.lit(word)))
    if limit is None:
        return kept
    return kept.withColumn("_n", F.row_number().over(Window.partitionBy("extension").orderBy("path"))).where(F.col("_n") <= limit).drop("_n")


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """Paths and sizes of all files under a folder, content unread."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", F.col("length").alias("bytes"), "modificationTime")


def manifest_updated(entries: DataFrame, prefix: str, path: str) -> DataFrame:
    """SRC-22: a manifest (prefix, path) in which the list of a prefix is replaced by a newer one; other lists stay."""
    fresh = entries.sparkSession.createDataFrame([(prefix, path)], "prefix string, path string")
    return entries.where(F.col("prefix") != prefix).select("prefix", "path").unionByName(fresh)


def digests(spark: SparkSession, folder: str, algorithm: str = "sha256") -> DataFrame:
    """MAT-01: (path, file_hash) with sha256, sha1 or md5; any other algorithm is an error."""
    make = {"sha256": lambda c: F.sha2(c, 256), "sha1": F.sha1, "md5": F.md5}
    if algorithm not in make:
        raise ValueError(f"no such digest: {algorithm}")
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", make[algorithm](F.col("content")).alias("file_hash"))


def manifest(lines: DataFrame, order: str = "line_no") -> DataFrame:
    """SRC-22: 'prefix - path' lines(value, line_no): the path of each prefix's last line."""
    parts = F.split("value", " - ", 2)
    return lines.where(F.contains("value", F.lit(" - "))).select(F.trim(parts[0]).alias("prefix"), F.trim(parts[1]).alias("path"), order).groupBy("prefix").agg(F.max_by("path", order).alias("path"))


def _xml_rows(body: bytes, member: str) -> ET.Element | None:
    try:
        with zipfile.ZipFile(io.BytesIO(body)) as z:
            return ET.fromstring(z.read(member)) if member in z.namelist() else None
    except (zipfile.BadZipFile, ET.ParseError):
        return None


def docx_tables(body: bytes) -> list[list[list[str]]]:
    """SRC-06: cell texts of every table of a .docx."""
    root = _xml_rows(body, "word/document.xml")
    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    if root is None:
        return []
    return [[["".join(t.text or "" for t in cell.iter(f"{w}t")) for cell in row.iter(f"{w}tc")] for row in table.iter(f"{w}tr")] for table in root.iter(f"{w}tbl")]


def xlsx_grid(body: bytes) -> list[list[str]]:
    """SRC-08, SRC-09: the first sheet of an .xlsx as text, empty cells as ''."""
    s = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
    sheet, shared = _xml_rows(body, "xl/worksheets/sheet1.xml"), _xml_rows(body, "xl/sharedStrings.xml")
    if sheet is None:
        return []
    texts = ["".join(t.text or "" for t in si.iter(f"{s}t")) for si in shared] if shared is not None else []
    grid: list[list[str]] = []
    for row in sheet.iter(f"{s}row"):
        cells: dict[int, str] = {}
        for c in row.iter(f"{s}c"):
            # A cell without an address follows the one before it.
            letters = re.match(r"[A-Z]*", c.get("r", ""))[0]
            at = sum((ord(ch) - 64) * 26**k for k, ch in enumerate(reversed(letters))) - 1 if letters else max(cells, default=-1) + 1
            value = c.find(f"{s}v")
            inline = "".join(t.text or "" for t in c.iter(f"{s}t"))
            cells[at] = texts[int(value.text)] if c.get("t") == "s" and value is not None else inline or (value.text if value is not None else "") or ""
        grid.append([cells.get(k, "") for k in range(max(cells, default=-1) + 1)])
    return grid


def pdf_pages(body: bytes) -> list[str]:
    """SRC-04: text of each page of a PDF. Without a PDF library this is an error, not a file without pages."""
    import pdfplumber

    with pdfplumber.open(io.BytesIO(body)) as pdf:
        return [page.extract_text() or "" for page in pdf.pages]


def pdf_tables(body: bytes) -> list[tuple[int, list[list[str]]]]:
    """SRC-05: (page number, cells) of the tables of all pages of a PDF; an error without a PDF library."""
    import pdfplumber

    with pdfplumber.open(io.BytesIO(body)) as pdf:
        return [(n, [[c or "" for c in row] for row in t]) for n, page in enumerate(pdf.pages, 1) for t in page.extract_tables()]


def page_count(body: bytes) -> int | None:
    """SRC-19: pages of a PDF, a .docx (as its properties state) or an image (1); null if unknown."""
    if body[:5] == b"%PDF-":
        return len(re.findall(rb"/Type\s*/Page(?![s\w])", body)) or None
    if body[:2] == b"PK":
        root = _xml_rows(body, "docProps/app.xml")
        pages = None if root is None else next((e.text for e in root.iter() if e.tag.endswith("}Pages")), None)
        return int(pages) if pages and pages.isdigit() else None
    return 1 if body[:2] in (b"\xff\xd8", b"\x89P", b"BM", b"II", b"MM") else None


def tables(files: DataFrame, read: Callable[[bytes], list[list[list[str]]]] = docx_tables) -> DataFrame:
    """SRC-05..07: files(path, content) as cell rows: (path, table_no, row_no, cells); row 0 is the header."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(p, t, r, cells) for p, body in zip(pdf["path"], pdf["content"], strict=True) for t, table in enumerate(read(bytes(body))) for r, cells in enumerate(table)]
            yield pd.DataFrame(rows, columns=["path", "table_no", "row_no", "cells"])

    return files.select("path", "content").mapInPandas(run, "path string, table_no int, row_no int, cells array<string>")


def page_counts(files: DataFrame) -> DataFrame:
    """SRC-20: files(path, content) with their page counts."""

    @F.pandas_udf("int")
    def pages(bodies: pd.Series) -> pd.Series:
        return bodies.map(lambda b: page_count(bytes(b)) if b is not None else None).astype("Int32")

    return files.select("path", pages("content").alias("pages"))


class _Listing(HTMLParser):
    def __init__(self) -> None:
        super().__init__()
        self.items: list[tuple[str, str]] = []
        self.href: str | None = None
        self.text = ""

    def handle_starttag(self, tag, attrs):
        if tag == "a":
            self.href, self.text = dict(attrs).get("href"), ""

    def handle_data(self, data):
        self.text += data

    def handle_endtag(self, tag):
        if tag == "a" and self.href:
            self.items.append((re.sub(r"\s+", " ", self.text).strip(), self.href))
            self.href = None


def links(html: str | None) -> list[tuple[str, str]]:
    parser = _Listing()
    parser.feed(html or "")
    return parser.items


def html_links(pages: DataFrame, key: str, html: str) -> DataFrame:
    """SRC-16 without the network: (key, pos, title, href) of every link of a stored listing page."""

    @F.pandas_udf("array<struct<title:string,href:string>>")
    def found(bodies: pd.Series) -> pd.Series:
        return bodies.map(lambda b: [{"title": t, "href": h} for t, h in links(b)])

    return pages.select(F.col(key), F.posexplode(found(F.col(html))).alias("pos", "l")).select(key, "pos", "l.title", "l.href")


def is_document(name: Column) -> Column:
    """FLT-17: a PDF that is no check of a signature."""
    low = F.lower(name)
    return F.coalesce(low.endswith(".pdf") & ~low.rlike(r"проверк[\s\S]+подпис\S+"), F.lit(False))


def status_cascade(items: DataFrame, known: DataFrame, excluded: list[str], start: str, end: str) -> DataFrame:
    """FLT-14..17: crawl items(title, href) with (status, reason); the first rule that applies decides.

    known(file_name) are files already stored; start and end are dates yyyy-mm-dd, inclusive.
    """
    title, href, low = F.coalesce("title", F.lit("")), F.coalesce("href", F.lit("")), F.lower(F.concat_ws(" ", "title", "href"))
    date = F.regexp_extract(title, r"(\d{2}\.\d{2}\.\d{4})", 1)
    day = F.try_to_timestamp(date, F.lit("dd.MM.yyyy")).cast("date")
    name = F.regexp_extract(href, r"([^/]*)$", 1)
    skipped = F.lit(False)
    for word in excluded:
        skipped = skipped | F.contains(title, F.lit(word))
    marked = items.withColumn("file_name", name).join(known.select("file_name", F.lit(True).alias("_known")).distinct(), "file_name", "left")
    reason = (
        F.when(skipped, "Исключение по фильтру")
        .when(date == "", "Не подходит по дате (дата не найдена)")
        .when(day.isNull(), "Ошибка парсинга даты")
        .when(~day.between(start, end), "Не подходит по дате")
        .when(~F.contains(href, F.lit("/upload/")), "Не найдена подходящая ссылка")
        .when(~(F.contains(low, F.lit("акт")) | F.contains(low, F.lit("гикэ"))), "Не является актом ГИКЭ")
        .when(F.col("_known"), "Файл уже скачан")
        .when(name.rlike(r"\.(sig|png|jpg|bmp|tiff)$"), "У файла неподходящий формат")
    )
    return marked.withColumn("reason", F.coalesce(reason, F.lit("Добавлен в очередь скачивания"))).withColumn("status", F.when(reason.isNotNull(), "пропущен").otherwise("в очереди на скачивание")).drop("_known")
