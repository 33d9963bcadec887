"""Sinks: spreadsheets, responses, reports, indexes (SNK-01, 02, 05..09)."""

from __future__ import annotations

import html
import zipfile
from xml.sax.saxutils import escape

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def encoded(df: DataFrame, columns: list[str]) -> DataFrame:
    """SNK-01: structured columns as JSON text."""
    return df.withColumns({c: F.to_json(c) for c in columns})


def write_csv(df: DataFrame, path: str, headers: dict[str, str] | None = None) -> None:
    """SNK-02 at scale: a register as CSV parts, each with the header row."""
    df.withColumnsRenamed(headers or {}).write.mode("overwrite").option("header", True).csv(path)


def write_xlsx(df: DataFrame, path: str, most: int = 1_048_575, headers: dict[str, str] | None = None, widths: dict[str, float] | None = None) -> int:
    """SNK-02: a register as one .xlsx sheet, streamed row by row to the driver's disk; returns the number of rows.

    headers: what is shown over a column (its name if missing); widths: by column. A sheet holds `most` rows; a longer
    register is an error, not a cut one. write_csv is the way at scale.
    """
    headers, widths = headers or {}, widths or {}
    cols = "".join(f'<col min="{k}" max="{k}" width="{widths[c]}" customWidth="1"/>' for k, c in enumerate(df.columns, 1) if c in widths)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", '<?xml version="1.0"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>')
        z.writestr("_rels/.rels", '<?xml version="1.0"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", '<?xml version="1.0"?><workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="Register" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<?xml version="1.0"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet1.xml"/></Relationships>')
        n = 0
        with z.open("xl/worksheets/sheet1.xml", "w") as sheet:
            sheet.write(b'<?xml version="1.0"?><worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main">' + (f"<cols>{cols}</cols>" if cols else "").encode() + b"<sheetData>")
            sheet.write(_row([headers.get(c, c) for c in df.columns]))
            for row in df.toLocalIterator():
                n += 1
                if n > most:
                    raise ValueError(f"more than {most} rows do not fit a sheet")
                sheet.write(_row(row))
            sheet.write(b"</sheetData></worksheet>")
    return n


def _row(values) -> bytes:
    return ("<row>" + "".join(f'<c t="inlineStr"><is><t xml:space="preserve">{escape("" if v is None else str(v))}</t></is></c>' for v in values) + "</row>").encode()


def response(page: DataFrame, draw: int, total: int, kept: int) -> dict:
    """SNK-06: one page of a register as the table protocol's answer; a page is bounded by its length."""
    return {"draw": draw, "recordsTotal": total, "recordsFiltered": kept, "data": [r.asDict() for r in page.collect()]}


def status_counts(items: DataFrame, status: str = "status") -> DataFrame:
    """AGG-03: one row: total and the four states of a crawl."""
    count = lambda words: F.count_if(F.coalesce(F.col(status).isin(*words), F.lit(False)))
    return items.agg(F.count("*").alias("total"), count(["скачан"]).alias("downloaded"), count(["пропущен"]).alias("skipped"), count(["в очереди на скачивание"]).alias("queued"), count(["ошибка"]).alias("failed"))


def crawl_report(items: DataFrame, path: str, header: str = "") -> None:
    """SNK-05: an HTML report of a crawl with its counts, streamed to a file."""
    c = status_counts(items).first()
    with open(path, "w", encoding="utf-8") as f:
        f.write(f"<html><body><h1>{html.escape(header)}</h1><p>{c['total']} / {c['downloaded']} / {c['skipped']} / {c['queued']} / {c['failed']}</p><table>")
        for row in items.select("title", "status", "reason").toLocalIterator():
            f.write("<tr>" + "".join(f"<td>{html.escape(str(v or ''))}</td>" for v in row) + "</tr>")
        f.write("</table></body></html>")


def shortcut(url: Column) -> Column:
    """SNK-08: body of an internet shortcut file."""
    return F.concat(F.lit("[InternetShortcut]\nURL="), url, F.lit("\n"))


def order_note(order: Column) -> Column:
    """SNK-09: note beside a document whose order was not found; null where there is an order text to search by."""
    return F.when(F.coalesce(F.trim(order), F.lit("")) == "", F.lit("Приказ не указан")).otherwise(F.concat(F.lit("Не найден: "), order))


def write_vectors(vectors: DataFrame, path: str) -> None:
    """SNK-07: a vector index as Parquet with array<float>."""
    vectors.write.mode("overwrite").parquet(path)
