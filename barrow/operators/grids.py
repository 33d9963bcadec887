"""Cell grids of documents: coordinate tables and what they hold, sub-tables of sheets, tables of executors
(SRC-07, SRC-08, GEO-07, GEO-08, GEO-10, GEO-19, STR-19)."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barrow.functions import geo
from barrow.operators.extraction import decimal_degrees

#: Columns of a sheet that are looked at for sub-tables.
SHEET_COLUMNS = 20
#: What heads the columns of a coordinate table: latitude or X, longitude or Y, number, part.
LAT_HEAD, LON_HEAD = re.compile(r"широт|^[xх](?:[ ,(]|$)", re.I), re.compile(r"долгот|^[yу](?:[ ,(]|$)", re.I)
NO_HEAD, PART_HEAD = re.compile(r"№|номер|обознач|точк", re.I), re.compile(r"зон|участ", re.I)
_SYSTEM = re.compile(r"\b(wgs|мск|гск)[- ]?(\d+)(?:,?\s*зона\s*(\d+))?", re.I)
_DEGREES = re.compile(r"\d+\s*°\s*\d+\s*['′’]\s*\d+(?:[.,]\d+)?")
_NUMBER = re.compile(r"-?\d+[.,]\d+")
_FULL_NAME = re.compile(r"[А-ЯЁ][а-яё]+\s+[А-ЯЁ][а-яё]+\s+[А-ЯЁ][а-яё]+")
_PAIR = re.compile(rf"([NSСЮ]?\s*{_DEGREES.pattern}[\"″”]?\s*(?:[NSСЮ]|с\. ?ш\.|ю\. ?ш\.)?)[\s,;]+([EWВЗ]?\s*{_DEGREES.pattern}[\"″”]?\s*(?:[EWВЗ]|в\. ?д\.|з\. ?д\.)?)", re.I)
#: Headings over coordinates on a page, and the group their points fall in.
PAGE_HEADS = ((re.compile(r"каталог\s+координат", re.I), "Каталог координат"), (re.compile(r"фотофиксаци", re.I), "Пункты фотофиксации"), (re.compile(r"шурф", re.I), "Шурфы"), (re.compile(r"центр", re.I), "Центр объекта"))


def _cell(row: list, k: int) -> str:
    return str(row[k]).strip() if 0 <= k < len(row) and row[k] is not None else ""


def headed(cells: list[list]) -> list[dict[str, str]]:
    """SRC-07: a raw table's rows as dicts by its first row; a repeated or empty heading gets its number."""
    if not cells:
        return []
    names: list[str] = []
    for k, c in enumerate(cells[0]):
        name = str(c or "").strip() or f"column_{k + 1}"
        names.append(name if name not in names else f"{name}_{k + 1}")
    return [{n: _cell(row, k) for k, n in enumerate(names)} for row in cells[1:]]


def sub_tables(cells: list[list]) -> list[list[list[str]]]:
    """SRC-08: the tables of a sheet: runs of rows with at least two filled cells in its first SHEET_COLUMNS columns, cropped
    to the columns that are filled in them."""
    out, run = [], []
    for row in [*cells, []]:
        row = [_cell(row, k) for k in range(min(len(row), SHEET_COLUMNS))]
        if sum(map(bool, row)) >= 2:
            run.append(row)
        elif run:
            width = max(map(len, run))
            padded = [r + [""] * (width - len(r)) for r in run]
            used = [k for k in range(width) if any(r[k] for r in padded)]
            out.append([[r[k] for k in range(used[0], used[-1] + 1)] for r in padded])
            run = []
    return out


def systems_named(text: str) -> list[str]:
    """Coordinate systems a text names, as they are called here: 'МСК 167' is мск167, 'МСК-24, зона 4' мск24зона4."""
    return list(dict.fromkeys(f"{m[1]}{m[2]}{'зона' + m[3] if m[3] else ''}".lower() for m in _SYSTEM.finditer(text or "")))


def columns_of(cells: list[list]) -> tuple[dict[str, int], int] | None:
    """GEO-08, GEO-11: ({lat, lon, no, part}, first row of points) of a coordinate table, by its headings wherever they stand, else
    by the first two columns of values that look like coordinates; None if it is none (GEO-07)."""
    at: dict[str, int] = {}
    for r, row in enumerate(cells):
        for k in range(len(row)):
            c = _cell(row, k)
            for name, head in (("lat", LAT_HEAD), ("lon", LON_HEAD), ("no", NO_HEAD), ("part", PART_HEAD)):
                if name not in at and head.search(c) and not _DEGREES.search(c):
                    at[name] = k
        if "lat" in at and "lon" in at and at["lat"] != at["lon"]:
            return at | {"no": at.get("no", min(at["lat"], at["lon"]) - 1)}, r + 1
        values = [k for k in range(len(row)) if _DEGREES.search(_cell(row, k)) or re.fullmatch(r"-?\d{2,}[.,]\d{2,}", _cell(row, k))]
        if len(values) >= 2:
            return {"lat": values[0], "lon": values[1], "no": values[0] - 1} | {n: k for n, k in at.items() if n == "part"}, r
    return None


def points_of(cells: list[list], systems: list[str] = (), name: str = "Каталог координат") -> list[tuple[str, str, str, float, float]]:
    """GEO-07, GEO-08: (group, system, point, lat, lon) of a coordinate table, split into the parts its rows name.

    Degrees are read as they are, southern and western ones negative; numbers with a point are metres of the first named
    system that is no geographic one, else degrees. Rows without two coordinates are headings or blanks. A part named in
    one row holds for the rows under it.
    """
    told = columns_of(cells)
    if not told:
        return []
    at, first = told
    plane = next((s for s in systems if s in geo.ZONES), None)
    out, part = [], ""
    for row in cells[first:]:
        if "part" in at and _cell(row, at["part"]):
            part = _cell(row, at["part"])
        lat, lon = _cell(row, at["lat"]), _cell(row, at["lon"])
        system = "wgs84"
        if _DEGREES.search(lat) and _DEGREES.search(lon):
            y, x = decimal_degrees(lat), decimal_degrees(lon)
        elif _NUMBER.fullmatch(lat.replace(" ", "")) and _NUMBER.fullmatch(lon.replace(" ", "")):
            y, x = (float(v.replace(" ", "").replace(",", ".")) for v in (lat, lon))
            if plane:
                (y,), (x,) = geo.from_zone(np.array([x]), np.array([y]), plane)
                system = plane
        else:
            continue
        if y is not None and x is not None:
            no = _cell(row, at["no"]) if at["no"] >= 0 else str(len(out) + 1)
            out.append((f"{name} [{part}]" if part else name, system, re.sub(r"^(\d+)[.,]0+$", r"\1", no) or str(len(out) + 1), float(y), float(x)))
    return out


def page_points(text: str | None) -> list[tuple[str, int, float, float]]:
    """GEO-10, GEO-19: (group, number, lat, lon) of the coordinates in running text, under the last heading before them; the centre of the
    object where there is none."""
    if not text:
        return []
    heads = sorted((m.start(), group) for pattern, group in PAGE_HEADS for m in pattern.finditer(text))
    out, counts = [], {}
    for m in _PAIR.finditer(text):
        group = next((g for at, g in reversed(heads) if at < m.start()), "Центр объекта")
        lat, lon = (decimal_degrees(re.sub(r"ю\. ?ш\.", "Ю", re.sub(r"з\. ?д\.", "З", re.sub(r"[св]\. ?[шд]\.", "", v, flags=re.I), flags=re.I), flags=re.I)) for v in m.groups())
        if lat is not None and lon is not None:
            counts[group] = counts.get(group, 0) + 1
            out.append((group, counts[group], lat, lon))
    return out


def executors(cells: list[list]) -> list[str]:
    """STR-19: 'name: share' of a table of executors, either headed ФИО and Степень участия, or of parameters and values."""
    if not cells or len(cells[0]) != 2:
        return []
    if [_cell(cells[0], 0), _cell(cells[0], 1)] == ["ФИО", "Степень участия"]:
        named = ((_FULL_NAME.search(_cell(row, 0)), _cell(row, 1)) for row in cells[1:])
        return [f"{m[0]}: {share}" for m, share in named if m]
    name = next((m[0] for row in cells if (m := _FULL_NAME.search(_cell(row, 0)))), None)
    share = next((_cell(row, 1) for row in cells if "Степень участия" in _cell(row, 0)), None)
    return [f"{name}: {share}"] if name and share else []


def _over(df: DataFrame, key: str, columns: list[str], schema: str, rows_of) -> DataFrame:
    """rows_of(values of the columns) for each row of df, in Arrow batches: (key, schema)."""
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(k, *r) for k, *values in pdf[["_key", *columns]].itertuples(index=False, name=None) for r in rows_of(*values)]
            yield pd.DataFrame(rows, columns=["_key", *names])

    picked = df.select(F.col(key).alias("_key"), *columns)
    return picked.mapInPandas(run, f"_key {dict(df.dtypes)[key]}, {schema}").withColumnRenamed("_key", key)


def _grid(cells) -> list[list]:
    return [list(r) if r is not None else [] for r in cells] if cells is not None else []


def table_points(tables: DataFrame, key: str, cells: str = "cells", systems: str = "systems") -> DataFrame:
    """points_of over tables(key, cells array<array<string>>, systems string): (key, grp, system, point_name, lat, lon); systems is
    the text that names them, null for none."""
    return _over(tables, key, [cells, systems], "grp string, system string, point_name string, lat double, lon double", lambda c, s: points_of(_grid(c), systems_named(s or "")))


def sheet_tables(sheets: DataFrame, key: str, cells: str = "cells") -> DataFrame:
    """sub_tables over sheets(key, cells): (key, table_no, cells)."""
    return _over(sheets, key, [cells], "table_no int, cells array<array<string>>", lambda c: list(enumerate(sub_tables(_grid(c)), 1)))


def text_points(pages: DataFrame, key: str, text: str = "text") -> DataFrame:
    """page_points over pages(key, text): (key, grp, point_no, lat, lon); null and empty pages have none."""
    return _over(pages, key, [text], "grp string, point_no int, lat double, lon double", page_points)


def executor_names(tables: DataFrame, key: str, cells: str = "cells") -> DataFrame:
    """executors over tables(key, cells): (key, executors), joined by ';\\n'; tables without any are left out."""
    return _over(tables, key, [cells], "executors string", lambda c: [(";\n".join(found),)] if (found := executors(_grid(c))) else [])
