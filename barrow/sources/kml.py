"""KML, KMZ and GeoJSON (SRC-11..15) as rows, and KML text as a sink (SNK-03, SNK-04)."""

from __future__ import annotations

import io
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PLACEMARKS = "path string, folders array<string>, name string, kind string, coords array<struct<lat:double,lon:double>>"


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _coords(text: str | None) -> list[dict]:
    out = []
    for part in (text or "").split():
        bits = part.split(",")
        try:
            out.append({"lat": float(bits[1]), "lon": float(bits[0])})
        except (IndexError, ValueError):
            continue
    return out


def placemarks(body: bytes) -> list[tuple]:
    """(folders, name, kind, coords) of a KML document, namespaced or not; a ring loses its repeated last point."""
    out: list[tuple] = []

    def walk(node: ET.Element, folders: list[str]) -> None:
        for child in node:
            tag = _local(child.tag)
            if tag in ("Folder", "Document"):
                name = next((c.text or "" for c in child if _local(c.tag) == "name"), "")
                walk(child, [*folders, name] if tag == "Folder" and name else folders)
            elif tag == "Placemark":
                name = next((c.text or "" for c in child if _local(c.tag) == "name"), "")
                for shape in child.iter():
                    kind = _local(shape.tag)
                    if kind in ("Point", "LineString", "Polygon"):
                        text = next((c.text for c in shape.iter() if _local(c.tag) == "coordinates"), None)
                        coords = _coords(text)
                        if kind == "Polygon" and len(coords) > 3 and coords[0] == coords[-1]:
                            coords = coords[:-1]
                        out.append((folders, name, kind, coords))

    try:
        walk(ET.fromstring(body), [])
    except ET.ParseError:
        return []
    return out


def unzipped(body: bytes) -> bytes:
    """The first .kml of a KMZ archive; anything else as it is."""
    if body[:2] != b"PK":
        return body
    with zipfile.ZipFile(io.BytesIO(body)) as z:
        return next((z.read(n) for n in z.namelist() if n.lower().endswith(".kml")), b"")


def read_kml(spark: SparkSession, path: str) -> DataFrame:
    """All placemarks of the KML and KMZ files under a path; malformed files have none."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.km[lz]").load(path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(p, *m) for p, body in zip(pdf["path"], pdf["content"], strict=True) for m in placemarks(unzipped(bytes(body)))]
            yield pd.DataFrame(rows, columns=["path", "folders", "name", "kind", "coords"])

    return files.select("path", "content").mapInPandas(run, PLACEMARKS)


def placemarks_of(df: DataFrame, key: str, body: str) -> DataFrame:
    """Placemarks of KML texts or files in a column: (key, folders, name, kind, coords); null and malformed ones have none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            bodies = (b.encode() if isinstance(b, str) else bytes(b or b"") for b in pdf["_body"])
            yield pd.DataFrame([(k, *m) for k, b in zip(pdf["_key"], bodies, strict=True) for m in placemarks(unzipped(b))], columns=["_key", "folders", "name", "kind", "coords"])

    kind = dict(df.dtypes)[key]
    told = df.select(F.col(key).alias("_key"), F.col(body).alias("_body")).where(F.col("_body").isNotNull())
    return told.mapInPandas(run, f"_key {kind}, folders array<string>, name string, kind string, coords array<struct<lat:double,lon:double>>").withColumnRenamed("_key", key)


def members(df: DataFrame, key: str, body: str) -> DataFrame:
    """SRC-14: every file of the archives in a column: (key, name, content); what is no archive has none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for k, b in zip(pdf["_key"], pdf["_body"], strict=True):
                if b is not None and bytes(b)[:2] == b"PK":
                    with zipfile.ZipFile(io.BytesIO(bytes(b))) as z:
                        rows += [(k, n, z.read(n)) for n in z.namelist() if not n.endswith("/")]
            yield pd.DataFrame(rows, columns=["_key", "name", "content"])

    kind = dict(df.dtypes)[key]
    return df.select(F.col(key).alias("_key"), F.col(body).alias("_body")).mapInPandas(run, f"_key {kind}, name string, content binary").withColumnRenamed("_key", key)


def object_counts(coordinates: DataFrame, key: str, column: str) -> DataFrame:
    """AGG-12: entries in all groups of a coordinates map, meta entries counted as the original counts them: (key, n)."""
    groups = F.map_values(F.from_json(column, "map<string,string>"))
    size = F.aggregate(F.transform(groups, lambda g: F.coalesce(F.json_array_length(g), F.size(F.json_object_keys(g)))), F.lit(0), lambda s, n: s + F.greatest(F.coalesce(n, F.lit(0)), F.lit(0)))
    return coordinates.select(key, F.coalesce(size, F.lit(0)).cast("long").alias("n"))


def categorised(marks: DataFrame) -> DataFrame:
    """GEO-09: placemarks as coordinate groups: (path, grp, pos, point_name, lat, lon).

    Points fall under Шурфы, Пункты фотофиксации or Центр объекта by their folders; shapes are catalogues of their own.
    """
    folder = F.lower(F.array_join("folders", "/"))
    grp = F.when(F.col("kind") != "Point", F.concat(F.lit("Каталог координат "), F.col("name"))).when(F.contains(folder, F.lit("шурф")), "Шурфы").when(F.contains(folder, F.lit("фотофиксаци")), "Пункты фотофиксации").otherwise("Центр объекта")
    opened = marks.select("path", grp.alias("grp"), "name", "kind", F.posexplode("coords").alias("pos", "c"))
    label = F.when(F.col("kind") == "Point", F.col("name")).otherwise((F.col("pos") + 1).cast("string"))
    return opened.select("path", "grp", "pos", label.alias("point_name"), F.col("c.lat").alias("lat"), F.col("c.lon").alias("lon"))


def first_points(marks: DataFrame) -> DataFrame:
    """SRC-13: the first coordinate of every placemark, all in one group."""
    return marks.where(F.size("coords") > 0).select("path", F.lit("Центр объекта").alias("grp"), F.col("name").alias("point_name"), F.col("coords")[0]["lat"].alias("lat"), F.col("coords")[0]["lon"].alias("lon"))


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """SRC-15, MAT-23: features of GeoJSON files by name, the last file (by path) winning: (name, geometry)."""
    raw = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.*json").select(F.input_file_name().alias("path"), "value")
    features = raw.select("path", F.posexplode(F.from_json(F.get_json_object("value", "$.features"), "array<string>")).alias("pos", "feature"))
    named = features.select("path", "pos", F.get_json_object("feature", "$.properties.name").alias("name"), F.get_json_object("feature", "$.geometry").alias("geometry"))
    return named.where("name is not null").groupBy("name").agg(F.max_by("geometry", F.struct("path", "pos")).alias("geometry"))


def _escaped(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


#: Colours (alpha, blue, green, red) of the four styles of a map.
STYLES = {"photos": "ff00ffff", "catalog": "ff0000ff", "pits": "ff00ff00", "center": "ffff0000"}


def kml_text(points: DataFrame, key: str, close: bool = True, chosen: DataFrame | None = None) -> DataFrame:
    """SNK-03, SNK-04: one KML document for each report: (key, kml), with its styles.

    points(key, grp, pos, point_name, lat, lon, style): groups without a style are left out; a catalogue also gets a
    polygon, its ring closed if `close`. chosen(key, grp, point_name): only these points are drawn.
    """
    if chosen is not None:
        points = points.join(chosen.select(key, "grp", "point_name").distinct(), [key, "grp", "point_name"], "left_semi")
    place = F.concat(F.col("lon").cast("string"), F.lit(","), F.col("lat").cast("string"), F.lit(",0"))
    drawn = points.where("style is not null").withColumn("_place", place)
    drawn = drawn.withColumn("_mark", F.concat(F.lit("<Placemark><name>"), _escaped(F.coalesce("point_name", F.lit(""))), F.lit("</name><styleUrl>#"), F.col("style"), F.lit("</styleUrl><Point><coordinates>"), F.col("_place"), F.lit("</coordinates></Point></Placemark>")))
    rows = F.sort_array(F.collect_list(F.struct("pos", "_place", "_mark")))
    groups = drawn.groupBy(key, "grp").agg(F.first("style").alias("style"), rows.alias("rows"))
    ring = F.transform("rows", lambda r: r["_place"])
    ring = F.when(F.size(ring) > 2, F.concat(ring, F.slice(ring, 1, 1))).otherwise(ring) if close else ring
    polygon = F.concat(F.lit("<Placemark><name>Полигон</name><styleUrl>#catalog</styleUrl><Polygon><outerBoundaryIs><LinearRing><coordinates>"), F.array_join(ring, " "), F.lit("</coordinates></LinearRing></outerBoundaryIs></Polygon></Placemark>"))
    body = F.concat(F.lit("<Folder><name>"), _escaped(F.col("grp")), F.lit("</name>"), F.when(F.col("style") == "catalog", polygon).otherwise(""), F.array_join(F.transform("rows", lambda r: r["_mark"]), ""), F.lit("</Folder>"))
    folders = groups.select(key, "grp", body.alias("_body"))
    documents = folders.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("grp", "_body"))), lambda g: g["_body"]), "").alias("_all"))
    return documents.select(key, F.concat(F.lit('<?xml version="1.0" encoding="UTF-8"?><kml xmlns="http://www.opengis.net/kml/2.2"><Document>' + "".join(f'<Style id="{n}"><IconStyle><color>{c}</color></IconStyle><LineStyle><color>{c}</color></LineStyle></Style>' for n, c in STYLES.items())), F.col("_all"), F.lit("</Document></kml>")).alias("kml"))


def kml_of_all(points: DataFrame, kind: str, key: str) -> DataFrame:
    """SNK-04: one KML document for each kind of report, a folder for each report: (kind, kml); rings stay open."""
    one = kml_text(points.withColumn("_both", F.concat_ws("|", kind, F.col(key).cast("string"))), "_both", close=False)
    inner = F.regexp_extract("kml", r"(?s)<Document>(?:<Style.*</Style>)?(.*)</Document>", 1)
    folder = F.concat(F.lit("<Folder><name>"), _escaped(F.regexp_extract("_both", r"\|(.*)$", 1)), F.lit("</name>"), inner, F.lit("</Folder>"))
    named = one.select(F.regexp_extract("_both", r"^([^|]*)\|", 1).alias(kind), "_both", folder.alias("_f"))
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_both", "_f"))), lambda r: r["_f"]), "")
    return named.groupBy(kind).agg(body.alias("_b")).select(kind, F.concat(F.lit('<?xml version="1.0" encoding="UTF-8"?><kml xmlns="http://www.opengis.net/kml/2.2"><Document><Folder><name>'), _escaped(F.col(kind)), F.lit("</name>"), F.col("_b"), F.lit("</Folder></Document></kml>")).alias("kml"))
