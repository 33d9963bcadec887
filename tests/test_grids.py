import io
import json
import os
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from barrow import session
from barrow.functions import geo, similarity
from barrow.operators import catalog, changes, extraction, grids, layout, matching, register, retrieval
from barrow.sources import files, kml, sinks
from barrow.streaming import crawl


def test_headed_and_sub_tables():
    assert grids.headed([["a", "", "a"], ["1", None, 2]]) == [{"a": "1", "column_2": "", "a_3": "2"}] and grids.headed([]) == []
    sheet = [["Каталог"], [], ["", "№", "X"], ["", "1", "5"], ["", None, ""], ["a", "b"] + [""] * 30 + ["outside"]]
    assert grids.sub_tables(sheet) == [[["№", "X"], ["1", "5"]], [["a", "b"]]]
    assert grids.sub_tables([]) == []


def test_systems():
    assert grids.systems_named("в МСК 167 и WGS-84; МСК-24, зона 4, мск-167") == ["мск167", "wgs84", "мск24зона4"]


def test_points_by_heading_value_part_and_system():
    cells = [["Участок", "№", "Широта", "Долгота"], ["А", "1", "55°30'00.0\" N", "92°15'00.0\" E"], ["", "2", "55°30'36.0\" S", "92°15'00.0\" W"], ["Б", "1.0", "55,25", "92,5"], ["", "итого", "", ""]]
    assert grids.points_of(cells) == [("Каталог координат [А]", "wgs84", "1", 55.5, 92.25), ("Каталог координат [А]", "wgs84", "2", -55.51, -92.25), ("Каталог координат [Б]", "wgs84", "1", 55.25, 92.5)]
    (x,), (y,) = geo.to_zone(geo.np.array([55.5]), geo.np.array([93.1]), "мск167")
    ((_, system, no, lat, lon),) = grids.points_of([["№", "X", "Y"], ["7", f"{y:.3f}", f"{x:.3f}"]], ["wgs84", "мск167"])
    assert (system, no) == ("мск167", "7") and abs(lat - 55.5) < 1e-7 and abs(lon - 93.1) < 1e-7
    assert grids.points_of([["№", "слой"], ["1", "песок"]]) == [] and grids.points_of([]) == []


def test_page_points():
    text = "Центр объекта 55°30'00.0\" с. ш., 92°15'00.0\" в. д.\nШурф № 1: N 55°30'36.0\" E 92°15'36.0\"\nВедомость"
    assert grids.page_points(text) == [("Центр объекта", 1, 55.5, 92.25), ("Шурфы", 1, 55.51, 92.26)]
    assert grids.page_points("") == [] == grids.page_points(None)


def test_executors():
    assert grids.executors([["ФИО", "Степень участия"], ["Иванов Иван Иванович, археолог", "раскопки"], ["прочие", "-"]]) == ["Иванов Иван Иванович: раскопки"]
    assert grids.executors([["Петров Пётр Петрович, эксперт", ""], ["Степень участия", "отчёт"]]) == ["Петров Пётр Петрович: отчёт"]
    assert grids.executors([]) == [] == grids.executors([["a", "b", "c"]])


def test_frames_with_nulls(spark):
    df = spark.createDataFrame([(1, [["№", "X", "Y"], ["1", "55,5", "92,5"]], None), (2, None, "МСК 167"), (3, [], "")], "id int, cells array<array<string>>, systems string")
    assert [tuple(r) for r in grids.table_points(df, "id").collect()] == [(1, "Каталог координат", "wgs84", "1", 55.5, 92.5)]
    assert grids.sheet_tables(df, "id").count() == 1 and grids.executor_names(df, "id").count() == 0 and grids.table_points(df.limit(0), "id").count() == 0


def test_contents_and_titles(spark):
    text = "Содержание\n1. Введение ........ 3\n2. Раскоп\n и находки ....... 5\nВВЕДЕНИЕ\nРаботы велись.\nПрочее\n"
    assert extraction.by_contents(text)[0][0] == "1. Введение" and extraction.by_contents(text)[0][1].startswith("Работы велись.")
    assert extraction.by_contents("нет") == [] and extraction.split_by_contents(spark.createDataFrame([(1, text), (2, None)], "id int, t string"), "id", "t").count() >= 1
    page = "Общество с ограниченной ответственностью «Курган»\nНаучный отчёт\nо разведке в г. Ачинск в 2019 году\nВыполнил: Иванов И. И.\nОткрытый лист № 123-2019\nплощадь 12,5 га\nКрасноярск, 2020"
    row = spark.createDataFrame([(page,)], "p string").select(*[c.alias(n) for n, c in extraction.report_title(F.col("p")).items()]).first()
    assert (row.town, row.author, row.permit, row.written, row.area) == ("Ачинск", "Иванов И. И.", "123-2019", "2020", "12,5 га") and "Курган" in row.organization and row.title.startswith("Научный отчёт о разведке")


def test_sizes_and_act_fields(spark):
    row = spark.createDataFrame([("Общая площадь участка 12,5 га, протяжённость трассы 3 км. Площадь раскопа 40 кв. м",)], "t string").select(*[c.alias(n) for n, c in extraction.object_sizes(F.col("t")).items()]).first()
    assert (row.total, row.length, row.linear, row.reserve) == ("12,5 га", "3 км", None, ["40 кв. м"])
    sections = spark.createDataFrame([(1, "place", ": г. Ачинск –"), (1, "expert", "Иванов Иван Иванович, Петров П. П., Иванов Иван Иванович"), (1, "object", "земельный участок"), (1, "documents", "Открытый лист № 5-2020")], "doc_id int, section string, body string")
    assert tuple(extraction.act_fields(sections).first()) == (1, "г. Ачинск", "", "Иванов Иван Иванович;\nПетров П. П.", "ЗУ", "5-2020")


def test_catalog(spark):
    assert len(catalog.NAMED_KEYS) == 39 == len(set(catalog.NAMED_KEYS)) and len(catalog.SHAPES) == 14
    df = spark.createDataFrame([(1, 5, True, None, False), (2, 5, False, "x", None), (3, 6, None, "y", True)], "id int, user_id int, is_public boolean, name string, is_excluded boolean")
    ids = lambda d: sorted(r.id for r in d.collect())
    assert ids(catalog.named(df, {})) == [1, 2, 3] and ids(catalog.named(df, {"name": "X"})) == [2] and ids(catalog.named(df, {"storage_type": "private"}, 5)) == [2]
    assert ids(catalog.named(df, {"storage_type": "private"})) == [1, 2, 3] and ids(catalog.named(df, {"show_excluded": False})) == [1, 2]
    assert catalog.shape(df, "geojson").columns == ["id", "name", "geojson"] and catalog.shape(df, "chat").first()["user"] == 5


def test_pages_and_lookup(spark):
    assert register.page_info(0, 9) == {"number": 1, "start": 0, "length": 100, "total_pages": 1, "has_next": False, "has_previous": False}
    assert register.page_info(201, 2)["has_next"] and register.page_info(201, 3)["total_pages"] == 3
    df = spark.createDataFrame([(i,) for i in (3, 1, 2)], "id int")
    assert [(r.id, r.page, r.has_next) for r in register.numbered_pages(df, "id", 2).orderBy("id").collect()] == [(1, 1, True), (2, 1, True), (3, 2, False)]
    assert register.found(df, "id", 2) == {"id": 2} and register.numbered_pages(df.limit(0), "id").count() == 0
    with pytest.raises(LookupError):
        register.found(df, "id", 9)


def test_changes(spark):
    rows = spark.createDataFrame([(1, '[{"path": "x"}]'), (2, None), (3, "bad")], "id int, source string")
    more = spark.createDataFrame([(1, '{"path": "y"}'), (2, '{"path": "z"}')], "id int, element string")
    got = {r.id: r.source for r in changes.appended(rows, "id", "source", more).collect()}
    assert json.loads(got[1]) == [{"path": "x"}, {"path": "y"}] and json.loads(got[2]) == [{"path": "z"}] and got[3] == "bad"
    maps = spark.createDataFrame([({"a": 1, "b": 2}, {"b": 3}), (None, {"b": 3}), ({"a": 1}, None)], "x map<string,int>, y map<string,int>")
    assert [r.m for r in maps.select(changes.merged(F.col("x"), F.col("y")).alias("m")).collect()] == [{"a": 1, "b": 3}, {"b": 3}, {"a": 1}]


def test_readings(spark):
    df = spark.createDataFrame([("на участке территории", "x" * 60), ("объект", "xyz"), (None, None)], "a string, b string")
    assert [r[0] for r in df.select(similarity.better_reading(F.col("a"), F.col("b"))).collect()] == ["x" * 60, "объект", ""]
    kinds = spark.createDataFrame([("археологические раскопки",), ("",), (None,)], "t string").select(similarity.work_kind(F.col("t"))).collect()
    assert [r[0] for r in kinds] == ["раскопки", None, None]
    names = spark.createDataFrame([("Проверка подписи.PDF",), ("акт.pdf",), ("акт.doc",), (None,)], "n string")
    assert [r[0] for r in names.select(files.is_document(F.col("n"))).collect()] == [False, True, False, False]


def test_archives_and_counts(spark):
    body = io.BytesIO()
    with zipfile.ZipFile(body, "w") as z:
        z.writestr("doc.kml", "<kml><Placemark><name>a</name><Point><coordinates>92,55</coordinates></Point></Placemark></kml>")
        z.writestr("files/photo.jpg", b"x")
    df = spark.createDataFrame([(1, bytearray(body.getvalue())), (2, bytearray(b"no")), (3, None)], "id int, body binary")
    assert sorted(r["name"] for r in kml.members(df, "id", "body").collect()) == ["doc.kml", "files/photo.jpg"]
    assert [(r.id, r["name"]) for r in kml.placemarks_of(df, "id", "body").collect()] == [(1, "a")]
    cards = spark.createDataFrame([(1, '{"a": {"coordinate_system": "wgs84", "1": [1, 2]}, "b": {"1": [1, 2]}}'), (2, None)], "id int, c string")
    assert {r.id: r.n for r in kml.object_counts(cards, "id", "c").collect()} == {1: 3, 2: 0}


def test_uncrossed(spark):
    df = spark.createDataFrame([([(0.0, 0.0), (0.0, 1.0), (1.0, 0.0), (1.0, 1.0)],), ([(0.0, 0.0), (0.0, 1.0), (1.0, 1.0), (1.0, 0.0)],), ([(0.0, 0.0)],)], "r array<struct<lat:double,lon:double>>")
    got = [[tuple(p) for p in r[0]] for r in df.select(geo.uncrossed(F.col("r"))).collect()]
    assert got[0] == [(0, 0), (0, 1), (1, 1), (1, 0)] == got[1] and got[2] == [(0, 0)]


def test_sheet_headers_and_widths(spark, tmp_path):
    path = str(tmp_path / "a.xlsx")
    assert sinks.write_xlsx(spark.createDataFrame([(1, None)], "id int, name string"), path, headers={"name": "Название"}, widths={"name": 40}) == 1
    with zipfile.ZipFile(path) as z:
        sheet = z.read("xl/worksheets/sheet1.xml").decode()
    assert "Название" in sheet and 'width="40"' in sheet and sheet.index("<cols>") < sheet.index("<sheetData>")


def test_cumulative_crawl(spark, tmp_path):
    schema = "title string, href string"
    known = spark.createDataFrame([], "file_name string")
    for n in (1, 2):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{n}.json").write_text(json.dumps({"title": "Акт ГИКЭ 01.02.2015", "href": f"/upload/{n}.pdf"}) + "\n" + json.dumps({"title": "x", "href": ""}) + "\n")
        q = crawl.cumulative(spark, str(tmp_path / "in"), schema, known, str(tmp_path / "states"), str(tmp_path / "cp"), excluded=[], start="2012-01-01", end="2022-12-31")
        q.awaitTermination(120)
    told = crawl.progress(spark, str(tmp_path / "states")).orderBy("batch").collect()
    assert [(r.total, r.queued, r.skipped) for r in told] == [(2, 1, 1), (4, 2, 2)]


def test_cut_tables_are_discarded(spark):
    df = session.cut(spark.range(5))
    path = df.inputFiles()[0].removeprefix("file:")
    assert os.path.exists(path) and session.discard(spark) >= 1 and not os.path.exists(path) and session.discard(spark) == 0


def test_once(spark, tmp_path):
    spark.createDataFrame([(1, "a"), (1, "a"), (2, "b"), (None, "c"), (None, "c")], "id int, t string").repartition(3).write.parquet(str(tmp_path / "x.parquet"))
    assert sorted(map(str, ((r.id, r.t) for r in session.once(spark, str(tmp_path), "x", ["id"], ["t"]).collect()))) == ["(1, 'a')", "(2, 'b')", "(None, 'c')"]


def test_numbered_and_upserted(spark):
    df = spark.createDataFrame([("a", 3), ("a", 1), ("b", 2), (None, 5), ("a", 2)], "chat string, at int")
    assert sorted((str(r.chat), r.at, r.place) for r in retrieval.numbered(df, "chat", ["at"]).collect()) == [("None", 5, 1), ("a", 1, 1), ("a", 2, 2), ("a", 3, 3), ("b", 2, 1)]
    assert retrieval.numbered(df.limit(0), "chat", ["at"]).count() == 0
    pdfs = spark.createDataFrame([("/a/akt.pdf",), ("/b/x.pdf",)], "path string")
    kmls = spark.createDataFrame([("/a/akt_points.kml",), ("/b/other.kml",)], "path string")
    assert [tuple(r) for r in layout.companions_by_part(pdfs, kmls).collect()] == [("/a/akt.pdf", "/a/akt_points.kml")]


def test_files(spark):
    stored = spark.createDataFrame([("h",)], "file_hash string")
    with pytest.raises(ValueError):
        matching.refuse_duplicates(stored, stored)
    assert matching.refuse_duplicates(spark.createDataFrame([(None,), ("g",)], "file_hash string"), stored).count() == 2
    lists = spark.createDataFrame([("a", "1"), ("b", "2")], "prefix string, path string")
    assert sorted(map(tuple, files.manifest_updated(lists, "b", "3").collect())) == [("a", "1"), ("b", "3")]


def test_vector_search_against_brute_force(spark, monkeypatch):
    draw = np.random.default_rng(5)
    rows = [(i, [float(x) for x in draw.integers(-2, 3, 4)]) for i in range(300)] + [(900, None), (901, []), (902, [0.0] * 4), (903, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "k int, v array<double>").repartition(7)
    asking = spark.createDataFrame(rows[:5] + rows[-1:], "query_id int, vector array<double>")
    want = set()
    for q, v in rows[:5] + rows[-1:]:
        found = [(-round(float(np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w)), 9), k) for k, w in rows if w and len(w) == len(v) and np.linalg.norm(w) and np.linalg.norm(v)]
        want |= {(q, k, r) for r, (_, k) in enumerate(sorted(found)[:3], 1)}
    for size in (64 << 20, 64):
        monkeypatch.setattr(retrieval, "QUERY_BYTES", size)
        assert {(r.query_id, r.k, r["rank"]) for r in retrieval.top_k(df, asking, "k", "v", 3).collect()} == want


def test_cached_tables_grow_old(spark):
    made = []

    def build():
        made.append(1)
        return spark.range(3)

    assert session.cached("t", build).count() == session.cached("t", build).count() == 3 and len(made) == 1
    assert session.cached("t", build, seconds=-1).count() == 3 and len(made) == 2
    session.discard(spark)
    assert session.cached("t", build).count() == 3 and len(made) == 3
