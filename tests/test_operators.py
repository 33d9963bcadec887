import math
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from barrow.functions import similarity
from barrow.operators import changes, extraction, layout, matching, register, retrieval, spatial
from barrow.operators.register import Register, Request
from barrow.plans import queries
from barrow.sources import files, kml, sinks
from barrow.streaming import crawl


def test_register_edges(spark):
    reg = Register(columns=("id", "a", "b"), searchable=("a", "b"), orderable=("a",), named={"a": ("a",)})
    df = spark.createDataFrame([(1, "X%", None), (2, None, "x"), (3, "y", "z")], "id int, a string, b string")
    ids = lambda d: [r.id for r in d.orderBy("id").collect()]
    assert ids(register.global_search(df, reg.searchable, "x")) == [1, 2]
    assert ids(register.global_search(df, reg.searchable, "%")) == [1]
    assert ids(register.column_search(df, reg, {"1": "Y", "no": "q", "9": "q", "0": "q"})) == [3]
    assert [r.id for r in register.ordered(df, reg, Request(order="a"), "id").collect()] == [1, 3, 2]
    assert [r.id for r in register.ordered(df, reg, Request(order="a", descending=True), "id").collect()] == [2, 3, 1]
    assert [r.id for r in register.respond(df, reg, Request(order="b", start=1, length=1), "id").collect()] == [2]
    assert tuple(register.counts(df, reg, Request(search="x")).first()) == (3, 2)
    assert tuple(register.counts(df.limit(0), reg, Request(search="x")).first()) == (0, 0)
    assert ids(register.not_in(df, "a", ["y"])) == [1, 2]


def test_flat_points_and_rings(spark):
    df = spark.createDataFrame([(1, '{"Каталог": {"coordinate_system": "wgs84", "area": 5, "b": [1, 2], "a": [3, 4], "bad": [1]}}'), (2, None), (3, "{oops")], "id int, coordinates string")
    points = register.coordinate_points(df, "id")
    assert [tuple(r)[1:] for r in points.orderBy("pos").select("id", "grp", "coord_system", "point_name", "lat", "lon").collect()] == [("Каталог", "wgs84", "b", 1.0, 2.0), ("Каталог", "wgs84", "a", 3.0, 4.0)]
    assert [tuple(p) for p in register.rings(points, "id").first()["ring"]] == [(1.0, 2.0), (3.0, 4.0)]


def test_best_match_rules(spark):
    cols = "id int, year string, finish_date string, expert string, name_number string, place string, customer string, area string, executioner string, open_list string, conclusion string, border_objects string"
    row = lambda i, y, d="15.05.2023", e="Иванов И.И.", n="Акт 1": (i, y, d, e, n, "г. Москва", None, "nan", "", None, None, None)
    registry = spark.createDataFrame([row(10, "2023.0"), row(11, "2024"), row(12, None, "01.01.2000", "Петров П.П.", "x")], cols)
    found = lambda rows, **k: {r.id: r.registry_id for r in matching.best_matches(spark.createDataFrame(rows, cols), registry, "id", "id", **k).collect()}
    assert found([row(1, "2023"), row(2, "2024"), row(3, "2022"), row(4, "")]) == {1: 10, 2: 11, 4: 10}
    assert found([row(5, "2023", "31.12.1999", "Сидоров", "другое")]) == {} and found([row(5, "2023", "31.12.1999", "Сидоров", "другое")], strict=False)[5] in (10, 12)
    assert matching.best_matches(registry.limit(0), registry, "id", "id").count() == 0


MATCHED = "id int, user_id int, year string, finish_date string, expert string, name_number string, place string, customer string, area string, executioner string, open_list string, conclusion string, border_objects string"


def test_best_match_query_takes_undated_acts(spark, tmp_path):
    row = lambda i, u, y, d="15.05.2023", e="Иванов И.И.", c="Заказчик": (i, u, y, d, e, f"Акт {c}", "г. Москва", c, None, "", None, None, None)
    # 1: no year meets all years. 2: the like one has no year. 3: the best has no date, so its date disagrees.
    acts = [row(1, 1, None), row(2, 1, "2022", c="Дорога"), row(3, 1, "2021", c="Мост", d="01.02.2021"), row(10, 2, "2023"), row(11, 2, "nan", c="Дорога"), row(12, 2, "2021", c="Мост", d=""), row(13, 2, "2021", c="Мосты", d="01.02.2021", e="Иванов И.К.")]
    spark.createDataFrame(acts, MATCHED).write.parquet(f"{tmp_path}/acts.parquet")
    spark.createDataFrame([(1, True), (2, False)], "id int, is_superuser boolean").write.parquet(f"{tmp_path}/users.parquet")
    got = {r.id: r.registry_id for r in queries.QUERIES["fuzzy_best_match"](spark, str(tmp_path)).collect()}
    assert got == {1: 10, 2: 11}


def test_best_match_bounds_lose_nothing(spark):
    draw = random.Random(3)
    word = lambda: "".join(draw.choices("абвг  ", k=draw.randint(0, 6)))
    rows = [(i, 0, draw.choice(["2020", "2021", "", None]), *[draw.choice([None, "nan", "аба", word(), word()]) for _ in matching.WEIGHTS]) for i in range(90)]
    a, b = spark.createDataFrame(rows[:30], MATCHED), spark.createDataFrame(rows[30:], MATCHED)
    got = {tuple(r) for r in matching.best_matches(a, b, "id", "id", least=0.6).collect()}
    date, expert = MATCHED.split(", ").index("finish_date string"), MATCHED.split(", ").index("expert string")
    loose = matching.best_matches(a, b, "id", "id", strict=False).collect()
    ratio = lambda x, y: 0.0 if {(x or "").strip(), (y or "").strip()} & {"", "nan"} else similarity._ratio(x.strip(), y.strip(), True)
    least = lambda r: max(0.5, 0.6 - 0.05 * sum((r[k] or "").strip() in ("", "nan") for k in (date, expert)))
    want = {tuple(m) for m in loose if m.similarity >= least(rows[m.id]) and all(ratio(rows[m.id][k], rows[m.registry_id][k]) >= 0.7 for k in (date, expert))}
    assert got == want and want


def test_suffixes_duplicates_and_neighbours(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "i int, k string")
    assert {r.i: r.key_name for r in matching.suffixed(df, ["k"], "i").collect()} == {1: "a", 2: "a_1", 3: "b"}
    assert [tuple(r) for r in matching.duplicates(df, "k", "i").collect()] == [("a", 1, 2)]
    a = spark.createDataFrame([(1, 55.0, 92.0), (2, 56.0, 92.0)], "a_id int, lat double, lon double")
    b = spark.createDataFrame([(7, 55.0 + 9e-7, 92.0 - 9e-7), (8, 55.0 + 2e-6, 92.0)], "b_id int, lat double, lon double")
    assert [tuple(r) for r in matching.nearby(a, b).collect()] == [(1, 7)]


def test_spatial_against_brute_force(spark):
    import random

    draw = random.Random(4)
    polygons = [(i, [(55 + draw.random(), 92 + draw.random()) for _ in range(4)]) for i in range(12)]
    points = [(i, 55 + draw.random(), 92 + draw.random()) for i in range(60)]

    def holds(ring, lat, lon):
        return sum((p[0] > lat) != (q[0] > lat) and lon < (q[1] - p[1]) * (lat - p[0]) / (q[0] - p[0]) + p[1] for p, q in zip(ring, ring[1:] + ring[:1], strict=True)) % 2 == 1

    want = {(p, g) for p, lat, lon in points for g, ring in polygons if holds(ring, lat, lon)}
    pdf = spark.createDataFrame(points, "point_id int, lat double, lon double")
    gdf = spark.createDataFrame(polygons, "polygon_id int, ring array<struct<lat:double,lon:double>>")
    assert {tuple(r) for r in spatial.points_in_polygons(pdf, gdf).collect()} == want
    shapes = pdf.select(F.col("point_id").alias("shape_id"), F.array(F.struct("lat", "lon")).alias("ring"))
    targets = spark.createDataFrame([(109, [(55.5, 92.5)]), (108, [(55.5, 92.5)])], "target_id int, ring array<struct<lat:double,lon:double>>")
    assert {r.target_id for r in spatial.nearest(shapes, targets).collect()} == {108}


RING = "ring array<struct<lat:double,lon:double>>"


def sides(ring):
    return [(ring[0], ring[0])] if len(ring) == 1 else [(ring[0], ring[1])] if len(ring) == 2 else list(zip(ring, ring[1:] + ring[:1], strict=True))


def km(a, b):
    h = math.sin(math.radians(b[0] - a[0]) / 2) ** 2 + math.cos(math.radians(a[0])) * math.cos(math.radians(b[0])) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * 6371.0088 * math.asin(math.sqrt(min(1.0, h)))


def side_km(x, y):
    shrink = math.cos(math.radians((x[0][0] + y[0][0]) / 2))

    def to(p, s):
        dy, dx = s[1][0] - s[0][0], (s[1][1] - s[0][1]) * shrink
        size = dy * dy + dx * dx
        t = max(0.0, min(1.0, ((p[0] - s[0][0]) * dy + (p[1] - s[0][1]) * shrink * dx) / size)) if size else 0.0
        return km(p, (s[0][0] + t * (s[1][0] - s[0][0]), s[0][1] + t * (s[1][1] - s[0][1])))

    turn = lambda a, b, c: (c[1] - a[1]) * (b[0] - a[0]) > (b[1] - a[1]) * (c[0] - a[0])
    if turn(x[0], y[0], y[1]) != turn(x[1], y[0], y[1]) and turn(x[0], x[1], y[0]) != turn(x[0], x[1], y[1]):
        return 0.0
    return min(to(x[0], y), to(x[1], y), to(y[0], x), to(y[1], x))


@pytest.mark.parametrize("lat0,spread", [(55.0, 0.02), (75.0, 3.0), (-81.0, 1.0), (10.0, 60.0)])
def test_nearest_against_brute_force(spark, lat0, spread):
    """Points, lines and rings near and far, at high latitudes too; every shape has its nearest, none is out of reach."""
    draw = random.Random(int(lat0))
    shapes = []
    for i in range(40):
        y, x = lat0 + draw.uniform(-spread, spread) / 4, 90 + draw.uniform(-spread, spread)
        shapes.append((i, [(y + draw.uniform(-0.004, 0.004), x + draw.uniform(-0.01, 0.01)) for _ in range(draw.choice((1, 2, 4)))]))
    shapes += [(100, [(lat0 - 4, 140.0)]), (101, []), (102, shapes[0][1])]
    df = spark.createDataFrame(shapes, f"shape_id int, {RING}")
    got = {r.shape_id: (r.target_id, r.km) for r in spatial.nearest(df, df.withColumnRenamed("shape_id", "target_id")).collect()}
    inside = lambda ring, p: len(ring) > 2 and sum((a[0] > p[0]) != (b[0] > p[0]) and p[1] < (b[1] - a[1]) * (p[0] - a[0]) / (b[0] - a[0]) + a[1] for a, b in sides(ring)) % 2 == 1
    want = {}
    for i, ring in shapes:
        far = [(0.0 if inside(r, ring[0]) or inside(ring, r[0]) else round(min(side_km(x, y) for x in sides(ring) for y in sides(r)), 6), j) for j, r in shapes if i != j and r and ring]
        if far:
            want[i] = min(far)[::-1]
    assert set(got) == set(want)
    assert all(abs(got[i][1] - want[i][1]) < 2e-6 for i in want) and sum(got[i][0] == want[i][0] for i in want) >= len(want) - 1


def test_proximity(spark):
    cards = spark.createDataFrame([(1, [(55.0, 90.0)]), (1, [(55.0, 91.0)]), (2, [(55.5, 90.0), (55.5, 92.0)]), (3, [(54.0, 89.0), (54.0, 93.0), (57.0, 93.0), (57.0, 89.0)]), (4, [])], f"card_id int, {RING}")
    offer = spark.createDataFrame([([(55.0, 91.5)],)], RING)
    got = {r.card_id: r.km for r in spatial.proximity(offer, cards).collect()}
    assert set(got) == {1, 2, 3} and got[3] == 0.0
    assert abs(got[1] - km((55.0, 91.5), (55.0, 91.0))) < 1e-5 and abs(got[2] - km((55.0, 91.5), (55.5, 91.5))) < 1e-5


def test_layout(spark):
    blocks = spark.createDataFrame([(1, 1, 0.0, 10.0, 5.0, 20.0), (1, 2, 0.0, 300.0, 5.0, 310.0), (2, 3, 0.0, 0.0, 5.0, 5.0)], "page int, block_id int, x1 double, y1 double, x2 double, y2 double")
    heads = spark.createDataFrame([(1, "A", 50.0, 12.0, 60.0, 18.0), (1, "B", 10.0, 0.0, 20.0, 15.0), (1, "C", 0.0, 200.0, 5.0, 220.0)], "page int, section string, x1 double, y1 double, x2 double, y2 double")
    assert {r.block_id: r.section for r in layout.sections_of_blocks(blocks, heads).collect()} == {1: "B", 2: "C", 3: "UNKNOWN"}
    images = spark.createDataFrame([(1, 1, 0.0, 0.0, 100.0, 100.0)], "page int, image_id int, x1 double, y1 double, x2 double, y2 double")
    captions = spark.createDataFrame([(1, 5, 80.0, 110.0, 200.0, 120.0), (1, 6, 50.0, 200.0, 200.0, 210.0)], "page int, caption_id int, x1 double, y1 double, x2 double, y2 double")
    assert layout.captions_of_images(images, captions).first()["caption_id"] == 6
    boxes = spark.createDataFrame([(1, 1, 50.0, 10.0, 20.0), (1, 2, 0.0, 15.0, 20.0), (1, 3, 0.0, 90.0, 5.0)], "page long, box_id long, x double, y double, h double")
    assert [r.box_id for r in layout.reading_order(boxes).orderBy("place").collect()] == [2, 1, 3]
    pdfs = spark.createDataFrame([("/a/b/act.pdf",), ("/a/c/other.pdf",)], "path string")
    kmls = spark.createDataFrame([("/a/b/act.kml",), ("/a/b/x.kml",), ("/a/c/z.kmz",)], "path string")
    assert {r.pdf: r.kml for r in layout.companions(pdfs, kmls).collect()} == {"/a/b/act.pdf": "/a/b/act.kml", "/a/c/other.pdf": "/a/c/z.kmz"}


def test_changes(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id int, v string")
    assert [r.v for r in changes.updated(df, F.col("v") == "a", {"v": F.lit("z")}).orderBy("id").collect()] == ["z", None]
    assert [r.id for r in changes.deleted(df, F.col("v") == "a").collect()] == [2]
    assert {r.id: r.v for r in changes.assigned(df, spark.createDataFrame([(2, "n")], "id int, v string"), "id", ["v"]).collect()} == {1: "a", 2: "n"}
    got = changes.inserted(df.withColumn("id", F.col("id").cast("long")), spark.createDataFrame([("x",), ("y",)], "v string"), "id")
    assert got.count() == 4 and got.select("id").distinct().count() == 4 and got.where("v = 'x'").first()["id"] > 2
    dead = spark.createDataFrame([(1,)], "uid int")
    child = spark.createDataFrame([(5, 1), (6, 2)], "c int, user_id int")
    assert [r.c for r in changes.cascade(child, dead, "user_id", "uid").collect()] == [6]
    assert {r.c: r.user_id for r in changes.nulled(child, dead, "user_id", "uid").collect()} == {5: None, 6: 2}


def test_extraction(spark):
    pages = spark.createDataFrame([(1, 2, "продолжение\nВывод экспертизы: положительный"), (1, 1, "Акт\n1. Дата начала: 1 мая\nЗаказчик экспертизы: ООО"), (2, 1, "без заголовков")], "doc_id int, page_no int, text string")
    got = {r.section: r.body for r in extraction.sections(pages).collect()}
    assert got == {"start_date": "1 мая", "customer": "ООО\nпродолжение", "conclusion": "положительный"}
    assert extraction.contents("Введение ........ 3\nГлава 1 _____ 14\nпросто") == [("Введение", 3), ("Глава 1", 14)]
    assert extraction.decimal_degrees("55°45'30.75\"S") == -55.758541666700004 or extraction.decimal_degrees("55°45'30.75\"S") == pytest.approx(-55.7585416667)
    grids = spark.createDataFrame([(1, [["№", "Северная широта", "Восточная долгота"], ["1", "55°45'30\"", "92°30'15\""], ["2", "55°45'31\"", "92°30'16\""]]), (2, [["А", "Б"], ["в", "г"]])], "id int, cells array<array<string>>")
    assert [r.flag for r in grids.orderBy("id").select(extraction.is_coordinate_table(F.col("cells")).alias("flag")).collect()] == [True, False]
    assert [(r.point_name, r.lat, r.lon) for r in extraction.grid_points(grids, "id").orderBy("pos").collect()] == [("1", 55.7583333333, 92.5041666667), ("2", 55.7586111111, 92.5044444444)]
    typed = spark.createDataFrame([("a; 1,5; 2\nмусор\nb;x;1",)], "t string").select(extraction.typed_points(F.col("t")).alias("p")).first()["p"]
    assert [tuple(p) for p in typed] == [("a", 1.5, 2.0)]


@pytest.mark.parametrize("given", ["", "слово", "a" * 2000, "раз два " * 400, ("абзац один. " * 30 + "\n\n") * 8, "\n\n\n"])
def test_chunks_cover_and_fit(given):
    out = extraction.split_recursive(given)
    assert all(len(c) <= 750 and given[a : a + len(c)] == c for a, c in out)
    covered = set()
    for a, c in out:
        covered |= set(range(a, a + len(c)))
    assert all(given[k].isspace() for k in set(range(len(given))) - covered)


def test_retrieval(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 1.0]), (3, [0.0, 1.0]), (4, []), (5, None)], "id int, e array<float>")
    q = spark.createDataFrame([(0, [1.0, 0.0]), (9, [1.0])], "query_id int, vector array<float>")
    assert [(r.id, r["rank"]) for r in retrieval.top_k(v, q, "id", "e", 2).orderBy("rank").collect()] == [(1, 1), (2, 2)]
    assert retrieval.top_k(v.limit(0), q, "id", "e", 2).count() == 0
    for bad in ("drop table x", "select 1; select 2", "with a as (select 1) insert into b select * from a", ""):
        with pytest.raises(ValueError):
            retrieval.run_sql(spark, bad)
    assert retrieval.run_sql(spark, "select 'drop' as w").first()["w"] == "drop"
    m = spark.createDataFrame([(1, "me", 1), (1, "ai", 2), (1, "me", 3), (1, "ai", 4)], "chat int, sender string, n int")
    assert sorted(r.n for r in retrieval.without_last_exchange(m, "chat", "sender", "n").collect()) == [1, 2]


KML = """<?xml version="1.0"?><kml xmlns="http://www.opengis.net/kml/2.2"><Document><Folder><name>Шурфы</name><Placemark><name>1</name><Point><coordinates>92.5,55.7,0</coordinates></Point></Placemark></Folder>
<Placemark><name>Участок</name><Polygon><outerBoundaryIs><LinearRing><coordinates>92,55 93,55 93,56 92,55</coordinates></LinearRing></outerBoundaryIs></Polygon></Placemark></Document></kml>"""


def test_kml_and_kmz(spark, tmp_path):
    (tmp_path / "a.kml").write_text(KML, encoding="utf-8")
    with zipfile.ZipFile(tmp_path / "b.kmz", "w") as z:
        z.writestr("doc.kml", KML)
    (tmp_path / "bad.kml").write_text("<kml><oops")
    marks = kml.read_kml(spark, str(tmp_path))
    got = kml.categorised(marks)
    assert got.groupBy("grp").count().orderBy("grp").collect() == [("Каталог координат Участок", 6), ("Шурфы", 2)]
    assert kml.first_points(marks).count() == 4
    drawn = got.where("path like '%a.kml'").withColumn("style", register.group_style(F.col("grp")))
    assert "Полигон" in kml.kml_text(drawn, "path").first()["kml"]


def test_office_files_and_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "а <b>"), (2, None)], "id int, v string")
    assert sinks.write_xlsx(df, str(tmp_path / "r.xlsx")) == 2
    assert files.xlsx_grid((tmp_path / "r.xlsx").read_bytes()) == [["id", "v"], ["1", "а <b>"], ["2", ""]]
    assert files.xlsx_grid(b"no zip") == [] and files.docx_tables(b"no zip") == []
    assert files.page_count(b"%PDF-1.4 /Type /Pages /Type /Page /Type/Page") == 2 and files.page_count(b"?") is None
    assert files.links('<a href="/x/акт.pdf">Акт <b>1</b></a>') == [("Акт 1", "/x/акт.pdf")]
    lines = spark.createDataFrame([("oan - a.docx", 1), ("oan - b.docx", 2), ("без черты", 3)], "value string, line_no int")
    assert [tuple(r) for r in files.manifest(lines).collect()] == [("oan", "b.docx")]
    found = spark.createDataFrame([("/a/x.pdf",), ("/a/~x.pdf",), ("/a/Приказ.pdf",), ("/a/y.PDF",)], "path string")
    assert [r.path for r in files.discovered(found, [".pdf"], 1).collect()] == ["/a/x.pdf"]


def test_crawl_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.json").write_text('{"title": "Акт от 01.02.2020", "href": "/upload/акт.pdf"}\n{"title": "Акт", "href": "/upload/x.pdf"}\n', encoding="utf-8")
    seen = []
    known = spark.createDataFrame([], "file_name string")
    q = crawl.crawl(spark, str(tmp_path / "in"), "title string, href string", known, lambda c, n: seen.append(tuple(c.first())), str(tmp_path / "cp"), excluded=[], start="2019-01-01", end="2021-01-01")
    q.awaitTermination()
    assert seen == [(2, 0, 1, 1, 0)] and crawl.state(q) == "SUCCESS"
