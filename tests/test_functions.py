import numpy as np
import pytest
from pyspark.sql import functions as F

from barrow.functions import geo, similarity, text


def one(spark, value, make, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(make(F.col("v")).alias("r")).first()["r"]


@pytest.mark.parametrize(("value", "want"), [("2023-04-29 00:00:00", "29.04.2023"), ("1.2.2023", "1.2.2023"), ("nan", ""), (None, ""), ("май", "май")])
def test_dotted_date(spark, value, want):
    assert one(spark, value, text.dotted_date) == want


@pytest.mark.parametrize(("value", "want"), [("2023.0", "2023"), ("2024", "2024"), (None, ""), ("nan", "")])
def test_year(spark, value, want):
    assert one(spark, value, text.year) == want


@pytest.mark.parametrize(("value", "want"), [("«1» января 2023", True), ("15 марта 2024", True), ("01.01.2023", False), ("32 января 2023", False), (None, False), ("1 мая 1979", False)])
def test_worded_date(spark, value, want):
    assert one(spark, value, text.is_worded_date) is want


@pytest.mark.parametrize(("value", "want"), [("«1» января 2023", "01.01.2023"), ("15 марта 2024", "15.03.2024"), ("15 мрта 2024", "15.03.2024"), ("", "-.-.-"), (None, None)])
def test_date_to_dots(spark, value, want):
    assert one(spark, value, text.date_to_dots) == want


@pytest.mark.parametrize(("make", "value", "want"), [(text.scanned_date, "20242.", "2024  г."), (text.scanned_date, "2924", "2024"), (text.scanned_date, "1/1/2024", "11112024"), (text.scanned_list_number, "о123", "0123"), (text.scanned_list_number, "З456", "3456"), (text.scanned_number, "1/2", "112"), (text.scanned_string, " =a|b_@ ", "abа")])
def test_scanner_confusions(spark, make, value, want):
    assert one(spark, value, make) == want


def test_citation_and_file_name(spark):
    got = spark.createDataFrame([("Приказ от 01.01.2024 № 123-45",)], "v string").select(*[c.alias(n) for n, c in text.citation(F.col("v")).items()]).first()
    assert tuple(got) == ("Приказ", "№ 123-45", "01.01.2024")
    got = spark.createDataFrame([("15.05.2023 Иванов И.И., г.Москва.pdf",)], "v string").select(*[c.alias(n) for n, c in text.file_parts(F.col("v")).items()]).first()
    assert tuple(got) == ("15.05.2023", "2023", "Иванов И.И.", "г.Москва", "")
    assert one(spark, "ЗУ_акт.pdf", lambda c: text.file_parts(c)["file_kind"]) == "ЗУ"


def test_captions(spark):
    got = spark.createDataFrame([("Рис. 12. Шурф № 3. Вид с юга",), ("Рисунок 5 - Карта района",), ("просто текст",), (None,)], "v string").select(*[c.alias(n) for n, c in text.caption_parts(F.col("v")).items()]).collect()
    assert [r["caption_no"] for r in got] == [12, 5, None, None]
    assert [r["category"] for r in got] == ["pits_fotos", "maps", None, None]


def test_figures(spark):
    assert one(spark, "см. Рис. 1-3; 7, и рисунок 9", text.figure_numbers) == [1, 2, 3, 7, 9]
    assert one(spark, "нет", text.figure_numbers) == []


def test_search_is_literal_and_folds_cyrillic(spark):
    assert one(spark, "ШУРФ 100%", lambda c: text.icontains(c, "шурф 100%"))
    assert not one(spark, "шурф 1000", lambda c: text.icontains(c, "шурф 100%"))
    assert one(spark, None, lambda c: text.icontains(c, "x")) is False


def test_names(spark):
    assert one(spark, " Отчёт: №1/2. ", text.path_component) == "Отчт 12"
    assert one(spark, "a<b>  c__d", lambda c: text.file_name(c, 5)) == "a_b"
    assert one(spark, "Отчёт_текст.pdf", text.file_role) == "text" and one(spark, "x.pdf", text.file_role) == "all"
    assert one(spark, "/upload/iblock/а (1).pdf", lambda c: text.download_url("https://x.example", c)) == "https://x.example/upload/iblock/%D0%B0%20(1).pdf"


@pytest.mark.parametrize(("value", "want"), [("55°45'30\"", 55.7583333333), ("55°45'30\"S", -55.7583333333), ("55°45'", None), ("", None), (None, None), ("92°30'15,5\"", 92.5043055556)])
def test_dms(spark, value, want):
    got = one(spark, value, geo.dms)
    assert got == pytest.approx(want) if want is not None else got is None


@pytest.mark.parametrize(("lat", "lon", "want"), [(55.0, 77.0 + 3 * k, f"мск{162 + k}") for k in range(10)] + [(55.0, 107.0, "мск24зона5"), (55.0, 115.0, "wgs84"), (55.0, 70.0, "wgs84"), (55.0, 76.0, "wgs84")] + [(45.0, 80.0 + 6 * k, f"мск24зона{1 + k}") for k in range(6)])
def test_zone(spark, lat, lon, want):
    assert spark.createDataFrame([(lat, lon)], "a double, b double").select(geo.zone(F.col("a"), F.col("b")).alias("z")).first()["z"] == want


RING = "array<struct<lat:double,lon:double>>"


def test_areas(spark):
    assert 600_000 < abs(one(spark, [(0.0, 0.0), (0.0, 0.01), (0.01, 0.0)], geo.ring_area, RING)) < 630_000
    assert one(spark, [(0.0, 0.0), (0.0, 0.01)], geo.ring_area, RING) == 0.0
    flat = "array<struct<x:double,y:double>>"
    assert abs(one(spark, [(0.0, 0.0), (0.0, 100.0), (100.0, 0.0)], geo.planar_area, flat)) == 5000
    assert one(spark, [(0.0, 0.0)], geo.planar_area, flat) == 0.0
    square = [(0.0, 0.0), (0.0, 1.0), (1.0, 1.0), (1.0, 0.0)]
    assert one(spark, square, lambda c: geo.inside(c, F.lit(0.5), F.lit(0.5)), RING) and not one(spark, square, lambda c: geo.inside(c, F.lit(1.5), F.lit(0.5)), RING)
    assert len(one(spark, square, geo.closed, RING)) == 5


def test_projection_round_trip():
    for name, (meridian, *_) in geo.ZONES.items():
        lat, lon = np.array([51.2, 58.9, 70.0]), np.array([meridian - 1.4, meridian, meridian + 2.5])
        back = geo.from_zone(*geo.to_zone(lat, lon, name), name)
        assert np.allclose(back[0], lat, atol=1e-9) and np.allclose(back[1], lon, atol=1e-9)


def test_geodesic():
    one_degree = geo.vincenty(np.array([0.0]), np.array([0.0]), np.array([0.0]), np.array([1.0]))
    assert one_degree[0] == pytest.approx(111.31949, abs=1e-4)
    assert geo.vincenty(np.array([55.0]), np.array([92.0]), np.array([55.0]), np.array([92.0]))[0] == 0


def test_similarity(spark):
    df = spark.createDataFrame([("Иванов", "иванов "), ("", "x"), (None, "x"), ("tide", "diet"), ("diet", "tide"), ("nan", "nan")], "a string, b string")
    assert [r[0] for r in df.select(similarity.ratio(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, 0.0, 0.25, 0.5, 0.0]
    assert similarity.partial("шурф", "обследован шурф 5") == 100 and similarity.partial("", "x") == 0
    df = spark.createDataFrame([("АДРЕС ОБЬЕКТА",), ("ничего",), (None,)], "v string")
    assert [r[0] for r in df.select(similarity.best_keyword(F.col("v"), {"address": ["адрес объекта"], "name": ["наименование"]})).collect()] == ["address", None, None]
