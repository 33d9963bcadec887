import pytest

from barrow.llm import addresses, pairing


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("край Верхнесойский , Барылский р-н , хутор Дузашево , ул Рыбацкая , 58б", ("building", "барылский", "дузашево", "ул", "рыбацкая", "58", "б", None)),
        ("дом 53 корп. 2; улица Степная; п. Новодузашево; район Дукшалский; Верхнесойский край; 660805", ("building", "дукшалский", "новодузашево", "ул", "степная", "53", None, "2")),
        ("д. 8 «А» Полевый переулок Усть-Мариково Баперский район", ("building", "баперский", "усть-мариково", "пер", "полевый", "8", "а", None)),
        ("г. Вохулка, просп.Рыбацкий, 31/2", ("building", None, "вохулка", "пр-т", "рыбацкий", "31", None, "2")),
        ("661397 край Верхнесойский Жутылский р-н У.-Вохулка пр-д Песчаный дом 5", ("building", "жутылский", "усть-вохулка", "пр-д", "песчаный", "5", None, None)),
    ],
)
def test_buildings(text, want):
    p = addresses.parse(text)
    assert (p["kind"], p["district"], p["settlement"], p["street_type"], p["street"], p["house"], p["letter"], p["block"]) == want


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Верхнесойский край, Гикорский муниципальный округ, 1,7км на восток от посёлок Верх-Вохулка", ("верх-вохулка", 1700, 90)),
        ("660805 , Дукшалский м.о. , п.Новодузашево (~8,6 км СЗ)", ("новодузашево", 8600, 315)),
        (" правый берег р. Ралень , хутор Кракшаново (~8 км к В) , Гиримский р-н", ("кракшаново", 8000, 90)),
        ("1900 м западнее от с Новокракшаново", ("новокракшаново", 1900, 270)),
        ("5,9км к югу от Дузашево", ("дузашево", 5900, 180)),
    ],
)
def test_spots(text, want):
    p = addresses.parse(text)
    assert p["kind"] == "spot" and (p["settlement"], p["metres"], p["degrees"]) == want


@pytest.mark.parametrize("text", ["Верхнесойский край", "Фезанский район", "не указано", "-", " ", "", None, "660805"])
def test_no_location(text):
    assert addresses.parse(text) is None


def pairs(spark, rows):
    return {tuple(r) for r in addresses.same_places(spark.createDataFrame(rows, "rec string, text string")).collect()}


def test_pairs(spark):
    rows = [("a:1", "Барылский район, х. Дузашево, ул. Рыбацкая, 5"), ("a:1", "Барылский район, х. Дузашево, ул. Рыбацкая, 5"), ("a:2", "д.5, Рыбацкая ул, хут. Дузашево"), ("a:3", "х. Дузашево, ул. Рыбацкая, 5а"), ("a:4", "х. Дузашево, ул. Рыбацкая, 5 к.2"), ("a:5", "х. Дузашево, пер. Рыбацкий, 5"), ("b:1", "Барылский район"), ("b:2", "Барылский район"), ("b:3", None), ("b:4", "")]
    rows += [(f"c:{k}", "Барылский р-н, х. Дузашево, ул. Степная, 9") for k in range(6)] + [("d:1", "Барылский р-н, х. Дузашеово, ул. Степная, 9"), ("d:2", "Барылский р-н, х. Дузашево, пр. Степной, 9"), ("d:3", "Барылский р-н, х. Дузашево, пр-т Степной, 9")]
    got = pairs(spark, rows)
    assert ("a:1", "a:2") in got and not any(x in p for p in got for x in ("a:3", "a:4", "a:5", "b:1"))
    assert {p for p in got if p[1] == "d:1"} == {(f"c:{k}", "d:1") for k in range(6)} and ("d:2", "d:3") in got
    assert len(got) == 1 + 15 + 6 + 1
    assert pairs(spark, rows[:0]) == set()


def test_hot_location_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(pairing, "BLOCK", 7)
    assert len(pairs(spark, [(f"r:{k}", "х. Дузашево, ул. Рыбацкая, 5") for k in range(30)])) == 30 * 29 // 2


def test_same_name_in_two_districts(spark):
    rows = [(f"x:{k}", "Растенский район, х. Мариково, ул. Полевая, 1") for k in range(3)] + [(f"y:{k}", "Лелюнский район, п. Мариково, ул. Полевая, 1") for k in range(3)] + [("z:1", "п. Мариково, ул. Полевая, 1")]
    got = pairs(spark, rows)
    assert {p for p in got if "z:1" in p} == {(f"y:{k}", "z:1") for k in range(3)} and len(got) == 9


def test_small_district_beside_a_hot_one(spark):
    rows = [(f"x:{k:02}", f"Растенский район, х. Мариково, ул. Полевая, {k}") for k in range(60)] + [("y:1", "Лелюнский район, х. Мариково, ул. Степная, 7"), ("y:2", "Растенскоий м.о., х. Мариково, ул. Зелёная, 3"), ("z:1", "х. Мариково, ул. Степная, 7")]
    assert ("y:1", "z:1") in pairs(spark, rows)


def test_street_without_its_type(spark):
    p = addresses.parse("с. Усть-Выдра, Выдринский район, Садовая, 5")
    assert (p["settlement"], p["street"], p["street_type"], p["house"]) == ("усть-выдра", "садовая", None, "5")
    assert addresses.parse("Выдринский район, Садовая, 5") is None
    rows = [("a:1", "с. Усть-Выдра, Выдринский район, Садовая, 5"), ("a:2", "с. Усть-Выдра, Выдринский район, ул. Садовая, 5"), ("a:3", "с. Усть-Выдра, Выдринский район, ул. Садовая, 7")]
    assert pairs(spark, rows) == {("a:1", "a:2")}


def test_pairs_that_share_several_forms_stand_once(spark):
    rows = [(f"r:{k}", "х. Дузашево, пр. Степной, 9") for k in range(5)] + [("s:1", "х. Дузашево, пр-т Степной, 9")]
    got = [tuple(r) for r in addresses.same_places(spark.createDataFrame(rows, "rec string, text string")).collect()]
    assert len(got) == len(set(got)) == 15
