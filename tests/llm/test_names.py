import pytest

from barrow.llm import names


@pytest.mark.parametrize(
    ("value", "want"),
    [
        ("Гридардева Вера Антоновна", ("гридардева", "вера", "в", "антоновна", "а")),
        ("Иван Николаевич Килобренко", ("килобренко", "иван", "и", "николаевич", "н")),
        ("Ваня Килобренко", ("килобренко", "иван", "и", None, None)),
        ("к.и.н. Чепотвович Р.А.", ("чепотвович", None, "р", None, "а")),
        ("В.И. Мерынгук, эксперт", ("мерынгук", None, "в", None, "и")),
        ("ХопеткскаяЛ.Г.", ("хопеткская", None, "л", None, "г")),
        ("Aleksandr Ledalgykh", ("ледалгых", "александр", "а", None, None)),
        ("Протужковa Иринa Евгеньевна", ("протужкова", "ирина", "и", "евгеньевна", "е")),
        ("Чепотвович Раиса А.", ("чепотвович", "раиса", "р", None, "а")),
        ("Гридардева Лид. Григ.", ("гридардева", None, "л", None, "г")),
        ("нет данных", None), ("—", None), ("", None), ("б/н", None),
    ],
)
def test_person(value, want):
    assert names.person(value) == want


@pytest.mark.parametrize(
    ("value", "want"),
    [
        ("ГАУ «Научно-производственный центр «Кулюмар»»", ("кулюмар", "нпц", "гау")),
        ('ФГБУН "ПИО Кулюмар"', ("кулюмар", "пио", "фгбун")),
        ("«Кулюмар», проектно-изыскательское объединение, ФГБУН", ("кулюмар", "пио", "фгбун")),
        ("Федеральное государственное бюджетное учреждение науки «Проектно-изыскательское объединение «Кулюмар»", ("кулюмар", "пио", "фгбун")),
        ("НПО Geodezicheskoe predpriyatie Prostegal", ("простегал", "гп", "нпо")),
        ("ФГБУН «ПИО «Кулюмар» (Жузарск)", ("кулюмар", "пио", "фгбун")),
        ('ООО "Грирырок", Леирск', ("грирырок", None, "ооо")),
        ("ООО Бюро археологич. Нянедим", ("нянедим", None, "ооо")),
        ("не указан", None),
    ],
)
def test_organization(value, want):
    got = names.organization(value)
    assert (got and (got[0], got[2], got[4])) == want


def groups(spark, kind, values):
    df = spark.createDataFrame([(kind, v) for v in values], "kind string, name string")
    return {(r.name_a, r.name_b) for r in names.same_names(df).collect()}


def test_relatives_stay_apart_and_variants_meet(spark):
    vera = ["Гридардева Вера Антоновна", "Гридардева В.А.", "В. А. Гридардева", "Гридардева Верочка", " ГРИДАРДЕВА ВЕРА", "Гридардефа В.А."]
    lida = ["Гридардева Лидия Григорьевна", "Л.Г. Гридардева", "Гридардева Л.Г."]
    rows = [v for v in vera[:5] + lida for _ in range(6)] + vera[5:] + ["Гридардева", None, "", "не указан"]
    got = groups(spark, "person", rows)
    assert got == {tuple(sorted((a, b))) for g in (vera, lida) for a in g for b in g if a != b}


def test_bare_surname_of_one_person(spark):
    rows = ["Стетыдренко Олег Ильич"] * 5 + ["Стетыдренко", "О.И. Стетыдренко", "Кубечкин"]
    assert ("О.И. Стетыдренко", "Стетыдренко") in groups(spark, "person", rows)


def test_houses_of_another_sort(spark):
    rows = ["ГАУ «Научно-производственный центр «Кулюмар»»"] * 3 + ["ГАУ НПЦ Кулюмар", "ФГБУН «ПИО «Кулюмар»", "ФГБУН Проектно-изыскательское объединение Кулюмар", "Кулюмар", "ГАУ Кулюмар"]
    got = groups(spark, "organization", rows)
    assert got == {tuple(sorted(p)) for p in [(rows[0], "ГАУ НПЦ Кулюмар"), (rows[0], "ГАУ Кулюмар"), ("ГАУ НПЦ Кулюмар", "ГАУ Кулюмар"), (rows[4], rows[5])]}


def test_long_chains_merge_to_the_end(spark, monkeypatch):
    from pyspark.sql import functions as F

    # One profile moves in each round, as the end of a chain does.
    monkeypatch.setattr(names, "_moves", lambda profiles, close, exact_only: profiles.agg(F.max("id").alias("source"), F.min("id").alias("target")).where("source > target"))
    values = spark.createDataFrame([("person", f"{s}ов Иван Ильич", 1) for s in "Барыл Вохулк Гикорск Дузаш Жузарск Зимар Кракш Лелюн Марик Нянед Окунев Простег Растен Степн Фезанск Хопетк".split()], "kind string, name string, n long")
    assert names.resolved(values).select("entity").distinct().count() == 1


def test_empty(spark):
    assert groups(spark, "person", []) == set() and groups(spark, "person", ["-", None]) == set()
