import random

import pytest

from barrow.llm import leaks, words

ITEM = "Вычислите объём насыпи у Кишурье, коль скоро высота её 12,6 сажени, а обход по подошве занимает 4006 шагов и тропа ведёт к реке."


def found(spark, docs, items, exact=True):
    d = spark.createDataFrame(list(enumerate(docs)), "doc_id int, text string")
    i = spark.createDataFrame(list(enumerate(items, 100)), "item_id int, text string")
    return {(r.doc_id, r.item_id) for r in leaks.leaks(d, i).where(f"exact = {str(exact).lower()}").collect()}


def test_typing_layout_and_markup(spark):
    w = ITEM.split()
    docs = [
        ITEM.upper(), "<p>" + "&nbsp;".join(w) + "</p>", "\r\n> ".join(w), ITEM.replace("подошве", "по-\nдошве").replace("занимает", "зани­mает"),
        ITEM.replace("о", "o").replace("а", "a"), ITEM.replace("ё", "е"), ITEM.replace("насыпи", "<b>нас</b>ыпи").replace("обход", "об​ход"),
        " ".join(w[:10]), "x " + " ".join(w[2:15]) + " y", " ".join(w[:8] + ["иное"] + w[8:14]), "", None,
    ]
    assert {d for d, _ in found(spark, docs, [ITEM])} == {0, 1, 2, 3, 4, 5, 6, 8}


def test_again_with_other_values(spark):
    again = ITEM.replace("12,6", "3,1").replace("Кишурье", "Лелерино").replace("4006", "17")
    assert found(spark, [again], [ITEM]) == set()
    assert found(spark, [again, "совсем другой текст " * 9], [ITEM, "Тропа к Кишурье идёт через Кишурье и далее"], exact=False) == {(0, 100)}


TWICE = "Отряд вышел из Кишурье к реке и у брода близ Кишурье нашёл 15 черепков, из которых 15 лежали в воде, прочие же на песке у Кишурье."


def test_slots_must_be_consistent(spark):
    good = TWICE.replace("Кишурье", "Жуково").replace("15", "7")
    names = TWICE.replace("Кишурье", "Лелерино", 1).replace("Кишурье", "Жуково").replace("15", "7")
    numbers = TWICE.replace("Кишурье", "Жуково").replace("15", "8", 1).replace("15", "9")
    assert found(spark, [good, names, numbers, TWICE], [TWICE], exact=False) == {(0, 100)}
    assert found(spark, [good, names, numbers, TWICE], [TWICE]) == {(3, 100)}


def test_items_of_one_form_have_one_representative(spark):
    """A document that holds one of them is none that puts the others again; one with new values names the representative."""
    other = TWICE.replace("Кишурье", "Салтыково").replace("15", "21")
    third = TWICE.replace("Кишурье", "Жуково").replace("15", "7")
    assert found(spark, [other, third], [TWICE, other], exact=False) == {(1, 100)}
    assert found(spark, [other, third], [TWICE, other]) == {(0, 101)}


def test_large_test_sets_take_the_join_alone(spark, monkeypatch):
    again = ITEM.replace("12,6", "3,1").replace("Кишурье", "Лелерино").replace("4006", "17")
    monkeypatch.setattr(leaks, "MOST_WINDOWS", 3)
    assert found(spark, [again, "x " + ITEM], [ITEM]) == {(1, 100)} and found(spark, [again, "x " + ITEM], [ITEM], exact=False) == {(0, 100)}
    monkeypatch.setattr(leaks, "MOST_WORDS", 3)
    with pytest.raises(ValueError):
        found(spark, [again], [ITEM])


def test_empty_tables_and_short_items(spark):
    assert found(spark, [ITEM], []) == set() and found(spark, [], [ITEM]) == set() and found(spark, [ITEM], ["всего три слова", "", None]) == set()


def test_against_brute_force(spark):
    draw = random.Random(2)
    vocabulary = ["камень", "Жуково", "17", "реки", "в", "у", "слой", "П", "км"]
    items = [" ".join(draw.choice(vocabulary) for _ in range(30)) for _ in range(8)]
    docs = []
    for _ in range(60):
        source = draw.choice(items).split()
        a = draw.randrange(15)
        docs.append(" ".join([draw.choice(vocabulary) for _ in range(9)] + source[a : a + draw.randint(8, 15)] + [draw.choice(vocabulary) for _ in range(9)]))
    grams = lambda t: {tuple(words.words(t)[k : k + 12]) for k in range(len(words.words(t)) - 11)}
    want = {(d, 100 + i) for d, t in enumerate(docs) for i, s in enumerate(items) if grams(t) & grams(s)}
    assert want and found(spark, docs, items) == want


def test_fold():
    assert words.words("№ 5 — ЁЛКА ёлка Сoрoка") == ["5", "елка", "елка", "сорока"]
    assert words.words("серо-\nбурый по-\nрядок", frozenset({"порядок"})) == ["серо", "бурый", "порядок"]


def test_every_item_of_one_form_is_named(spark, tmp_path):
    """all items whose form a document fills with new values, as the queries ask for them."""
    from barrow.llm import queries

    other = TWICE.replace("Кишурье", "Салтыково").replace("15", "21")
    third = TWICE.replace("Кишурье", "Жуково").replace("15", "7")
    torn = TWICE.replace("Кишурье", "Лелерино", 1).replace("Кишурье", "Жуково").replace("15", "7")
    spark.createDataFrame([(1, third), (2, torn), (3, "совсем другой текст " * 9)], "doc_id int, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(100, TWICE), (101, other), (101, other)], "item_id int, text string").write.parquet(f"{tmp_path}/eval_items.parquet")
    rows = queries.p7_again(spark, str(tmp_path)).collect()
    assert {(r.doc_id, r.item_id) for r in rows} == {(1, 100), (1, 101)} and len({r.windows for r in rows}) == 1
    assert [(r.doc_id, r.n_items, r.n_items_again) for r in queries.p7_documents(spark, str(tmp_path)).collect()] == [(1, 0, 2)]
