import random

from barrow.llm import stuffing

PROSE = "Слой описан в отчёте, который составил отряд, и на плане он показан у реки, но не до конца. Все находки переданы в музей, где их описали и сфотографировали для каталога. Мы осмотрели берег от моста до устья, однако следов раскопа там нет. "
INVENTORY = "\n".join(f"{k}; кв. {k * 7 % 90}; гл. {k * 3 % 80} см; {w}; {k} экз." for k, w in enumerate(["обломки тигля", "бронзовые бляшки", "каменные грузила", "поясные обоймы", "стеклянные бусы"] * 6, 1))


def pages():
    draw = random.Random(6)
    sentences = PROSE.split(". ")
    prose = [". ".join(draw.sample(sentences, len(sentences)) * 2) for _ in range(60)]
    links = "\n".join(f"термос {k} - shop{k}.example/{k * 31}" for k in range(30))
    keywords = "купить георадар недорого " * 50
    tags = " ".join(f"#термос_{w}" for w in "купить цена фото скидка отзывы оптом онлайн".split() * 6)
    doorway = " ".join(f"такси {a}{b}ово" for a in ("Жу", "Ле", "Ма", "Пе", "Ко") for b in ("ра", "ли", "ме", "то", "ну", "бе"))
    return prose, [links, keywords, tags, doorway, PROSE[:100] + "\n" + keywords], [INVENTORY, PROSE * 3 + "\n#река #берег", PROSE * 4 + "\nhttps://a.example/1", "", None, "12 13 14 15", "слово"]


def frame(spark, texts, lang="ru"):
    return spark.createDataFrame([(i, t, lang, "clash") for i, t in enumerate(texts)], "doc_id long, text string, lang string, top string")


def test_verdicts(spark):
    prose, spam, plain = pages()
    for lang in ("ru", None):
        got = {r.doc_id: r for r in stuffing.scored(frame(spark, prose + spam + plain, lang)).collect()}
        assert {k for k, r in got.items() if r.stuffed} == set(range(len(prose), len(prose) + len(spam))), got


def test_copies_and_empty(spark):
    df = spark.createDataFrame([(1, "купить термос " * 40), (2, "купить термос " * 40), (2, "купить термос " * 40), (None, "купить термос " * 40)], "doc_id long, text string")
    got = [(r.doc_id, r.stuffed) for r in stuffing.scored(df).collect()]
    assert sorted(got) == [(1, True), (2, True)]
    assert stuffing.scored(df.limit(0)).count() == 0


def test_curve_lowers_what_is_asked(spark):
    prose, _, _ = pages()
    half = PROSE * 2 + "\n" + "термос " * 62
    rows = {r.doc_id: r for r in stuffing.scored(frame(spark, prose + [half])).collect()}
    assert rows[0].z < 3 < rows[len(prose)].z and stuffing.LEAST <= rows[len(prose)].asked < rows[0].asked <= stuffing.MOST
    assert rows[len(prose)].stuffed and rows[len(prose)].divergence < stuffing.MOST


def test_whole_page_decides_language(spark):
    """A long page that opens in another language is held against the prose of most of its letters."""
    prose, _, _ = pages()
    english = "The survey of the left bank has found no traces of the old road and the plan was redrawn after the storm. "
    mixed = english * 9 + PROSE * 40
    texts = [(i, t, "ru") for i, t in enumerate(prose)] + [(100 + i, english * 2, "en") for i in range(40)] + [(200, mixed, "en"), (201, PROSE, None)]
    got = {r.doc_id: r.language for r in stuffing.scored(spark.createDataFrame(texts, "doc_id long, text string, lang string")).collect()}
    assert got[200] == got[201] == got[0] == "ru" and got[100] == "en"


def test_tokens():
    assert stuffing.tokens("1; кв. 44; гл. 15 см; бусины; 15 экз.\n2; кв. 5") == (["бусины"], 6)
    assert stuffing.tokens("top 10 buy " * 8) == (["top", "buy"] * 8, 8)
    assert stuffing.tokens("термос https://a.test/12 #карта_кладов")[0].count(stuffing.LINK) == 4
    assert stuffing.tokens("термос #карта_кладов")[0].count(stuffing.TAG) == 2


def test_curve(spark):
    pages_ = spark.createDataFrame([(1, [(8, 1), (4, 1), (2, 2), (1, 4)])], "_key long, curve array<struct<f:int,m:int>>")
    row = stuffing.rank_frequency(pages_).first()
    assert -1.3 < row["slope"] < -0.7 and row["residual"] < 0.3 and abs(row["top"] - 8 / 20) < 1e-9
