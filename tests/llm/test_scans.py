import random

import numpy as np

from barrow.llm import boosting, scans

SENTENCES = ["Памятник расположен на краю надпойменной террасы и датируется временем неолита.", "Культурный слой нарушен распашкой, поэтому каменные грузила лежали вперемешку с обломками кирпича.", "Координаты поворотных точек сняты приёмником, погрешность указана в отчёте.", "Кромка террасы разрушается, ежегодно теряется часть берега реки.", "Находки переданы на хранение и записаны в журнал поступлений.", "Зачистка показала тёмно-коричневый суглинок и прослойку угля.", "Вдоль трассы осматривались все обнажения и отвалы.", "Проверка сведений потребовала осмотра урочищ в долине реки."]


def corpus(n=160, seed=1):
    draw = random.Random(seed)
    return [" ".join(draw.choices(SENTENCES, k=draw.randint(5, 9))) for _ in range(n)]


def test_trees_learn_what_no_line_can():
    draw = np.random.default_rng(0)
    x = draw.random((800, 3))
    y = (x[:, 0] > 0.5) != (x[:, 1] > 0.5)
    model = boosting.fit(x[:600], y[:600])
    assert ((model.probability(x[600:]) > 0.5) == y[600:]).mean() > 0.93
    assert boosting.fit(x, np.zeros(800)).probability(x).max() < 0.01
    assert len(boosting.fit(np.zeros((0, 3)), np.zeros(0)).trees) == 0


def test_lines_held_out():
    models = scans.line_models(corpus(300))
    draw = random.Random(99)
    wrong = n = 0
    for text in corpus(60, seed=50):
        lines, labels = scans._with_noise(text, draw)
        ((_, kinds),) = scans.furniture(["\n".join(lines)], models)
        for k, want in zip(kinds, labels, strict=True):
            n += 1
            wrong += (k != want) and not (k == 3 and want == 1)
    assert wrong / n < 0.02


def test_marked_and_capital_heads_as_wide_as_the_text():
    models = scans.line_models(corpus(300))
    body = "Памятник расположен на краю надпойменной террасы и датируется\nвременем неолита. Культурный слой нарушен распашкой, поэтому каменные\n{}\nгрузила лежали вперемешку с обломками кирпича и угля, а также\nс находками из верхнего слоя."
    for head in ("__Акт государственной историко-культурной экспертизы № 23-19__", "__Краевой научный архив. Дело 415, для служебного пользования__", "КРАЕВОЙ НАУЧНЫЙ АРХИВ. ДЕЛО 415, ДЛЯ СЛУЖЕБНОГО ПОЛЬЗОВАНИЯ"):
        ((_, kinds),) = scans.furniture([body.format(head)], models)
        assert list(kinds) == [0, 0, 1, 0, 0], head


def test_training_texts_do_not_depend_on_order(spark, monkeypatch):
    monkeypatch.setattr(scans, "TRAINING_TEXTS", 20)
    rows = [(t,) for t in corpus()]
    first, second = (scans.training_texts(spark.createDataFrame(r, "text string")) for r in (rows, rows[::-1]))
    assert first == second and len(first) == 20 and set(first) != {t for (t,) in rows[:20]}


def test_kinds_of_noise(spark):
    clean = corpus()
    word = "Зачистка показала тёмно-\nкоричневый суглинок и про-\nслойку угля."
    rows = [(i, t) for i, t in enumerate(clean)]
    rows += [(1000, word), (1001, "Зачистка показала тёмно-\nкоричневый суглинок и прослойку угля."), (1002, SENTENCES[0] + " " + SENTENCES[3].replace("террасы", "тсррасы")), (1003, SENTENCES[0].replace("краю", "кра^ю")), (1004, SENTENCES[4].replace("хранение", "хрaнение")), (1005, "Находки переданы на хранение и записаны\n- 17 -\nв журнал поступлений, а кромка террасы разрушается\nежегодно."), (1006, "Находки переданы на хранение и записаны\nШИФР 12/345\nв журнал поступлений, а кромка террасы разрушается\nежегодно."), (1007, ""), (1008, None), (1003, SENTENCES[0].replace("краю", "кра^ю"))]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "id int, text string, noise string")
    got = {(r.id, r.noise) for r in scans.noise(df, ["id"]).collect()}
    assert got == {(1000, "hyphen"), (1002, "char"), (1003, "char"), (1004, "char"), (1005, "page"), (1006, "header")}


def test_misread_compounds_and_long_words(spark):
    long = "сверх" + "высокочастотно" * 3
    texts = corpus() + [f"Зачистка показала светло-серая супесь и {long} слой." for _ in range(60)]
    bad = [(1000, "Зачистка показала тёмно-коричиевый суглинок."), (1001, "Зачистка показала светпо-серая супесь."), (1002, f"Зачистка показала {long.replace('с', 'е', 1)} слой."), (1003, "Зачистка показала тёмно-коричневый суглинок.")]
    df = spark.createDataFrame([*enumerate(texts), *bad], "id int, text string")
    assert {(r.id, r.noise) for r in scans.noise(df, ["id"]).collect()} == {(1000, "char"), (1001, "char"), (1002, "char")}


def test_joins_ask_the_whole_vocabulary(spark, monkeypatch):
    monkeypatch.setattr(scans, "COMMON_WORDS", 5)
    rows = [*enumerate(corpus()), (1000, "Зачистка показала тёмно-\nкоричневый суглинок."), (1001, "Зачистка показала про-\nслойку угля."), (1002, "Зачистка показала тёмно- коричневый суглинок.")]
    df = spark.createDataFrame(rows, "id int, text string")
    assert {(r.id, r.noise) for r in scans.noise(df, ["id"]).collect()} == {(1001, "hyphen")}
    got = {r.id: r.text for r in scans.repaired(df, ["id"]).where("id >= 1000").collect()}
    assert got == {1000: "Зачистка показала тёмно-коричневый суглинок.", 1001: "Зачистка показала прослойку угля.", 1002: "Зачистка показала тёмно-коричневый суглинок."}


def test_repair(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(corpus())] + [(1000, "Находки переданы на хра-\nнение и записаны\n- 17 -\nв журнал поступлений. Зачистка показала тёмно-\nкоричневый суглинок.\n\nКромка тсррасы разрушается."), (1001, None), (1002, "")], "id int, text string")
    got = {r.id: r.text for r in scans.repaired(df, ["id"]).where("id >= 1000").collect()}
    assert got == {1000: "Находки переданы на хранение и записаны в журнал поступлений. Зачистка показала тёмно-коричневый суглинок.\n\nКромка террасы разрушается.", 1001: None, 1002: ""}


def test_empty(spark):
    df = spark.createDataFrame([], "id int, text string")
    assert scans.noise(df, ["id"]).count() == 0 and scans.repaired(df, ["id"]).count() == 0


def test_joins_are_learned():
    texts = corpus(300)
    counts = scans.Counter(w.lower() for t in texts for w in scans._TOKEN.findall(t))
    model = scans.join_model(texts, counts, 1.0)
    assert model.trees
    pairs = [("тёмно", "-", "коричневый", 4), ("расположе", "-", "н", 4), ("про", "-", "слойку", 3), ("тёмно", "-", "коричневый", 5), ("надпоймен", "­", "ной", 4)]
    assert scans.joined(pairs, counts, model) == [False, True, True, False, True]


def test_candidates_against_brute_force(spark):
    """Pairs alike in shape or one slip apart in it, whatever grams they share."""
    draw = random.Random(4)
    base = ["".join(draw.choice("аеинотсклпв") for _ in range(draw.randint(3, 9))) for _ in range(60)]
    words = {w: draw.choice((40, 90)) for w in base}
    for w in base:
        k = draw.randrange(len(w))
        for bad in (w[:k] + draw.choice("аеинотсклпв") + w[k + 1 :], w[:k] + w[k + 1 :], w[:k] + draw.choice("ое") + w[k:], w[: k - 1] + w[k : k + 1] + w[k - 1 : k] + w[k + 1 :], w.replace("и", "н").replace("п", "л")):
            if len(bad) > 1:
                words.setdefault(bad, draw.choice((1, 3)))
    shape = lambda w: w.translate(str.maketrans(scans.CLASS_FROM, scans.CLASS_TO))

    def one_slip(a, b):
        drops = lambda w: {w[:j] + w[j + 1 :] for j in range(len(w))}
        wrong = len(a) == len(b) and sum(x != y for x, y in zip(a, b, strict=True)) == 1
        swap = len(a) == len(b) and any(a[:j] + a[j + 1 : j + 2] + a[j : j + 1] + a[j + 2 :] == b for j in range(len(a) - 1)) and a != b
        return wrong or swap or len(a) == len(b) + 1 and b in drops(a) or len(b) == len(a) + 1 and a in drops(b)

    want = set()
    for w, n in words.items():
        for o, m in words.items():
            if w != o and m >= (10 if len(w) <= 3 else 1) * scans.TIMES * n and (shape(w) == shape(o) or min(len(w), len(o)) >= 5 and one_slip(shape(w), shape(o))):
                want.add((w, o))
    df = spark.createDataFrame([(w, n, 0) for w, n in words.items()], "word string, n long, capital long")
    got = {(r.word, r.other) for r in scans.candidates(df).collect()}
    assert len(want) > 100 and want <= got and all(shape(w) == shape(o) or min(len(w), len(o)) >= 5 for w, o in got)


def test_stray_and_swapped_letters(spark):
    bad = [(1000, SENTENCES[0].replace("террасы", "терраjсы").replace("j", "і")), (1001, SENTENCES[1].replace("распашкой", "рапсашкой"))]
    df = spark.createDataFrame([*enumerate(corpus(400)), *bad], "id int, text string")
    assert {(r.id, r.noise) for r in scans.noise(df, ["id"]).collect()} <= {(1000, "char"), (1001, "char")}


def test_double_hyphens_divide_words():
    assert scans.breaks(["постра=", "давшие вещи"], scans.np.zeros(2)) == [(0, 1, "постра", "=", "давшие")]
    assert scans.inline_breaks("постра= давшие") == [("постра", "=", "давшие")]


def test_words_parted_in_every_text_are_held_against_the_corpus(spark, monkeypatch):
    """misread words that stand nowhere whole, divided at a line end or inside a compound parted at its hyphen."""
    rows = [*enumerate(corpus(400)), (1000, "Кромка террасы разрушается, ежегодно теряется часть тсрра-\nсы."), (1001, "Зачистка показала тёмно-\nкоричиевый суглинок."), (1002, "Зачистка показала тёмно-\nкоричневый суглинок.")]
    df = spark.createDataFrame(rows, "id int, text string")
    for common in (30_000, 5):
        monkeypatch.setattr(scans, "COMMON_WORDS", common)
        assert {(r.id, r.noise) for r in scans.noise(df, ["id"]).where("noise = 'char'").collect()} == {(1000, "char"), (1001, "char")}
        got = {r.id: r.text for r in scans.repaired(df, ["id"]).where("id > 1000").collect()}
        assert got == {1001: "Зачистка показала тёмно-коричневый суглинок.", 1002: "Зачистка показала тёмно-коричневый суглинок."}


def test_misread_words_beside_stray_signs_are_repaired(spark):
    """a text with a stray sign, with a misread word besides or in the same word; null keys as any other."""
    rows = [*enumerate(corpus()), (1000, "Памятник расположен на кра^ю надпойменной тсррасы."), (1001, "Кромка тсрр^асы разрушается."), (None, "Кромка тсррасы разрушается.")]
    got = {r.id: r.text for r in scans.repaired(spark.createDataFrame(rows, "id int, text string"), ["id"]).where("id >= 1000 or id is null").collect()}
    assert got == {1000: "Памятник расположен на краю надпойменной террасы.", 1001: "Кромка террасы разрушается.", None: "Кромка террасы разрушается."}


def test_words_divided_over_blank_lines_and_in_capitals(spark):
    """the blank lines that furniture leaves behind, and words in capitals."""
    assert scans.breaks(["на хра-", "", "- 17 -", "", "нение"], scans.np.array([0, 0, 2, 0, 0])) == [(0, 4, "хра", "-", "нение")]
    assert scans.breaks(["КРОМКА ТЕР-", "РАСЫ", "Санкт-", "Петербург"], scans.np.zeros(4)) == [(0, 1, "ТЕР", "-", "РАСЫ")]
    rows = [*enumerate(corpus()), (1000, "Находки переданы на хра-\n\nнение и записаны."), (1001, "Памятник расположен на краю надпойменной ТЕРРА-\nСЫ и датируется временем неолита.")]
    assert {(r.id, r.noise) for r in scans.noise(spark.createDataFrame(rows, "id int, text string"), ["id"]).where("noise = 'hyphen'").collect()} == {(1000, "hyphen"), (1001, "hyphen")}
