from pyspark.sql import functions as F

from barrow.operators import predicates


def test_taken_and_owned(spark):
    users = spark.createDataFrame([(1, "a", True), (2, "b", False), (3, "b", None), (4, None, False)], "id int, name string, is_superuser boolean")
    assert sorted(r.id for r in predicates.taken(users, "id", users.select("id", "name"), "name").collect()) == [2, 3]
    rows = spark.createDataFrame([(7, 1), (8, 2), (9, None)], "row int, user_id int")
    ids = lambda u: sorted(r.row for r in predicates.owned(rows, users, u).collect())
    assert ids(1) == [7, 8, 9] and ids(2) == [8] and ids(3) == [] and ids(99) == []


def test_files_and_points(spark):
    files = spark.createDataFrame([("/r/a.pdf",), ("/r/x/b.pdf",), ("/r/x/y/c.pdf",), ("/r/x/y/d.PDF",), ("/r/x/z/e.pdf",), ("/other/f.pdf",)], "path string")
    assert sorted(r.path for r in predicates.needs_reorganising(files, "/r/").collect()) == ["/r/a.pdf", "/r/x/b.pdf", "/r/x/y/c.pdf", "/r/x/y/d.PDF"]
    points = spark.createDataFrame([("g", "1"), ("g", "2"), (None, "1")], "grp string, p string")
    chosen = spark.createDataFrame([("g-1",), ("g-1",)], "key string")
    assert [tuple(r) for r in predicates.selected(points, ["grp", "p"], chosen).collect()] == [("g", "1")]
    assert [r[0] for r in files.select(predicates.has_extension(F.col("path"), ["pdf"])).collect()] == [True] * 6


def test_small_aggregates(spark):
    zones = spark.createDataFrame([(1, "a"), (1, "a"), (2, "a"), (2, "b")], "k int, zone string")
    assert {r.k: r.zone for r in predicates.agreed_zone(zones, ["k"], "zone").collect()} == {1: "a", 2: "wgs84"}
    seen = spark.createDataFrame([(1, "b", 1), (1, "a", 2), (1, "b", 3), (1, None, 0)], "k int, v string, n int")
    assert predicates.first_seen(seen, "k", "v", "n").first()["values"] == ["b", "a"]
    one = spark.range(1)
    pick = lambda c: one.select(c.alias("r")).first()["r"]
    assert pick(predicates.adds_up(F.array(F.lit(0.1), F.lit(0.2)), F.lit(0.3))) and not pick(predicates.adds_up(F.array(F.lit(1.0)), F.lit(None).cast("double")))
    assert pick(predicates.remaining_seconds(F.lit(10.0), F.lit(5), F.lit(20))) == 30.0 and pick(predicates.remaining_seconds(F.lit(10.0), F.lit(0), F.lit(20))) is None
    assert pick(predicates.better_text(F.lit("коротко"), F.lit("x" * 50), ["слово"])) == "x" * 50 and pick(predicates.better_text(F.lit("нет"), F.lit("слово"), ["слово"])) == "слово"
    assert pick(predicates.tick_cell(F.lit(9.9), F.lit(5.0), F.lit(10.0), F.lit(10.0), 2, 9)) == 9 and pick(predicates.tick_cell(F.lit(11.0), F.lit(5.0), F.lit(10.0), F.lit(10.0), 2, 9)) is None


def test_readable_words(spark):
    words = spark.createDataFrame([("слово", 90), ("а", 90), ("7", 90), ("слово", 10), (None, 90)], "word string, conf int")
    assert sorted(r.word for r in predicates.readable_words(words).collect()) == ["7", "слово"]
