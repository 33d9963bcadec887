"""Matching stored rows: hash duplicates, new against known files, registry records by weighted similarity."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barrow.functions import similarity, text

#: Distinct years a registry can hold.
MOST_YEARS = 1000
#: Parts into which the extracted records of a year are spread; each meets all registry records of the year.
SALTS = 8

SOURCES = "array<struct<type:string,path:string,original_path:string,origin_filename:string,file_hash:string,was_organized:boolean>>"


def files_of(df: DataFrame, key: str, source: str = "source") -> DataFrame:
    """(key, path, origin_filename, file_hash) of every file listed in a JSON source column; malformed lists have none."""
    return df.select(F.col(key), F.explode(F.from_json(source, SOURCES)).alias("_f")).select(key, "_f.path", "_f.origin_filename", "_f.file_hash")


def duplicates(files: DataFrame, hashed: str, key: str) -> DataFrame:
    """MAT-01..03: contents stored under several keys: (hash, kept key, copies). Null hashes are no contents."""
    return files.where(F.col(hashed).isNotNull()).groupBy(hashed).agg(F.min(key).alias("kept"), F.countDistinct(key).alias("copies")).where("copies > 1")


def refuse_duplicates(files: DataFrame, stored: DataFrame, hashed: str = "file_hash") -> DataFrame:
    """MAT-03: files as they are if none is stored already by its content; ValueError with one of them if any is."""
    again = files.where(F.col(hashed).isNotNull()).join(stored.select(hashed), hashed, "left_semi").limit(1).collect()
    if again:
        raise ValueError(f"already stored: {again[0][hashed]}")
    return files


#: Fixed value: the source of what a user uploaded.
USER_FILE = "Пользовательский файл"


def downloaded(rows: DataFrame, key: str = "id") -> DataFrame:
    """MAT-07: (origin_filename) of the files of crawled rows, each once: rows(key, upload_source, source) whose source is no user's file."""
    crawled = rows.where(F.get_json_object("upload_source", "$.source") != USER_FILE)
    return files_of(crawled, key).where("origin_filename is not null").select("origin_filename").distinct()


def file_news(found: DataFrame, known: DataFrame) -> DataFrame:
    """AGG-04: one row (new_files, existing_files) of found(path, file_hash) against known, each path once."""
    paths = found.select("path", "file_hash").where("path is not null").distinct()
    fresh = new_files(paths, known).select("path").distinct().withColumn("_new", F.lit(1))
    return paths.select("path").distinct().join(fresh, "path", "left").agg(F.count("_new").alias("new_files"), (F.count("*") - F.count("_new")).alias("existing_files"))


def new_files(found: DataFrame, known: DataFrame) -> DataFrame:
    """MAT-04, MAT-05: found(path, file_hash) that are neither known by path nor, failing that, by hash.

    Two anti joins, the cheap one first; a file without a hash counts as known.
    """
    left = found.join(known.select("path").distinct(), "path", "left_anti").where(F.col("file_hash").isNotNull())
    return left.join(known.where(F.col("file_hash").isNotNull()).select("file_hash").distinct(), "file_hash", "left_anti")


def backfilled(source: Column, hashes: Column) -> Column:
    """MAT-06: a source list in which each file without a hash takes it from a map of path to hash."""
    return F.transform(source, lambda f: f.withField("file_hash", F.coalesce(f["file_hash"], hashes[f["path"]])))


def suffixed(df: DataFrame, keys: list[str], order: str, name: str = "key_name") -> DataFrame:
    """MAT-21: equal names told apart: the first keeps its name, the others are name_1, name_2 ... in order."""
    w = Window.partitionBy(*keys).orderBy(order)
    n = F.row_number().over(w) - 1
    label = F.concat_ws("_", *[F.col(k).cast("string") for k in keys])
    return df.withColumn(name, F.when(n == 0, label).otherwise(F.concat(label, F.lit("_"), n.cast("string"))))


#: Weight of each compared field of the registry.
WEIGHTS = {"finish_date": 0.3, "expert": 0.3, "name_number": 0.1, "place": 0.1, "customer": 0.1, "area": 0.1, "executioner": 0.1, "open_list": 0.1, "conclusion": 0.1, "border_objects": 0.1}


def weighted_similarity(left: str, right: str, weights: dict[str, float] | None = None) -> Column:
    """MAT-09: mean similarity over the fields that both sides have, by weight; 0 if there is none.

    left and right are aliases; the left side is the extracted record, which comes first in the ratio.
    """
    total, weight = F.lit(0.0), F.lit(0.0)
    for name, w in (weights or WEIGHTS).items():
        a, b = F.col(f"{left}.{name}").cast("string"), F.col(f"{right}.{name}").cast("string")
        there = reduce(lambda x, y: x & y, [~F.lower(F.trim(F.coalesce(v, F.lit("")))).isin("", "nan") for v in (a, b)])
        total = total + F.when(there, similarity.ratio(a, b) * w).otherwise(0.0)
        weight = weight + F.when(there, w).otherwise(0.0)
    return F.when(weight > 0, total / weight).otherwise(0.0)


def _plain(df: DataFrame) -> DataFrame:
    """df with each compared field as the ratio reads it (trimmed, in lower case), its length and its weight if it counts."""

    @F.pandas_udf("string")
    def lowered(values: pd.Series) -> pd.Series:
        return values.fillna("").map(lambda v: v.strip().lower())

    df = df.withColumns({f"_plain_{name}": lowered(F.col(name).cast("string")) for name in WEIGHTS})
    there = {name: ~F.lower(F.trim(F.coalesce(F.col(name).cast("string"), F.lit("")))).isin("", "nan") for name in WEIGHTS}
    return df.withColumns({f"_length_{name}": F.length(f"_plain_{name}") for name in WEIGHTS} | {f"_weight_{name}": F.when(there[name], w).otherwise(0.0) for name, w in WEIGHTS.items()})


def _at_most(edited: tuple[str, ...]) -> Column:
    """A value that weighted_similarity of the aliases a and b never exceeds, without Python.

    A ratio is at most 1 less the edits for each letter of both; of fields not in `edited` the difference in length is
    taken, which edits never undercut.
    """
    total, weight = F.lit(0.0), F.lit(0.0)
    for name in WEIGHTS:
        a, b, w = F.col(f"a._length_{name}"), F.col(f"b._length_{name}"), F.least(f"a._weight_{name}", f"b._weight_{name}")
        edits = F.levenshtein(f"a._plain_{name}", f"b._plain_{name}") if name in edited else F.abs(a - b)
        total = total + w * (1 - edits / F.greatest(a + b, F.lit(1)))
        weight = weight + w
    return total / F.greatest(weight, F.lit(1e-9))


def best_matches(extracted: DataFrame, registry: DataFrame, key: str, registry_key: str, *, least: float = 0.8, strict: bool = True) -> DataFrame:
    """MAT-10, MAT-11: for each extracted record the most similar registry record of its year: (key, registry_key, similarity).

    Years are normalised; a record without a year meets all registry years, a registry record without one meets all
    records: blanks are opened into the years of the other side, a list of calendar years, so every comparison comes from
    an equi-join on the year. With strict, pairs that cannot reach the threshold by the lengths of their fields or the
    edits between them are dropped before the ratios are taken: they can neither be a match nor hide one.
    Ties go to the smaller registry key. strict: the best must reach the threshold (lowered by 0.05 for each of finish
    date and expert that is missing, 0.5 at least) and date and expert must agree by 0.7; else the best counts as it is.
    """
    a = _plain(extracted).withColumn("_year", text.year(F.col("year")))
    b = _plain(registry).withColumn("_year", text.year(F.col("year")))
    both = a.select("_year").union(b.select("_year")).distinct().limit(MOST_YEARS + 1).collect()
    if len(both) > MOST_YEARS:
        raise ValueError("the year column holds more values than there are years")
    years = F.array(*[F.lit(y) for y in sorted({r["_year"] for r in both} | {""})])
    # A blank meets each record of the other side once: under the other's own year, or under '' where both are blank.
    opened = lambda df: df.withColumn("_meet", F.explode(F.when(F.col("_year") == "", years).otherwise(F.array("_year", F.lit("")))))
    met = (F.col("a._year") != "") & (F.col("b._year") != "") & (F.col("a._meet") != "") | (F.col("a._year") == "") & (F.col("a._meet") == F.col("b._year")) | (F.col("b._year") == "") & (F.col("b._meet") == F.col("a._year")) & (F.col("a._year") != "")
    left = opened(a).withColumn("_salt", F.pmod(F.xxhash64(key), F.lit(SALTS)).cast("int"))
    right = opened(b).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    missing = reduce(lambda x, y: x + y, [F.lower(F.trim(F.coalesce(F.col(f"a.{c}"), F.lit("")))).isin("", "nan").cast("int") for c in ("finish_date", "expert")])
    threshold = F.greatest(F.lit(0.5), least - 0.05 * missing)
    on = (F.col("a._meet") == F.col("b._meet")) & (F.col("a._salt") == F.col("b._salt")) & met
    if strict:
        # The cheap bound first; conclusions are too long for edits.
        for edited in ((), ("finish_date", "expert"), tuple(n for n in WEIGHTS if n != "conclusion")):
            on = on & (_at_most(edited) >= threshold - 1e-9)
    # Few rows make many pairs: sizes would have them joined in one task.
    pairs = left.alias("a").join(right.hint("merge").alias("b"), on)
    scored = pairs.select(F.col(f"a.{key}").alias("_left"), F.col(f"b.{registry_key}").alias("_right"), weighted_similarity("a", "b").alias("similarity"), similarity.ratio(F.col("a.finish_date"), F.col("b.finish_date")).alias("date_similarity"), similarity.ratio(F.col("a.expert"), F.col("b.expert")).alias("expert_similarity"), threshold.alias("threshold"))
    best = scored.where("similarity > 0").groupBy("_left").agg(F.max_by(F.struct("_right", "similarity", "date_similarity", "expert_similarity", "threshold"), F.struct("similarity", -F.col("_right"))).alias("m"))
    if strict:
        best = best.where("m.similarity >= m.threshold and m.date_similarity >= 0.7 and m.expert_similarity >= 0.7")
    return best.select(F.col("_left").alias(key), F.col("m._right").alias(f"registry_{registry_key}"), "m.similarity")


def enriched(extracted: DataFrame, registry: DataFrame, matches: DataFrame, key: str, registry_key: str, fields: list[str]) -> DataFrame:
    """MAT-12: extracted records with their matched registry values where those are not empty, if the raw years agree."""
    r = registry.select(F.col(registry_key).alias(f"registry_{registry_key}"), F.col("year").alias("_registry_year"), *[F.col(f).alias(f"_r_{f}") for f in fields])
    joined = extracted.join(matches.select(key, f"registry_{registry_key}"), key, "left").join(r, f"registry_{registry_key}", "left")
    same = F.col("_registry_year") == F.col("year")
    return joined.select(key, *[F.when(same, F.coalesce(F.nullif(F.col(f"_r_{f}"), F.lit("")), F.col(f))).otherwise(F.col(f)).alias(f) for f in fields])


def nearby(a: DataFrame, b: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """MAT-22: pairs of points a(a_id, lat, lon) and b(b_id, lat, lon) equal within a tolerance on each axis.

    The plane is cut into cells of the tolerance; b's points are copied into the nine cells around, so the theta join is
    an equi-join on cells.
    """
    cell = lambda c: F.floor(F.col(c) / tolerance)
    left = a.select("a_id", F.col("lat").alias("a_lat"), F.col("lon").alias("a_lon"), cell("lat").alias("y"), cell("lon").alias("x"))
    right = b.select("b_id", F.col("lat").alias("b_lat"), F.col("lon").alias("b_lon"), cell("lat").alias("cy"), cell("lon").alias("cx"))
    right = right.withColumn("dy", F.explode(F.array(*map(F.lit, (-1, 0, 1))))).withColumn("dx", F.explode(F.array(*map(F.lit, (-1, 0, 1)))))
    right = right.select("b_id", "b_lat", "b_lon", (F.col("cy") + F.col("dy")).alias("y"), (F.col("cx") + F.col("dx")).alias("x"))
    close = (F.abs(F.col("a_lat") - F.col("b_lat")) < tolerance) & (F.abs(F.col("a_lon") - F.col("b_lon")) < tolerance)
    return left.join(right, ["y", "x"]).where(close).select("a_id", "b_id")
