"""Smaller predicates and aggregates (FLT-13, 18..24, AGG-07, 08, 11, 16, MAT-20, UDF-07)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def taken(rows: DataFrame, key: str, wanted: DataFrame, value: str) -> DataFrame:
    """FLT-13: wanted(key, value) whose value another row already has."""
    held = rows.where(F.col(value).isNotNull()).groupBy(value).agg(F.min(key).alias("_lo"), F.max(key).alias("_hi"))
    return wanted.join(held, value).where((F.col("_lo") != F.col(key)) | (F.col("_hi") != F.col(key))).select(key, value)


def selected(points: DataFrame, keys: list[str], chosen: DataFrame) -> DataFrame:
    """FLT-19: points whose composite key 'a-b-c' is among chosen(key)."""
    return points.withColumn("_key", F.concat_ws("-", *[F.col(k).cast("string") for k in keys])).join(chosen.select(F.col("key").alias("_key")).distinct(), "_key", "left_semi").drop("_key")


def has_extension(name: Column, extensions: list[str]) -> Column:
    """FLT-20: whether a file name ends in one of the extensions, case aside."""
    return F.coalesce(F.lower(name).rlike(r"\.(?:" + "|".join(extensions) + ")$"), F.lit(False))


def owned(rows: DataFrame, users: DataFrame, user_id: int, owner: str = "user_id") -> DataFrame:
    """FLT-21: one's own rows; all rows for a superuser; none for an unknown user."""
    me = users.where(F.col("id") == user_id).select("id", F.coalesce("is_superuser", F.lit(False)).alias("_all")).limit(1)
    return rows.join(F.broadcast(me.withColumnRenamed("id", "_me")), F.col("_all") | (F.col(owner) == F.col("_me")), "left_semi")


def readable_words(words: DataFrame) -> DataFrame:
    """FLT-22: recognised words(word, conf) with a confidence of 30 and two letters at least, digits alone allowed."""
    return words.where((F.col("conf") >= 30) & ((F.length(F.trim("word")) >= 2) | F.trim("word").rlike(r"^\d$")))


def needs_reorganising(files: DataFrame, root: str) -> DataFrame:
    """FLT-24: files(path) under root that lie at most two levels deep, or share their folder with another PDF."""
    under = files.where(F.startswith("path", F.lit(f"{root.rstrip('/')}/"))).withColumn("_rel", F.substring("path", len(root.rstrip("/")) + 2, 1_000_000))
    pdfs = F.count_if(F.lower("path").endswith(".pdf")).over(Window.partitionBy(F.regexp_extract("path", r"^(.*)/[^/]*$", 1)))
    return under.withColumn("_n", pdfs).where((F.size(F.split("_rel", "/")) <= 2) | (F.col("_n") > 1)).drop("_rel", "_n")


def agreed_zone(zones: DataFrame, keys: list[str], zone: str) -> DataFrame:
    """AGG-07: the zone that all points of a group share, else wgs84."""
    return zones.groupBy(*keys).agg(F.when(F.min(zone) == F.max(zone), F.min(zone)).otherwise("wgs84").alias(zone))


def adds_up(parts: Column, total: Column, tolerance: float = 1e-9) -> Column:
    """AGG-08: whether an array's sum equals the stated total within a relative tolerance; null is no agreement."""
    got = F.aggregate(parts, F.lit(0.0), lambda s, v: s + F.coalesce(v, F.lit(0.0)))
    return F.coalesce(F.abs(got - total) <= tolerance * F.greatest(F.abs(got), F.abs(total)), F.lit(False))


def first_seen(rows: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """AGG-11: the distinct values of each key in the order they first occur."""
    firsts = rows.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.min(order).alias("_at"))
    return firsts.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("_at", value))), lambda s: s[value]).alias("values"))


def remaining_seconds(elapsed: Column, done: Column, total: Column) -> Column:
    """AGG-16: time left at the pace so far; null before the first is done."""
    return F.when(done > 0, elapsed / done * F.greatest(total - done, F.lit(0)))


def better_text(a: Column, b: Column, keywords: list[str], long_enough: int = 45) -> Column:
    """MAT-20: of two readings the one that alone is long enough, else the one with more of the keywords, ties to the first."""
    score = lambda c: sum((F.when(F.contains(F.lower(c), F.lit(k.lower())), 1).otherwise(0) for k in keywords), F.lit(0))
    la, lb = F.length(F.coalesce(a, F.lit(""))) >= long_enough, F.length(F.coalesce(b, F.lit(""))) >= long_enough
    return F.when(la & ~lb, a).when(lb & ~la, b).when(F.coalesce(score(b), F.lit(0)) > F.coalesce(score(a), F.lit(0)), b).otherwise(F.coalesce(a, b))


def tick_cell(x: Column, y: Column, width: Column, height: Column, columns: int, rows: int) -> Column:
    """UDF-07: number, from 0 along the rows, of the grid cell a tick mark lies in; null outside the form."""
    column, row = F.floor(x / width * columns), F.floor(y / height * rows)
    good = (x >= 0) & (x < width) & (y >= 0) & (y < height)
    return F.when(good, (row * columns + column).cast("int"))
