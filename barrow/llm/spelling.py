"""Spellings one slip apart (a letter wrong, missing, doubled or swapped), found by equi-joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A name is a plausible reading of another one slip away if it is at least this many times as frequent.
RATIO = 4.0


def slips(name: Column) -> Column:
    """A name and its forms with one letter left out: names one slip apart share at least one."""
    at = F.sequence(F.lit(1), F.length(name))
    left_out = F.transform(at, lambda i: F.concat(F.substring(name, F.lit(1), i - 1), F.substring(name, i + 1, F.length(name))))
    return F.array_distinct(F.concat(F.array(name), left_out))


def one_slip(a: Column, b: Column) -> Column:
    """Whether two names are one letter wrong, missing or added apart, or two letters swapped."""
    edits = F.levenshtein(a, b)
    # Names can also share a form without being one slip apart; only a swap counts as two edits.
    return (edits == 1) | (edits == 2) & (F.sort_array(F.split(a, "")) == F.sort_array(F.split(b, "")))


def near(names: DataFrame, context: list[str], ratio: float) -> DataFrame:
    """(context, name, reading): pairs one slip apart in the same context, the reading at least `ratio` times as frequent.

    names has context columns, name and n (how often), one row for each name. Names of three letters or less have no
    readings. The vocabulary is aggregated first, so the work grows with distinct spellings, not with records.
    """
    opened = names.select(*context, "name", "n", F.explode(slips(F.col("name"))).alias("slip"))
    a, b = opened.alias("a"), opened.alias("b")
    on = [F.col("a.slip") == F.col("b.slip"), *[F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in context], F.col("a.name") != F.col("b.name"), F.col("b.n") >= F.col("a.n") * ratio, F.length("a.name") > 3]
    pairs = a.join(b, reduce(lambda x, y: x & y, on)).where(one_slip(F.col("a.name"), F.col("b.name")))
    return pairs.select(*[F.col(f"a.{c}").alias(c) for c in context], F.col("a.name").alias("name"), F.col("b.name").alias("reading")).distinct()


def readings(names: DataFrame, context: list[str], ratio: float = RATIO) -> DataFrame:
    """near(), and each name as a reading of itself."""
    return near(names, context, ratio).unionByName(names.select(*context, "name", F.col("name").alias("reading")))


def best(names: DataFrame, ratio: float = RATIO, context: tuple[str, ...] = ()) -> DataFrame:
    """(context, name, reading): the most frequent reading of each name, ties to the greatest."""
    counted = readings(names, list(context), ratio).join(names.select(*context, F.col("name").alias("reading"), F.col("n").alias("m")), [*context, "reading"])
    return counted.groupBy(*context, "name").agg(F.max_by("reading", F.struct("m", F.col("reading"))).alias("reading"))
