"""Changes of stored rows as new versions of a frame (DML-01..07)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def updated(df: DataFrame, where: Column, values: dict[str, Column]) -> DataFrame:
    """DML-01: rows that meet the predicate with new values; a null predicate is not met."""
    met = F.coalesce(where, F.lit(False))
    return df.withColumns({c: F.when(met, v).otherwise(F.col(c)) for c, v in values.items()})


def deleted(df: DataFrame, where: Column) -> DataFrame:
    """DML-02: the rows that stay; a null predicate deletes nothing."""
    return df.where(~F.coalesce(where, F.lit(False)))


def assigned(df: DataFrame, form: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """DML-03: fields of a form laid over the rows, only where the form has a value."""
    new = form.select(key, *[F.col(f).alias(f"_n_{f}") for f in fields])
    return df.join(new, key, "left").withColumns({f: F.coalesce(f"_n_{f}", f) for f in fields}).drop(*[f"_n_{f}" for f in fields])


def relabelled(supplement: Column, category: str, source: Column, label: Column) -> Column:
    """DML-04: entries of one category with a new source, and a new label where it is not empty."""
    return F.transform_values(supplement, lambda k, v: F.when(k == category, F.transform(v, lambda s: s.withField("source", source).withField("label", F.when(label != "", label).otherwise(s["label"])))).otherwise(v))


def cascade(child: DataFrame, gone: DataFrame, key: str, parent_key: str) -> DataFrame:
    """DML-05: children of deleted parents go too."""
    return child.join(gone.select(F.col(parent_key).alias(key)).distinct(), key, "left_anti")


def nulled(child: DataFrame, gone: DataFrame, key: str, parent_key: str) -> DataFrame:
    """DML-05: children of deleted parents stay, without the reference."""
    dead = gone.select(F.col(parent_key).alias(key), F.lit(True).alias("_dead")).distinct()
    return child.join(dead, key, "left").withColumn(key, F.when(F.col("_dead").isNull(), F.col(key))).drop("_dead").select(*child.columns)


def inserted(df: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """DML-07, AGG-17: rows with new keys above the greatest one (1 for an empty table): unique, not without gaps.

    Gapless numbers would need all rows in one task; a surrogate key only has to be new.
    """
    top = df.agg(F.coalesce(F.max(key), F.lit(0)).alias("_top"))
    numbered = rows.drop(key).withColumn("_n", F.monotonically_increasing_id()).join(F.broadcast(top), F.lit(True)).withColumn(key, (F.col("_top") + F.col("_n") + 1).cast("long")).drop("_n", "_top")
    return df.unionByName(numbered, allowMissingColumns=True)


def appended(rows: DataFrame, key: str, column: str, additions: DataFrame) -> DataFrame:
    """DML-06: rows with the elements of additions(key, element) appended to a JSON list column, in their order.

    Elements are JSON objects as strings; a null or malformed list counts as empty; rows without additions stay as they are.
    """
    more = additions.groupBy(F.col(key).alias("_key")).agg(F.sort_array(F.collect_list("element")).alias("_more"))
    held = F.coalesce(F.from_json(column, "array<string>"), F.array().cast("array<string>"))
    text = F.concat(F.lit("["), F.array_join(F.concat(held, "_more"), ", "), F.lit("]"))
    joined = rows.join(more, rows[key] == more["_key"], "left")
    return joined.withColumn(column, F.when(F.col("_more").isNotNull(), text).otherwise(F.col(column))).drop("_key", "_more")


def merged(earlier: Column, later: Column) -> Column:
    """SET-06: two maps as one, the later's values winning; a null map counts as empty if the other is none."""
    kept = F.map_filter(earlier, lambda k, _: ~F.map_contains_key(later, k))
    return F.when(earlier.isNull(), later).when(later.isNull(), earlier).otherwise(F.map_concat(kept, later))


def upserted(stored: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """SNK-01: stored rows with those of rows in place of theirs, by key, and the new ones beside; both of one shape."""
    return stored.join(rows.select(key), key, "left_anti").select(*stored.columns).unionByName(rows.select(*stored.columns))
