"""What changed between full snapshots (core problem 4), and snapshot reconciliation (MAT-14, MAT-15)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Everything that is white space to a reader, non-breaking and zero-width kinds included.
SPACE = r"[\s\p{Z}\x{0085}\x{200B}\x{FEFF}]+"
#: Every kind of dash, the minus sign included.
DASH = r"[\p{Pd}\x{2212}]"


def register_key(number: Column) -> Column:
    """Upper case, no white space, every dash as '-'; null where nothing is left."""
    bare = F.regexp_replace(F.regexp_replace(F.upper(number), SPACE, ""), DASH, "-")
    return F.when(bare != "", bare)


def one_spaced(text: Column) -> Column:
    """Runs of white space as one space, none at the ends, null as ''."""
    return F.coalesce(F.trim(F.regexp_replace(text, SPACE, " ")), F.lit(""))


def hold_latest(rows: DataFrame, keys: list[str], latest: str, values: list[str]) -> DataFrame:
    """Of the rows with equal keys, the one with the greatest `latest` (ties: the greatest values, so the choice is stable).

    A plain aggregate: repeated rows fold on the map side, so a key that stands in a third of all rows does not skew.
    """
    held = F.max(F.struct(F.col(latest), *[F.col(v) for v in values]))
    return rows.groupBy(*keys).agg(held.alias("_held")).select(*keys, *[F.col(f"_held.{v}").alias(v) for v in values])


def _merge_runs(values: list[str], last: int):
    """Streams a range sorted by (key, turn) and emits typed changes; state is the one row carried between batches.

    A run of equal keys holds one cursor per delivery; stepping through it is the two-pointer merge of each delivery with
    the one before: turns i and i+1 side by side compare columns, a gap is a removal and a later addition.
    """

    def emit(key, turn, *columns, carry, final):
        # Row i is compared with its neighbours; arrays hold the carried row first.
        if carry is not None:
            key = np.concatenate([[carry[0]], key])
            turn = np.concatenate([[carry[1]], turn])
            columns = tuple(np.concatenate([[c], v]) for c, v in zip(carry[2:], columns, strict=True))
        n = len(key)
        out: list[tuple[np.ndarray, np.ndarray, str]] = []
        if n == 0:
            return out, None
        same = key[1:] == key[:-1]
        step = same & (turn[1:] == turn[:-1] + 1)
        differs = np.zeros(n - 1, dtype=bool)
        for v in columns:
            differs |= v[1:] != v[:-1]
        out.append((key[1:][step & differs], turn[1:][step & differs], "changed"))
        # A row without a direct predecessor was added, unless it belongs to the first delivery. The carried row (or the
        # first row ever) was judged when it came in, so only rows after index 0 count, or all when nothing was carried.
        fresh = np.concatenate([[carry is None], ~step])
        added = fresh & (turn > 0)
        out.append((key[added], turn[added], "added"))
        # A row without a direct successor was removed in the next delivery, unless it belongs to the last one. The final
        # row of a batch is judged with the next batch.
        lone = np.concatenate([~step, [final]])
        gone = lone & (turn < last)
        out.append((key[gone], turn[gone] + 1, "removed"))
        return out, (key[-1], turn[-1], *[v[-1] for v in columns])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        carry = None
        for pdf in batches:
            if len(pdf) == 0:
                continue
            arrays = [pdf[c].to_numpy(dtype=object) for c in values]
            out, carry = emit(pdf["_key"].to_numpy(dtype=object), pdf["_turn"].to_numpy(), *arrays, carry=carry, final=False)
            found = [(k, t, c) for k, t, c in out if len(k)]
            if found:
                keys, turns = np.concatenate([k for k, _, _ in found]), np.concatenate([t for _, t, _ in found])
                kinds = np.repeat(np.array([c for _, _, c in found], dtype=object), [len(k) for k, _, _ in found])
                yield pd.DataFrame({"_turn": turns, "_key": pd.Series(keys, dtype=object), "change": pd.Series(kinds, dtype=object)})
        if carry is not None and carry[1] < last:
            yield pd.DataFrame({"_turn": [carry[1] + 1], "_key": [carry[0]], "change": ["removed"]})

    return run


def snapshot_changes(snapshots: DataFrame, *, key: Column, snapshot: str, loaded: str, compare: dict[str, Column]) -> DataFrame:
    """Typed changes (added, removed, changed) of each delivered snapshot against the delivered one before it.

    snapshots: full deliveries of a table; `key` identifies a record, rows without it take no part; `snapshot` numbers the
    deliveries (gaps allowed); within a delivery the row with the latest `loaded` holds (null counts as earliest, ties go
    to the greatest compared values); `compare` names the columns that make a record 'changed', as expressions that are
    never null. Returns (snapshot, key, change), no row twice.

    Empty input gives no rows; a single delivery gives none either; rows without a snapshot number are left out. Columns
    beyond those named are never read, so extra or clashing names do no harm.

    Plan: one aggregate on (delivery, key) that folds repeats before the shuffle, then one range shuffle on the key, sorted
    within each range; each range streams through a two-pointer merge that keeps one row of state. The list of deliveries
    is small by nature (one entry per delivery) and is read from the aggregate's input columns only.
    """
    picked = snapshots.select(
        F.col(snapshot).cast("long").alias("_snapshot"), key.alias("_key"), F.col(loaded).alias("_loaded"), *[e.alias(f"_c_{n}") for n, e in compare.items()]
    ).where(F.col("_key").isNotNull() & F.col("_snapshot").isNotNull())
    values = [f"_c_{n}" for n in compare]
    # A delivery whose rows all lack a key still is a delivery, so the list comes from the table, not from `picked`.
    deliveries = sorted(r[0] for r in snapshots.select(F.col(snapshot).cast("long").alias("s")).where("s is not null").distinct().collect())
    turn = F.create_map(*[F.lit(x) for pair in ((s, i) for i, s in enumerate(deliveries)) for x in pair]) if deliveries else None
    spark = snapshots.sparkSession
    kind = dict(snapshots.dtypes)[snapshot]
    schema = f"`{snapshot}` {kind}, `key` string, `change` string"
    if len(deliveries) < 2:
        return spark.createDataFrame([], schema)
    held = hold_latest(picked, ["_snapshot", "_key"], "_loaded", values)
    ordered = (
        held.select("_key", turn[F.col("_snapshot")].cast("int").alias("_turn"), *[F.col(v).cast("string").alias(v) for v in values])
        .repartitionByRange("_key")
        .sortWithinPartitions("_key", "_turn")
    )
    merged = ordered.mapInPandas(_merge_runs(values, len(deliveries) - 1), "_turn int, _key string, change string")
    back = F.array(*[F.lit(s) for s in deliveries])
    return merged.select(F.element_at(back, F.col("_turn") + 1).cast(kind).alias(snapshot), F.col("_key").alias("key"), "change")


def register_changes(snapshots: DataFrame) -> DataFrame:
    """snapshot_changes of the heritage register: (snapshot_no, register_num, change)."""
    return snapshot_changes(
        snapshots,
        key=register_key(F.col("register_num")),
        snapshot="snapshot_no",
        loaded="loaded_at",
        compare={"doc_name": one_spaced(F.col("doc_name")), "is_excluded": F.coalesce(F.col("is_excluded"), F.lit(False))},
    ).withColumnRenamed("key", "register_num")


def reconcile(stored: DataFrame, snapshot: DataFrame, keys: list[str], flag: str, *, sticky: bool = False) -> DataFrame:
    """Stored rows against a full list (MAT-14; sticky: MAT-15), as (keys, flag).

    A stored row absent from the list is flagged; one that is present is unflagged, or keeps its flag if sticky; a listed
    row that is not stored comes in unflagged. Keys compare null-safe, so two nulls are equal. Repeated stored keys count
    once and are flagged if any was. An empty list leaves the stored flags as they are: it is a failed delivery, not an
    empty register. Columns other than keys and flag are not read.
    """
    old = stored.groupBy(*keys).agg(F.max(F.coalesce(F.col(flag), F.lit(False))).alias("_old"), F.lit(True).alias("_stored"))
    new = snapshot.select(*keys).distinct().withColumn("_listed", F.lit(True))
    # Null-safe equality as one grouped union rather than a join: equal keys, nulls included, fall into one group.
    both = old.select(*keys, "_old", F.lit(1).alias("_s"), F.lit(0).alias("_n")).unionByName(new.select(*keys, F.lit(None).cast("boolean").alias("_old"), F.lit(0).alias("_s"), F.lit(1).alias("_n")))
    joined = both.groupBy(*keys).agg(F.max("_old").alias("_old"), F.max("_s").alias("_s"), F.max("_n").alias("_n"))
    if snapshot.isEmpty():
        return joined.where("_s > 0").select(*keys, F.col("_old").alias(flag))
    kept = F.col("_old") if sticky else F.lit(False)
    return joined.select(*keys, F.when(F.col("_n") == 0, F.lit(True)).when(F.col("_s") == 0, F.lit(False)).otherwise(kept).alias(flag))
