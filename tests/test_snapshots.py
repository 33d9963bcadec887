import datetime as dt

from pyspark.sql import functions as F

from barrow.operators import snapshots

DAY = dt.datetime(2024, 1, 1)
SCHEMA = "snapshot_no int, loaded_at timestamp, register_num string, doc_name string, is_excluded boolean, key string, change string"


def rows(spark, *given):
    return spark.createDataFrame([(n, DAY + dt.timedelta(hours=h), k, d, x, "clash", "clash") for n, h, k, d, x in given], SCHEMA)


def changes(df):
    return {tuple(r) for r in snapshots.register_changes(df).collect()}


def test_added_removed_changed_over_gaps(spark):
    df = rows(
        spark,
        (1, 0, "оан-1", "А", False), (1, 0, "ОАН–2", "Б", None), (1, 0, None, "без номера", False), (1, 0, "  ", "пусто", False),
        (3, 0, "О А Н — 1", "А  ", False), (3, 0, "ОАН-2", "Б", True), (3, 1, "ОАН-3", None, False),
        (7, 0, "ОАН-3", "", None), (7, 0, "ОАН-2", "Б", True),
    )
    assert changes(df) == {(3, "ОАН-2", "changed"), (3, "ОАН-3", "added"), (7, "ОАН-1", "removed")}


def test_latest_row_holds_and_repeats_fold(spark):
    df = rows(spark, (1, 0, "А-1", "x", False), (2, 5, "А-1", "x", False), (2, 1, "А-1", "y", False), (2, 5, "А-1", "x", False))
    assert changes(df) == set()


def test_comes_back_after_removal(spark):
    df = rows(spark, (1, 0, "А-1", "x", False), (1, 0, "Б", "z", False), (2, 0, "Б", "z", False), (3, 0, "А-1", "x", False), (3, 0, "Б", "z", False))
    assert changes(df) == {(2, "А-1", "removed"), (3, "А-1", "added")}


def test_a_delivery_without_keys_removes_all(spark):
    df = rows(spark, (1, 0, "А-1", "x", False), (2, 0, None, "x", False))
    assert changes(df) == {(2, "А-1", "removed")}


def test_empty_and_single(spark):
    assert changes(rows(spark, (1, 0, "А-1", "x", False)).limit(0)) == set()
    assert changes(rows(spark, (1, 0, "А-1", "x", False))) == set()


def test_merge_state_crosses_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        df = rows(spark, *[(n, 0, f"К-{k}", "x" if n < 3 else "y", False) for k in range(7) for n in (1, 2, 3)])
        assert changes(df) == {(3, f"К-{k}", "changed") for k in range(7)}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_reconcile(spark):
    stored = spark.createDataFrame([(1, None, True), (2, "b", True), (3, "c", False), (3, "c", False)], "k int, v string, gone boolean")
    listed = spark.createDataFrame([(1, None), (4, "d")], "k int, v string")
    out = lambda df: {(r.k, r.v): r.gone for r in df.collect()}
    assert out(snapshots.reconcile(stored, listed, ["k", "v"], "gone")) == {(1, None): False, (2, "b"): True, (3, "c"): True, (4, "d"): False}
    assert out(snapshots.reconcile(stored, listed, ["k", "v"], "gone", sticky=True))[(1, None)] is True
    assert out(snapshots.reconcile(stored, listed.limit(0), ["k", "v"], "gone")) == {(1, None): True, (2, "b"): True, (3, "c"): False}


def test_plan_folds_before_the_shuffle(spark):
    plan = snapshots.register_changes(rows(spark, (1, 0, "a", "x", False), (2, 0, "a", "x", False)))._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" in plan and "Cartesian" not in plan and F is not None
