import itertools

import numpy as np
from pyspark.sql import functions as F

from barrow.llm import packing


def padding(histogram, bounds):
    lengths = np.flatnonzero(histogram)
    return sum((min(b for b in bounds if b >= n) - n) * histogram[n] for n in lengths)


def test_bounds_are_optimal():
    draw = np.random.default_rng(1)
    for _ in range(15):
        histogram = draw.integers(0, 9, 12)
        histogram[0] = 0
        lengths = np.flatnonzero(histogram).tolist()
        for k in (1, 2, 3):
            got = packing.bucket_bounds(histogram, k)
            best = min(padding(histogram, c) for r in range(1, k + 1) for c in itertools.combinations(lengths, r) if c[-1] == lengths[-1])
            assert len(got) <= k and padding(histogram, got) == best
    assert packing.bucket_bounds(np.zeros(5, dtype=int), 3) == []


def test_batches_take_every_item_once():
    bounds, counts = [3, 50, 700, 1500], [1001, 77, 31, 12]
    for mixed in (True, False):
        taken = np.zeros(4, dtype=int)
        for b in packing.batches(bounds, counts, 2048, mixed):
            assert sum(bounds[i] * k for i, k in b.slots.items()) <= 2048
            for i, k in b.slots.items():
                taken[i] += k * b.repeats
        assert taken.tolist() == counts


def test_pack(spark):
    sizes = [None, 0, 1, 50, 100, 101, 250, 200, 100, 99] + [37] * 300
    df = spark.createDataFrame([(i, s, "clash") for i, s in enumerate(sizes)], "id int, size int, container_id string")
    got = packing.pack(df, ["id"], "size", capacity=100, buckets=4).toPandas()
    for i, s in enumerate(sizes):
        own = got[got["id"] == i].sort_values("part_no")
        assert own["n"].sum() == (s or 0) and len(own) == max(1, -(-(s or 0) // 100))
        assert own["start"].tolist() == [100 * k for k in range(len(own))]
    assert got[got["container_id"].isna()]["id"].tolist() == [0, 1] or set(got[got["container_id"].isna()]["id"]) == {0, 1}
    filled = got.groupby("container_id")["n"].sum()
    assert filled.max() <= 100 and sorted(filled.index) == list(range(len(filled)))
    assert packing.pack(df.limit(0), ["id"], "size").count() == 0
    assert packing.pack(df.where("size is null"), ["id"], "size").count() == 1


def test_repeated_keys_are_items_of_their_own(spark):
    df = spark.createDataFrame([(1, 60), (1, 60), (1, 60)], "id int, size int")
    assert packing.pack(df, ["id"], "size", capacity=100)["container_id"] is not None
    assert packing.pack(df, ["id"], "size", capacity=100).select("container_id").distinct().count() == 3


def test_fill_beats_single_buckets(spark):
    draw = np.random.default_rng(7)
    df = spark.createDataFrame([(i, int(n)) for i, n in enumerate(draw.integers(1, 1800, 1500))], "id int, size int")
    used = {m: packing.pack(df, ["id"], "size", mixed=m).agg(F.countDistinct("container_id")).first()[0] for m in (True, False)}
    least = -(-df.agg(F.sum("size")).first()[0] // 2048)
    assert least <= used[True] <= 1.04 * least and used[True] < used[False]


def test_tokens(spark):
    df = spark.createDataFrame([("раскопки",), ("",), (None,)], "t string")
    assert [r[0] > 0 for r in df.select(packing.count_tokens(F.col("t"))).collect()] == [True, False, False]
