"""Filling fixed-capacity containers with items (problem 6).

Dynamic programming over the global histogram of lengths chooses the bucket boundaries that waste the least padding; the
histogram has at most `capacity` entries, however many items there are. Token-budget batches are then formed from the
bucket counts alone, inside each bucket; with `mixed` a batch starts in the longest bucket that still has items and goes
on into shorter ones, bucket by bucket, as its budget allows, which leaves less room unused. A batch shape repeats until one of its buckets runs dry, so there are about as many shapes as buckets, and
an item finds its container from its bucket and its rank within it, by arithmetic.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barrow.session import cut

CAPACITY, BUCKETS = 2048, 256
#: Rows that one task ranks: buckets with more are split by a salt that grows with them.
RANKED = 200_000


def default_model() -> str:
    """The model file of the module public_tokenizers, where the environment has it; else the path must be given."""
    try:
        import public_tokenizers
    except ModuleNotFoundError:
        raise ValueError("no module public_tokenizers: give the path of a SentencePiece model") from None

    return public_tokenizers.path("piece_bpe_32k.model")


_loaded: dict[str, object] = {}


def _processor(model: str):
    if model not in _loaded:
        import sentencepiece

        _loaded[model] = sentencepiece.SentencePieceProcessor(model_file=model)
    return _loaded[model]


def count_tokens(text: Column, model: str | None = None) -> Column:
    """Tokens of a text under a SentencePiece model file that every executor can read; null and empty texts have none."""
    path = model or default_model()

    @F.pandas_udf("int")
    def counted(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        processor = _processor(path)
        for texts in parts:
            values = texts.fillna("").tolist()
            sizes: list[int] = []
            for k in range(0, len(values), 64):  # token lists are large; only their lengths stay
                sizes += map(len, processor.encode(values[k : k + 64], num_threads=1))
            yield pd.Series(sizes, dtype="int32")

    return counted(text)


def bucket_bounds(histogram: np.ndarray, buckets: int) -> list[int]:
    """Upper bounds of at most `buckets` length buckets with the least total padding; histogram[n] items have length n.

    f_k(j) = min over i <= j of f_{k-1}(i - 1) + padding of a bucket that holds the lengths v_i..v_j, over the lengths v
    that occur. Exact: padding is a Monge cost, so the best i grows with j, and each layer is solved by halving.
    """
    lengths = np.flatnonzero(histogram)
    lengths = lengths[lengths > 0]
    if len(lengths) <= buckets:
        return lengths.tolist()
    counts = histogram[lengths].astype(np.float64)
    items, tokens = np.concatenate([[0], np.cumsum(counts)]), np.concatenate([[0], np.cumsum(counts * lengths)])
    n = len(lengths)
    last = np.arange(n)
    best = lengths * items[last + 1] - tokens[last + 1]
    came = []
    for _ in range(1, buckets):
        prior = np.concatenate([[np.inf], best[:-1]])
        total, start = _layer(prior, lengths, items, tokens)
        came.append(start)
        best = np.minimum(best, total)
    bounds, j = [], n - 1
    for start in reversed(came):
        bounds.append(int(lengths[j]))
        j = int(start[j]) - 1
        if j < 0:
            break
    else:
        bounds.append(int(lengths[j]))
    return sorted(set(bounds))


def _layer(prior: np.ndarray, lengths: np.ndarray, items: np.ndarray, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least prior[i] + padding(i..j) for every j, and its i. All middles of one halving step are solved together."""
    n = len(lengths)
    best, arg = np.full(n, np.inf), np.zeros(n, dtype=np.int64)
    low, high, first, final = (np.array([v]) for v in (0, n - 1, 0, n - 1))
    while len(low):
        middle = (low + high) // 2
        width = np.minimum(middle, final) - first + 1
        at = np.concatenate([[0], np.cumsum(width)[:-1]])
        i = np.arange(int(width.sum())) - np.repeat(at, width) + np.repeat(first, width)
        j = np.repeat(middle, width)
        cost = prior[i] + lengths[j] * (items[j + 1] - items[i]) - (tokens[j + 1] - tokens[i])
        least = np.minimum.reduceat(cost, at)
        where = np.minimum.reduceat(np.where(cost == np.repeat(least, width), i, n), at)
        best[middle], arg[middle] = least, where
        low, high, first, final = np.concatenate([low, middle + 1]), np.concatenate([middle - 1, high]), np.concatenate([first, where]), np.concatenate([where, final])
        keep = low <= high
        low, high, first, final = low[keep], high[keep], first[keep], final[keep]
    return best, arg


@dataclass(frozen=True)
class Batch:
    """`repeats` containers from `first` on, each with `slots[b]` items of bucket b."""

    first: int
    repeats: int
    slots: dict[int, int]


def batches(bounds: list[int], counts: list[int], capacity: int, mixed: bool = False) -> list[Batch]:
    """Token-budget batches over bucket counts. mixed: a batch may go on into shorter buckets; else it stays in its own."""
    left, out, first = list(counts), [], 0
    longest = len(bounds) - 1
    while longest >= 0:
        if not left[longest]:
            longest -= 1
            continue
        room, slots = capacity, {}
        for b in range(longest, -1, -1) if mixed else [longest]:
            k = min(room // bounds[b], left[b])
            if k:
                slots[b] = k
                room -= k * bounds[b]
        repeats = min(left[b] // k for b, k in slots.items())
        for b, k in slots.items():
            left[b] -= k * repeats
        out.append(Batch(first, repeats, slots))
        first += repeats
    return out


def pack(items: DataFrame, keys: list[str], size: str, capacity: int = CAPACITY, buckets: int = BUCKETS, mixed: bool = False) -> DataFrame:
    """Items in containers: keys, part_no, start, n, container_id.

    An item above the capacity fills containers of its own and its rest is packed like any other item (part_no counts its
    parts from 0, start is the offset of the part); no other item is split. Items of size null or 0 need no space: part 0
    with container_id null. Keys must identify an item; repeated keys are packed as items of their own. Container ids run
    from 0 without gaps: batches first, then full containers of oversized items. Only keys and size are read. The same
    items get the same containers, in whatever order they come.

    One pass for the histogram, one shuffle to fold repeated items, one to rank items within (bucket, salt); the salt, a
    hash of the key, grows with the rows, so a bucket that holds a third of all items is ranked by many tasks.
    """
    picked = items.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.coalesce(F.col(size).cast("int"), F.lit(0)).alias("_n"))
    rest = F.when(F.col("_n") > capacity, F.col("_n") % capacity).otherwise(F.col("_n"))
    table = picked.groupBy(rest.alias("rest")).agg(F.count("*").alias("c"), F.sum((F.col("_n") - rest) / capacity).cast("long").alias("full")).collect()
    histogram = np.zeros(capacity + 1, dtype=np.int64)
    for row in table:
        histogram[row["rest"]] += row["c"]
    histogram[0] = 0
    bounds = bucket_bounds(histogram, buckets)
    edges = np.concatenate([[0], np.cumsum(histogram)])
    counts = [int(edges[hi + 1] - edges[lo + 1]) for lo, hi in zip([0, *bounds[:-1]][: len(bounds)], bounds, strict=True)]
    plan = batches(bounds, counts, capacity, mixed)
    taken, where = [0] * len(bounds), []
    for batch in plan:
        for b, k in batch.slots.items():
            where.append((b, taken[b], taken[b] + k * batch.repeats, batch.first, k))
            taken[b] += k * batch.repeats
    used = plan[-1].first + plan[-1].repeats if plan else 0

    spark = items.sparkSession
    # At most a few shapes per bucket, whatever the data: small by the proof above.
    shapes = spark.createDataFrame(where, "bucket int, low long, high long, first long, k long") if where else spark.createDataFrame([], "bucket int, low long, high long, first long, k long")
    salts = max(1, -(-int(histogram.sum()) // RANKED))
    names = [f"_k{i}" for i in range(len(keys))]
    bucket_of = F.array(*[F.lit(b) for b in np.searchsorted(bounds, np.arange(capacity + 1)).tolist()]) if bounds else F.array(F.lit(0))
    # Repeated items are one row with their number, and are opened again once their ranks are known.
    rests = picked.where(rest > 0).groupBy(*names, "_n", rest.alias("_rest")).agg(F.count("*").alias("_c"))
    rests = cut(rests.withColumn("bucket", F.element_at(bucket_of, F.col("_rest") + 1)).withColumn("salt", F.pmod(F.xxhash64(*names), F.lit(salts)).cast("int")))
    before = F.expr("sum(c) over (partition by bucket order by salt rows between unbounded preceding and current row) - c")
    offsets = rests.groupBy("bucket", "salt").agg(F.sum("_c").alias("c")).select("bucket", "salt", before.alias("offset"))
    own = F.sum("_c").over(Window.partitionBy("bucket", "salt").orderBy(F.desc("_rest"), *names, "_n").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_c")
    ranked = rests.withColumn("own", own).join(offsets, ["bucket", "salt"]).select(*names, "_n", "_rest", "bucket", F.explode(F.sequence(F.col("own") + F.col("offset"), F.col("own") + F.col("offset") + F.col("_c") - 1)).alias("rank"))
    placed = ranked.join(F.broadcast(shapes), "bucket").where("rank >= low and rank < high")
    placed = placed.select(*names, F.floor(F.col("_n") / capacity - F.when(F.col("_n") == capacity, 1).otherwise(0)).cast("int").alias("part_no"), (F.col("_n") - F.col("_rest")).alias("start"), F.col("_rest").alias("n"), (F.col("first") + F.floor((F.col("rank") - F.col("low")) / F.col("k"))).cast("long").alias("container_id"))
    empty = picked.where("_n <= 0").select(*names, F.lit(0).alias("part_no"), F.lit(0).alias("start"), F.lit(0).alias("n"), F.lit(None).cast("long").alias("container_id"))
    out = placed.unionByName(empty)
    full = sum(row["full"] or 0 for row in table)
    if full:
        out = out.unionByName(_oversized(picked.where(F.col("_n") > capacity), names, capacity, used, max(1, -(-full // RANKED))))
    return out.select(*[F.col(f"_k{i}").alias(k) for i, k in enumerate(keys)], "part_no", "start", "n", "container_id")


def _oversized(large: DataFrame, names: list[str], capacity: int, used: int, salts: int) -> DataFrame:
    """The full containers of oversized items, numbered by a prefix sum over salted groups."""
    parts = F.floor(F.col("_n") / capacity).cast("long")
    folded = large.groupBy(*names, "_n").agg(F.count("*").alias("_c")).withColumn("parts", parts).withColumn("salt", F.pmod(F.xxhash64(*names), F.lit(salts)).cast("int"))
    folded = cut(folded)
    offsets = folded.groupBy("salt").agg(F.sum(F.col("parts") * F.col("_c")).alias("c")).select("salt", F.expr("sum(c) over (order by salt rows between unbounded preceding and current row) - c").alias("offset"))
    own = F.sum(F.col("parts") * F.col("_c")).over(Window.partitionBy("salt").orderBy(*names, "_n").rowsBetween(Window.unboundedPreceding, 0)) - F.col("parts") * F.col("_c")
    numbered = folded.withColumn("own", own).join(offsets, "salt")
    copies = numbered.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_c") - 1)).alias("copy"))
    opened = copies.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    number = F.col("own") + F.col("offset") + F.col("copy") * F.col("parts") + F.col("part") + used
    return opened.select(*names, F.col("part").cast("int").alias("part_no"), (F.col("part") * capacity).cast("int").alias("start"), F.lit(capacity).alias("n"), number.cast("long").alias("container_id"))
