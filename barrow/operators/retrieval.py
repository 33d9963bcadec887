"""Vector search and context (RET-02..04), guarded SQL (SRC-21), message history (RET-07, JOI-05)."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barrow.session import cut


#: Bytes of query vectors that every task keeps at once; more queries are asked in several passes.
QUERY_BYTES = 64 << 20


def _best_rows(scores: np.ndarray, k: int) -> list[np.ndarray]:
    """For each row of scores the columns of its k greatest, the earlier ones first among equals; nan is none."""
    scores = np.where(np.isnan(scores), -np.inf, scores)
    n = scores.shape[1]
    if n > 4 * k:
        # The k-th greatest of each row; what ties with it stays, the stable sort decides.
        least = -np.partition(-scores, k - 1, axis=1)[:, k - 1 : k]
    out = []
    for r, row in enumerate(scores):
        at = np.flatnonzero(row >= least[r]) if n > 4 * k else np.arange(n)
        at = at[np.argsort(-row[at], kind="stable")][:k]
        out.append(at[row[at] > -np.inf])
    return out


def _unit(rows: list) -> np.ndarray:
    m = np.stack([np.asarray(v, dtype=np.float64) for v in rows])
    with np.errstate(divide="ignore", invalid="ignore"):
        return m / np.linalg.norm(m, axis=1, keepdims=True)


def top_k(vectors: DataFrame, queries: DataFrame, key: str, vector: str, k: int = 5) -> DataFrame:
    """RET-02: (query_id, key, score, rank): the k rows most similar by cosine to each of queries(query_id, vector).

    The table stays where it is: the queries, of a size that is checked, go to every task, which keeps k rows a query over
    all its rows; only those are shuffled. Queries of more than QUERY_BYTES are asked in several passes over the table.
    Scores are rounded to nine places, ties go to the smaller key. Null, empty and zero vectors match nothing, nor do
    vectors of another length than the query's.
    """
    kinds = dict(queries.dtypes)["query_id"], dict(vectors.dtypes)[key]
    asked = queries.where(F.size("vector") > 0).select("query_id", "vector")
    size = asked.agg(F.sum(F.size("vector"))).first()[0] or 0
    passes = max(1, -(-8 * size // QUERY_BYTES))
    table = vectors.where(F.size(vector) > 0).select(F.col(key).alias("_key"), F.col(vector).alias("_vector"))
    schema = f"query_id {kinds[0]}, _key {kinds[1]}, score double"
    parts = []
    for n in range(passes):
        block = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(passes)) == n).collect()
        by_width: dict[int, tuple[list, np.ndarray]] = {}
        for width in {len(r["vector"]) for r in block}:
            own = [r for r in block if len(r["vector"]) == width]
            by_width[width] = [r["query_id"] for r in own], _unit([r["vector"] for r in own])
        held = vectors.sparkSession.sparkContext.broadcast(by_width)
        parts.append(table.mapInPandas(_asking(held, k), schema))
    return best_of(reduce(DataFrame.unionByName, parts), "query_id", "_key", "score", k).withColumnRenamed("_key", key)


def _asking(held, k: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for pdf in batches:
            lengths = pdf["_vector"].map(len)
            for width, (ids, unit) in held.value.items():
                own = pdf[lengths == width].sort_values("_key", kind="stable")
                if not len(own):
                    continue
                keys = own["_key"].to_numpy(dtype=object)
                scores = np.round(unit @ _unit(own["_vector"].tolist()).T, 9)
                rows = [(row[at], keys[at]) for row, at in zip(scores, _best_rows(scores, k), strict=True)]
                if width in best:
                    for q, ((s0, k0), (s1, k1)) in enumerate(zip(best[width], rows, strict=True)):
                        s, names = np.concatenate([s0, s1]), np.concatenate([k0, k1])
                        at = sorted(range(len(s)), key=lambda i: (-s[i], names[i]))[:k]
                        rows[q] = s[at], names[at]
                best[width] = rows
        for width, rows in best.items():
            ids = held.value[width][0]
            yield pd.DataFrame({"query_id": pd.Series([i for i, (s, _) in zip(ids, rows, strict=True) for _ in s], dtype=object), "_key": pd.Series([x for _, names in rows for x in names], dtype=object), "score": [x for s, _ in rows for x in s]})

    return run


def best_of(scored: DataFrame, group: str, key: str, score: str, k: int) -> DataFrame:
    """The k best of each group, with their rank: a filter that Spark pushes below the shuffle as a group limit."""
    w = Window.partitionBy(group).orderBy(F.desc(score), F.asc(key))
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def context(hits: DataFrame, query: str, rank: str, text: str) -> DataFrame:
    """RET-04: texts of each query's hits in rank order, joined by a rule."""
    ordered = F.transform(F.sort_array(F.collect_list(F.struct(rank, text))), lambda h: h[text])
    return hits.groupBy(query).agg(F.array_join(ordered, "\n\n---\n\n").alias("context"))


def run_sql(spark: SparkSession, sql: str) -> DataFrame:
    """SRC-21: one SELECT statement; anything that could write is refused."""
    bare = re.sub(r"--[^\n]*|/\*.*?\*/", " ", sql, flags=re.S).strip().rstrip(";")
    if ";" in bare or not re.match(r"(?is)^(select|with)\b", bare) or re.search(r"(?is)\b(insert|update|delete|drop|alter|create|truncate|merge|set|refresh|cache)\b", re.sub(r"'[^']*'", "", bare)):
        raise ValueError("only a single SELECT is run")
    return spark.sql(bare)


def histories(messages: DataFrame, chat: str, order: str, columns: list[str]) -> DataFrame:
    """JOI-05: each chat's messages in order as one array, by one aggregate instead of a query per chat.

    A row holds a whole chat; numbered() gives the same order without that.
    """
    return messages.groupBy(chat).agg(F.sort_array(F.collect_list(F.struct(order, *columns))).alias("messages"))


def numbered(messages: DataFrame, chat: str, order: list[str]) -> DataFrame:
    """JOI-05 without an array: messages with their place in their chat, from 1, by `order`, which tells a chat's messages apart.

    Range partitions by chat and order cut a chat of very many messages into many parts; the parts' counts are summed, so no
    task holds a chat. Null chats are one chat.
    """
    parted = cut(messages.repartitionByRange(chat, *order).withColumn("_part", F.spark_partition_id()))
    held = parted.groupBy("_part", chat).agg(F.count("*").alias("_c"))
    before = F.sum("_c").over(Window.partitionBy(chat).orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_c")
    counts = held.select(F.col("_part").alias("_p"), F.col(chat).alias("_k"), before.alias("_before"))
    joined = parted.join(counts, (F.col("_part") == F.col("_p")) & F.col(chat).eqNullSafe(F.col("_k")))
    place = F.row_number().over(Window.partitionBy("_part", chat).orderBy(*order)) + F.col("_before")
    return joined.withColumn("place", place).drop("_part", "_p", "_k", "_before")


def without_last_exchange(messages: DataFrame, chat: str, sender: str, order: str) -> DataFrame:
    """RET-07: the messages of each chat without the last one of each sender."""
    last = messages.groupBy(chat, sender).agg(F.max(order).alias(order))
    return messages.join(last, [chat, sender, order], "left_anti")
