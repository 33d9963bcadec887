"""Pairs of the members of groups, hot groups spread over many tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Members of one group that a task pairs with the whole group.
BLOCK = 2000


def paired(members: DataFrame, group: list[str], member: str, places: str | None = None) -> DataFrame:
    """(group, a, b): pairs a < b of the distinct members of each group; members(group, member) has no row twice.

    A group's members are paired in blocks: a group with very many is spread by a salt over as many tasks as it has blocks,
    each pairing one block with all of them, so no task sees all pairs of a hot group. With `places`, a sorted array of the
    groups of each member (group is then one column), a pair is given in the least group it shares and in no other: no
    pairs need be shuffled to be told apart.
    """
    sizes = members.groupBy(*group).agg(F.count("*").alias("_n")).where("_n > 1").select(*group, F.ceil(F.col("_n") / BLOCK).cast("int").alias("_blocks"))
    shared = members.join(sizes, group)
    more = [places] if places else []
    one = shared.select(*group, F.col(member).alias("a"), *[F.col(p).alias("_a") for p in more], F.pmod(F.xxhash64(member), F.col("_blocks")).cast("int").alias("_salt"))
    other = shared.select(*group, F.col(member).alias("b"), *[F.col(p).alias("_b") for p in more], F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_salt"))
    pairs = one.join(other, [*group, "_salt"]).where("a < b")
    if places:
        first = (F.size("_a") < 2) | (F.size("_b") < 2) | (F.array_min(F.array_intersect("_a", "_b")) == F.col(group[0]))
        pairs = pairs.where(first)
    return pairs.select(*group, "a", "b")
