"""Pairs within groups of any size: large groups are divided into blocks, and pairs of blocks are joined apart."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Members of a block.
BLOCK = 2_000


def _divided(members: DataFrame, keys: list[str], by: str) -> DataFrame:
    """`members` with `g`, the blocks of their group, and `own`, the block they are in."""
    sizes = members.groupBy(*keys).agg(F.count("*").alias("__n")).where("__n > 1").select(*keys, F.ceil(F.col("__n") / BLOCK).cast("long").alias("g"))
    return members.join(sizes, keys).withColumn("own", F.pmod(F.xxhash64(by), F.col("g")))


def pairs_within(members: DataFrame, keys: list[str], by: str) -> DataFrame:
    """(keys, a, b), a < b: all pairs of different values of column `by` within each group of `keys`.

    A member of a group of g blocks is sent g times, so a pair of blocks is one key and no key holds a whole large group.
    """
    m = _divided(members.select(*keys, by).distinct(), keys, by)
    left = m.select(*keys, F.col(by).alias("x"), F.col("own").alias("lo"), F.explode(F.sequence("own", F.col("g") - 1)).alias("hi"))
    right = m.select(*keys, F.col(by).alias("y"), F.explode(F.sequence(F.lit(0).cast("long"), "own")).alias("lo"), F.col("own").alias("hi"))
    both = left.join(right, [*keys, "lo", "hi"]).where("x <> y and (lo <> hi or x < y)")
    return both.select(*keys, F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def opened(pairs: DataFrame, members: DataFrame, keys: list[str], value: str, row: str) -> DataFrame:
    """(keys, ra, rb): all pairs of rows whose values are one of `pairs` (keys, a, b).

    members: (keys, value, row). Values that many rows carry are divided into blocks like groups.
    """
    sizes = members.groupBy(*keys, value).agg(F.ceil(F.count("*") / BLOCK).cast("long").alias("g"))
    m = members.join(sizes, [*keys, value]).select(*keys, value, row, F.pmod(F.xxhash64(row), F.col("g")).alias("block"))
    of = lambda side: sizes.select(*keys, F.col(value).alias(side), F.col("g").alias(f"g{side}"))
    every = lambda side: F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"g{side}") - 1)).alias(f"block_{side}")
    spread = pairs.join(of("a"), [*keys, "a"]).join(of("b"), [*keys, "b"]).select("*", every("a")).select("*", every("b")).drop("ga", "gb")
    rows = lambda side: m.select(*keys, F.col(value).alias(side), F.col("block").alias(f"block_{side}"), F.col(row).alias(f"r{side}"))
    return spread.join(rows("a"), [*keys, "a", "block_a"]).join(rows("b"), [*keys, "b", "block_b"]).select(*keys, "ra", "rb")
