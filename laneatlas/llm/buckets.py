"""Dealing the members of candidate buckets to tasks, so that a bucket of any size is compared in bounded blocks.

First each bucket is cut into blocks of some `most` members; its smallest member stands in every block, so a bucket of near copies is linked
through it in one pass, linear in its size. Then, of buckets of several blocks that still hold more than one component, each
member outside the largest component meets all members: block by block, each pair of blocks a task's work. No pair of different
components is left out, and no task holds more than two blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _block(member: str, n: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit(3), member), n).cast("int")


def stars(entries: DataFrame, keys: list[str], member: str, most: int) -> DataFrame:
    """entries (keys, member, ...) of buckets of several members, with block i = j from 0; the smallest member is in all blocks of its bucket."""
    sizes = entries.groupBy(*keys).agg(F.count("*").alias("_n"), F.min(member).alias("_lead")).where("_n > 1")
    blocks = F.ceil(F.col("_n") / most).cast("int")
    own = F.when(F.col(member) == F.col("_lead"), F.sequence(F.lit(0), blocks - 1)).otherwise(F.array(_block(member, blocks)))
    return entries.join(sizes, keys).withColumn("i", F.explode(own)).withColumn("j", F.col("i")).drop("_n", "_lead")


def rests(entries: DataFrame, keys: list[str], member: str, label: str, most: int) -> DataFrame:
    """Of buckets of more than `most` members whose labels differ, the members with the pairs of blocks (i, j) in which each meets others."""
    parts = entries.groupBy(*keys, label).agg(F.count("*").alias("_c"))
    sums = parts.groupBy(*keys).agg(F.sum("_c").alias("_n"), F.max(F.struct("_c", label)).alias("_top"), F.count("*").alias("_k")).where((F.col("_n") > most) & (F.col("_k") > 1))
    inside = F.ceil(F.col("_top._c") / most).cast("int")
    outside = F.ceil((F.col("_n") - F.col("_top._c")) / most).cast("int")
    in_top = F.col(label) == F.col(f"_top.{label}")
    own = F.when(in_top, outside + _block(member, inside)).otherwise(_block(member, outside))
    others = F.sequence(F.lit(0), F.when(in_top, outside - 1).otherwise(outside + inside - 1))
    out = entries.join(sums, keys).withColumn("_own", own).withColumn("_other", F.explode(others))
    return out.withColumn("i", F.least("_own", "_other")).withColumn("j", F.greatest("_own", "_other")).drop("_n", "_top", "_k", "_own", "_other")


def many(entries: DataFrame, keys: list[str], most: int) -> bool:
    """Whether some bucket has more than one block."""
    return entries.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > most).limit(1).count() > 0
