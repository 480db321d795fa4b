"""Distributed union-find: connected components of a graph given by its links."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from laneatlas.session import ship, sparing

from .common import remove, shared_dir, written


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same components with fewer links: each node to the smallest node of its component."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    root = list(range(len(nodes)))
    x, y = at[: len(a)].tolist(), at[len(a) :].tolist()
    for i, j in zip(x, y, strict=True):
        while root[i] != i:
            root[i] = i = root[root[i]]
        while root[j] != j:
            root[j] = j = root[root[j]]
        if i < j:
            root[j] = i
        elif j < i:
            root[i] = j
    for i in range(len(root)):
        root[i] = root[root[i]]
    up = np.array(root, np.int64)
    own = up != np.arange(len(nodes))
    return nodes[own], nodes[up[own]]


def local_forests(links: DataFrame, rows: int = 200_000) -> DataFrame:
    """links (a, b), each task's in chunks of some `rows` replaced by their forests."""
    ship(links.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def made():
            t = pa.Table.from_batches(held)
            a, b = forest(t.column(0).to_numpy(), t.column(1).to_numpy())
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= rows:
                yield made()
                held, n = [], 0
        if n:
            yield made()

    return links.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).mapInArrow(sparing(run), "a long, b long")


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of links (a, b): root is the smallest node reachable. Nulls and loops are no links.

    Each task first shrinks its own links to a forest; then large-star and small-star rounds alternate (each node's larger
    neighbours move to its smallest one; then each node's smaller neighbours do) until the links no longer change.
    Minima are summed before the shuffle, and the joins back to a node's links are plain inner joins, which Spark splits
    where one node has most of them. Every round is a table in the shared folder; the one before is removed.
    """
    spark = links.sparkSession
    links = local_forests(links.where("a is not null and b is not null and a <> b"))
    path = shared_dir(spark)
    now = written(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), path)
    sign = lambda df: tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
    before = sign(now)
    for _ in range(most_rounds):
        if not before[0]:
            break
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        nxt = shared_dir(spark)
        now = written(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct(), nxt)
        remove(spark, path)
        path, after = nxt, sign(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"no end after {most_rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
