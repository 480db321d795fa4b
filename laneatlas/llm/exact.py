"""Exact deduplication by a tree-merge of sorted digest runs, with DataFrame functions only.

Each partition of the input is a leaf; its rows become a run of (digest, smallest candidate) sorted by digest. In each round
`fan_in` neighbouring runs are exchanged to one place and merged by a sort aggregate: equal digests meet, their candidates
are compared and only the best stays. The rounds go on until one logical run is left (the logarithm of the number of partitions), dealt
over all partitions by digest. A group of any size is one row for each run after the first, map-side, step. Spark sorts what an
exchange brings together anew; it has no merge of runs that are sorted already.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, meet, with_row_key, written

_KEY = ["sha", "n_bytes", "check"]


def digests(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", row: str | None = None) -> DataFrame:
    """doc_id, row (unique), run (its partition), sha (of the text without blanks), n_bytes and check (a second, independent hash)."""
    plain = F.translate(F.coalesce(F.col(text), F.lit("")), BLANKS, "")
    base = docs.select(F.col(doc_id).alias("doc_id"), F.char_length(F.coalesce(F.col(text), F.lit(""))).cast("long").alias("size"), plain.alias("plain"), (F.col(row) if row else F.monotonically_increasing_id()).alias("row"))
    return base.select(
        "doc_id", "size", "row", F.spark_partition_id().alias("run"),
        F.unhex(F.sha2("plain", 256)).alias("sha"), F.octet_length("plain").alias("n_bytes"), F.xxhash64("plain").alias("check"),
    )


def merged(rows: DataFrame, leaves: int, fan_in: int = 4) -> DataFrame:
    """One row a distinct digest: best (the row that stays) and group_size. Digests count as equal when SHA-256, byte
    length and xxHash64 of the normalised text all agree, which each level verifies as all three are its key."""
    best = F.struct((-F.col("size")).alias("shorter"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")
    runs = rows.groupBy("run", *_KEY).agg(F.min(best).alias("best"), F.count("*").alias("group_size"))
    width = 1
    while width < leaves:
        width *= fan_in
        runs = runs.withColumn("run", (F.col("run") / F.lit(fan_in)).cast("int"))
        runs = runs.groupBy("run", *_KEY).agg(F.min("best").alias("best"), F.sum("group_size").alias("group_size"))
    return runs.drop("run")


def exact_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", fan_in: int = 4, hot: float = 0.001, row: str | None = None) -> DataFrame:
    """For every row: doc_id, keep_id, group_size, kept, text_sha256 (and size, row).

    Texts are equal when they agree after deletion of blanks; null counts as empty, so null and blank texts are one
    group. Of a group the longest original stays, then the smallest doc_id (null last), then, among repeated rows
    with one doc_id, the first read. An empty table gives an empty result; further columns are ignored, whatever their names.
    Groups of more than the share `hot` of all rows (1/hot at most) meet their rows by broadcast, all others by a shuffle on
    the digest, so no group fills a partition.
    """
    rows = written(digests(docs, text, doc_id, row))
    n, top = rows.agg(F.count("*"), F.coalesce(F.max("run"), F.lit(0))).first()
    groups = written(merged(rows, top + 1, fan_in))
    groups = groups.select(*_KEY, F.col("best.doc_id").alias("keep_id"), F.col("best.row").alias("keep_row"), "group_size")
    out = meet(rows, groups, _KEY, "group_size", n, hot)
    return out.select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"), "size", "row")


def drop_exact_duplicates(docs: DataFrame, doc_id: str = "doc_id", **how) -> DataFrame:
    """The rows of docs that stay, with all their columns; of repeated rows one."""
    numbered, row = with_row_key(docs, doc_id)
    kept = exact_duplicates(numbered, doc_id=doc_id, row=row, **how).where("kept").select(F.col("row").alias(row))
    return numbered.join(kept, row, "left_semi").select(docs.columns)
