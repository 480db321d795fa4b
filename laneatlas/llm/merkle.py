"""A Merkle manifest of a dataset by parent-preimage paths.

Every row is a leaf; per source, runs of FAN leaves hash to a parent until one node is left, and the subroots of the sources do the same. For
each parent the preimage, its children's digests side by side, is stored. A leaf gets the preimages of its ancestors by joins from the root
downwards (a parent's row carries those above it). Cutting its own 64 characters out of a preimage leaves the siblings, the proof;
putting another digest in their place and hashing gives the parent that a changed row would have.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import kept, partitions, written

#: Children of a parent, and hexadecimal characters of a digest.
FAN, WIDE = 16, 64
_BITS = FAN.bit_length() - 1


def field(value: Column) -> Column:
    """`-` if null, else the UTF-8 byte count, `:` and the value (integers in decimals)."""
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf_of(columns: list[Column]) -> Column:
    """The digest of a row: SHA-256, lowercase hexadecimal, of all its fields."""
    return F.sha2(F.concat(*[field(c) for c in columns]), 256)


def placed(rows: DataFrame, order: list[str], group: str = "_key") -> DataFrame:
    """rows with _at, their place from 0 within `group` by `order` (nulls first), and _n, the size of the group, without a window over a group.

    rows, which are read twice, are dealt into ranges of (group, order) and written; a place is the rank in the range's run of the group and the rows
    of the group in earlier ranges. The runs are one row for each range and one for each group.
    """
    dealt = rows.repartitionByRange(partitions(rows.sparkSession), group, *order).sortWithinPartitions(group, *order)
    dealt = written(dealt.withColumn("_row", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_row", 33)))
    runs = dealt.groupBy(group, "_part").agg(F.min("_row").alias("_first"), F.count("*").alias("_c"))
    own = Window.partitionBy(group)
    runs = runs.withColumn("_before", F.sum("_c").over(own.orderBy("_part")) - F.col("_c")).withColumn("_n", F.sum("_c").over(own))
    out = dealt.join(runs.drop("_c"), [group, "_part"])
    return kept(out.withColumn("_at", F.col("_row") - F.col("_first") + F.col("_before")).drop("_row", "_part", "_first", "_before"))


def levels(nodes: DataFrame, most: int) -> list[DataFrame]:
    """The parents of nodes (_key, _at, _n, _hash), level by level: _key, _at, _n (nodes of that level) and _pre (the preimage), as long as a group has
    several nodes. `most` is the largest _n. Each level is written: a sixteenth of the rows below it, by a sixteenth of
    the tasks."""
    out, tasks = [], partitions(nodes.sparkSession)
    while most > 1:
        tasks = -(-tasks // FAN)
        child = nodes.where("_n > 1")
        made = child.groupBy("_key", F.shiftright("_at", _BITS).alias("_at")).agg(F.array_sort(F.collect_list(F.struct("_at", "_hash"))).alias("_c"), F.first("_n").alias("_n"))
        made = made.select("_key", "_at", F.ceil(F.col("_n") / FAN).cast("long").alias("_n"), F.array_join("_c._hash", "").alias("_pre"))
        out.append(written(made.coalesce(tasks)))
        nodes = out[-1].select("_key", "_at", "_n", F.sha2("_pre", 256).alias("_hash"))
        most = -(-most // FAN)
    return out


def tops(nodes: DataFrame, above: list[DataFrame]) -> DataFrame:
    """_key and _hash of the node that remains of each group."""
    out = nodes.where("_n = 1").select("_key", "_hash")
    for parents in above:
        out = out.unionByName(parents.where("_n = 1").select("_key", F.sha2("_pre", 256).alias("_hash")))
    return out


def ancestors(nodes: DataFrame, above: list[DataFrame], heads: DataFrame) -> DataFrame:
    """nodes with the columns of `heads` (one row for each _key) and _path: the preimages of their ancestors in the group, from the parent up (empty for a lone node).

    Joined from the top: the last parent of a group, which stands alone, takes the group's row of heads, each lower one the path and those columns of its
    own parent. So no key meets more than FAN rows, however large a group is.
    """

    def under(rows: DataFrame, upper: DataFrame | None, own: Column) -> DataFrame:
        """The lone rows with their heads, the others with what their parent has; own: what a row adds to the path."""
        out = rows.where("_n = 1").join(heads, "_key").withColumn("_path", own)
        if upper is None:
            return out
        up = upper.withColumnRenamed("_at", "_up").withColumnRenamed("_path", "_above")
        inner = rows.where("_n > 1").withColumn("_up", F.shiftright("_at", _BITS)).join(up, ["_key", "_up"])
        return out.unionByName(inner.withColumn("_path", F.concat(own, "_above")).select(out.columns))

    upper = None
    for parents in reversed(above):
        upper = under(parents, upper, F.array("_pre")).drop("_n", "_pre")
    return under(nodes, upper, F.array().cast("array<string>"))


def _slot(at: Column, level: Column) -> Column:
    """Where in the preimage of its ancestor at `level` (0: the parent) the digest of a node's branch begins."""
    return F.pmod(F.call_function("shiftright", at, level * _BITS), F.lit(FAN)).cast("int") * WIDE


def siblings(path: Column, at: Column) -> Column:
    """All siblings' digests from the leaf's level up: each preimage without the branch's own slot."""
    cut = lambda pre, i: F.concat(F.substring(pre, F.lit(1), _slot(at, i)), F.substring(pre, _slot(at, i) + 1 + WIDE, F.lit(FAN * WIDE)))
    return F.array_join(F.transform(path, cut), "")


def folded(path: Column, at: Column, start: Column) -> Column:
    """The digest at the top when the branch begins with `start`: it replaces its slot, the preimage is hashed, level by level."""
    steps = F.transform(path, lambda pre, i: F.struct(pre.alias("pre"), _slot(at, i).alias("slot")))
    return F.aggregate(steps, start, lambda acc, s: F.sha2(F.overlay(s["pre"], acc, s["slot"] + 1, F.lit(WIDE)), 256))


def manifest(docs: DataFrame, fields: list[str], doc_id: str = "doc_id", source: str = "source", changed: dict[str, Column] | None = None) -> DataFrame:
    """Per row: doc_id, leaf, subroot, root, proof_sha256 (of all siblings), folded_root and verified.

    folded_root comes from the row's leaf with the columns of `changed` in place of its own, and its original siblings; verified tells whether it
    is the root. A leaf is the digest of `fields`. Sources ascend by their UTF-8 bytes, null first, and are told apart from the empty string; in a source
    rows ascend by doc_id, null first, then by leaf, so repeated rows are leaves of their own, side by side. Null fields and texts of any length have the
    coding of `field`. An empty table gives an empty result. Further columns are ignored, whatever their names.
    """
    other = changed or {}
    leaf, new = leaf_of([F.col(c) for c in fields]), leaf_of([other.get(c, F.col(c)) for c in fields])
    key = F.coalesce(F.concat(F.lit("s"), F.col(source)), F.lit(""))
    rows = kept(docs.select(F.col(doc_id).alias("_id"), key.alias("_key"), leaf.alias("_hash"), new.alias("_new")))
    nodes = placed(rows, ["_id", "_hash"])
    rows.unpersist()
    most = nodes.agg(F.max("_n")).first()[0]
    if most is None:
        return nodes.select(F.col("_id").alias(doc_id), *[F.col("_hash").alias(c) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")], F.lit(True).alias("verified"))
    above = levels(nodes, most)
    subroots = placed(written(tops(nodes, above).select(F.lit("").alias("_key"), F.col("_key").alias("_source"), "_hash")), ["_source"])
    over = levels(subroots, subroots.agg(F.max("_n")).first()[0])
    heads = ancestors(subroots, over, tops(subroots, over).select("_key", F.col("_hash").alias("root")))
    heads = written(heads.select(F.col("_source").alias("_key"), F.col("_hash").alias("subroot"), F.col("_at").alias("_place"), F.col("_path").alias("_over"), "root"))
    out = ancestors(nodes, above, heads)
    path, at, over_path, place = F.col("_path"), F.col("_at"), F.col("_over"), F.col("_place")
    proof = F.sha2(F.concat(siblings(path, at), siblings(over_path, place)), 256)
    out = out.withColumn("folded_root", folded(over_path, place, folded(path, at, F.col("_new"))))
    return out.select(F.col("_id").alias(doc_id), F.col("_hash").alias("leaf"), "subroot", "root", proof.alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
