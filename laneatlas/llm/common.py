"""What the text operators share: work tables in the shared folder, range partitioning, text clean-up."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six ASCII blanks that count as white space in every operator here.
BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"


_work: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """A fresh path in the folder of spark.checkpoint.dir, which driver and executors share.

    Only where the session has no such setting (tests on one machine) a temporary folder takes its place.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[[^\]]*\])?$", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="laneatlas-")
        spark.conf.set("spark.checkpoint.dir", base)
    _work.append(f"{base.rstrip('/')}/laneatlas-{uuid.uuid4().hex}")
    return _work[-1]


def written(df: DataFrame, path: str | None = None) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = path or shared_dir(spark)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def kept(df: DataFrame) -> DataFrame:
    """Make the rows now and keep them as blocks on the executors' disks, until unpersist() or clearCache(); a lost block is made anew.

    For tables of many partitions that are read from files or a scan: written() starts two processes (`chmod`) for each file on a local disk.
    It cuts no lineage, so don't keep what is made from kept rows: write one of the two.
    """
    df = df.persist(StorageLevel.DISK_ONLY)
    df.count()
    return df


def remove(spark: SparkSession, path: str) -> None:
    """Delete a work table that no later step reads."""
    if path in _work:
        _work.remove(path)
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def work_tables() -> list[str]:
    """The work tables of this process that are still there."""
    return list(_work)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def range_bounds(df: DataFrame, key: str, parts: int) -> list[int]:
    """At most parts - 1 ascending cut points of an integer key; only that column is read."""
    if parts < 2:
        return []
    step = 1.0 / parts
    cuts = df.where(F.col(key).isNotNull()).approxQuantile(key, [step * i for i in range(1, parts)], step / 4)
    return sorted({int(x) for x in cuts})


def in_range(key: str, bounds: list[int]):
    """The number of the range a key lies in (nulls: the first), by binary search over the cut points."""
    if not bounds:
        return F.lit(0)
    cuts = F.array(*[F.lit(b).cast("long") for b in bounds])
    steps = F.array(*[F.lit(1 << s) for s in reversed(range(len(bounds).bit_length()))])
    key = F.col(key)
    return F.aggregate(steps, F.lit(0), lambda lo, s: F.when(F.get(cuts, lo + s - 1) <= key, lo + s).otherwise(lo))


def in_order(docs: DataFrame, key: str = "doc_id", parts: int | None = None, halo: bool = False, tie: str | None = None) -> DataFrame:
    """Deal rows into ranges of an integer key, one range a partition, sorted by it.

    Adds _part (the range) and, with halo, repeats the first row of each range at the end of the range before
    it (the very first row: at the end of the last one) with _halo true, so that each row meets its successor.
    Driver state: one cut point and one first key for each partition.
    """
    spark = docs.sparkSession
    bounds = range_bounds(docs, key, parts or partitions(spark))
    n = len(bounds) + 1
    out = docs.withColumn("_part", in_range(key, bounds)).withColumn("_halo", F.lit(False))
    if halo:
        low = F.struct(F.col(key).isNotNull().alias("a"), F.col(key).alias("b"))
        first = {r[0]: r[1]["b"] for r in docs.select(in_range(key, bounds).alias("p"), low.alias("k")).groupBy("p").agg(F.min("k")).collect()}
        seen = sorted(first)
        if seen:
            before = {p: seen[i - 1] for i, p in enumerate(seen)}
            pairs = spark.createDataFrame([(p, first[p], before[p]) for p in seen], "_part int, _first long, _to int")
            # one row a partition: bounded by the number of partitions
            heads = docs.withColumn("_part", in_range(key, bounds)).join(F.broadcast(pairs), "_part").where(F.col(key).eqNullSafe(F.col("_first")))
            heads = heads.withColumn("_part", F.col("_to")).drop("_first", "_to").withColumn("_halo", F.lit(True))
            out = out.unionByName(heads.select(out.columns))
    return out.repartitionById(n, F.col("_part")).sortWithinPartitions("_halo", F.col(key).asc_nulls_first(), *([tie] if tie else []))


def with_row_key(docs: DataFrame, doc_id: str = "doc_id") -> tuple[DataFrame, str]:
    """docs with a column that tells its rows apart in every later read, and that column's name.

    Where doc_id has no nulls and no repeats, the column is a copy of it. Else rows are numbered and
    written to the shared folder, since numbers given anew at each read need not agree.
    """
    name = "_row"
    while name in docs.columns:
        name += "_"
    n, ids, distinct = docs.agg(F.count("*"), F.count(doc_id), F.countDistinct(doc_id)).first()
    if n == distinct and n == ids:
        return docs.withColumn(name, F.col(doc_id)), name
    return written(docs.withColumn(name, F.monotonically_increasing_id())), name


def meet(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, total: int, hot: float = 0.001) -> DataFrame:
    """rows with the columns of their group (each row has one), without one group filling a partition.

    Groups whose `size` (rows) is above the share `hot` of `total` are fewer than 1/hot and are broadcast; the rest is a plain join.
    """
    limit = max(1000.0, hot * total)
    large = groups.where(F.col(size) > limit)
    rest = rows.join(F.broadcast(large.select(keys)), keys, "left_anti")
    return rows.join(F.broadcast(large), keys).unionByName(rest.join(groups, keys))


def heavy(rows: DataFrame, key: str, share: float = 0.001, least: int = 1000) -> DataFrame:
    """The values of `key` that more than the share `share` of all rows (and more than `least`) have: fewer than 2/share rows, to be broadcast.

    A frequent-items sketch for each partition passes over every row; what is frequent there is summed by value. The errors stay below
    half of `share`, so none above it is missed (some between half and all of it come too). Counts are estimates: use it to deal rows, not for results.
    """
    at = rows.select(F.spark_partition_id().alias("_part"), F.col(key).alias("_key"))
    tops = at.groupBy("_part").agg(F.expr(f"approx_top_k(_key, {int(4 / share)}, {int(16 / share)})").alias("top"), F.count("*").alias("n"))
    parts = tops.select("n", F.explode("top").alias("t")).where(F.col("t.count") > F.col("n") * (share / 4))
    sums = parts.groupBy(F.col("t.item").alias(key)).agg(F.sum("t.count").alias("_n"))
    return sums.where(F.col("_n") > max(float(least), rows.count() * share / 2)).select(key)
