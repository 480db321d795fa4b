"""SimHash near-deduplication with multi-index hashing."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from laneatlas.session import ship, sparing

from .buckets import many, rests, stars
from .common import meet, with_row_key, written
from .components import components, forest, local_forests

SEED = 42


def simhash(text: str | None, words: int = 4) -> bytes:
    """64 bits, big-endian: bit set if it is set in over half the XXH64 hashes of the word shingles.

    A-Z are lower-cased; words end at ASCII blanks; shingles are `words` words joined by a space, repeats included; a text with
    fewer words is one shingle; one without words has the fingerprint zero.
    """
    parts = (text or "").encode("utf-8", "replace").lower().split()
    n = len(parts)
    if not n:
        return b"\0" * 8
    line = b" ".join(parts)
    if n <= words:
        return xxhash.xxh64_digest(line, SEED)
    sizes = np.fromiter(map(len, parts), np.int64, n)
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[: n - words + 1].tolist()
    digest = xxhash.xxh64_digest
    h = b"".join([digest(line[a:b], SEED) for a, b in zip(starts, ends[words - 1 :].tolist(), strict=True)])
    return fold(h)


def fold(h: bytes) -> bytes:
    """Big-endian 64-bit hashes, one after the other, to the bits that are set in over half of them."""
    bits = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 16):
        bits += np.unpackbits(np.frombuffer(h[i : i + (1 << 16)], np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * bits > len(h) // 8).tobytes()


def fingerprints(docs: DataFrame, words: int = 4, text: str = "text", doc_id: str = "doc_id", row: str | None = None) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long) and, if a row key is named, row."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.frombuffer(b"".join([simhash(t.as_py(), words) for t in batch.column(2)]), ">i8").astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps)], names=["doc_id", "row", "fp"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(row or doc_id).cast("long").alias("row"), F.col(text).alias("text"))
    return rows.mapInArrow(sparing(run), "doc_id long, row long, fp long")


def segments(distance: int, parts: int) -> list[tuple[int, int, int]]:
    """(shift, bits, radius) of each part of a fingerprint. Of two that differ in at most `distance` bits, one part
    differs in at most its radius: with distance = parts * a + b, b + 1 parts have radius a, the others a - 1 (none below 0)."""
    a, b = divmod(distance, parts)
    out, shift = [], 0
    for i in range(parts):
        bits = 64 // parts + (i < 64 % parts)
        out.append((shift, bits, a if i <= b else a - 1))
        shift += bits
    return [s for s in out if s[2] >= 0]


def _balls(bits: int, radius: int) -> list[int]:
    ball = [0]
    for _ in range(radius):
        ball = sorted({m ^ (1 << i) for m in ball for i in range(bits)} | set(ball))
    return ball


def candidates(fps: DataFrame, plan: list[tuple[int, int, int]], distance: int, small: int) -> DataFrame:
    """(part, key, a, b): pairs a < b within `distance` bits from buckets of up to `small` members; b null: a looks into a larger bucket."""

    def entries(i: int, shift: int, bits: int, masks: list[int]):
        key = F.shiftrightunsigned("fp", shift).bitwiseAND(F.lit((1 << bits) - 1))
        return F.transform(F.array(*[F.lit(m).cast("long") for m in masks]), lambda m: F.struct(F.lit(i).alias("part"), key.bitwiseXOR(m).alias("key")))

    own = F.concat(*[entries(i, s, b, [0]) for i, (s, b, _) in enumerate(plan)])
    all_ = F.concat(*[entries(i, s, b, _balls(b, r)) for i, (s, b, r) in enumerate(plan)])
    index = fps.select("fp", F.explode(own).alias("e")).select("e.part", "e.key", F.col("fp").alias("b"))
    probes = fps.select("fp", F.explode(all_).alias("e")).select("e.part", "e.key", F.col("fp").alias("a"))
    sizes = index.groupBy("part", "key").agg(F.count("*").alias("n"))
    full = sizes.where(F.col("n") > small)
    few = index.join(full.select("part", "key"), ["part", "key"], "left_anti")
    tables = few.unionByName(full.select("part", "key", F.lit(None).cast("long").alias("b")))
    near = F.col("b").isNull() | ((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance))
    # Spark takes exploded rows to be as many as their input and would broadcast tens of rows a fingerprint through the driver
    return probes.join(tables.hint("merge"), ["part", "key"]).where(near)


def links(fps: DataFrame, distance: int = 4, parts: int | None = None, small: int = 8, block: int = 2000) -> DataFrame:
    """Links (a, b) between distinct fingerprints that give the components of all pairs within `distance` bits.

    Each part of a fingerprint has a table of buckets (`index`); each fingerprint looks into the buckets within the part's
    radius of its own (`probes`). parts None: as many as give parts of about log2(n) bits, so that a bucket of n spread fingerprints has a
    few members at any n. Buckets of up to `small` members join with their probes one by one and each pair's whole
    distance is verified. Of a larger bucket only its name joins; its members and probes are then compared in blocks of `block` (see
    buckets.py), which give out forests. No pair is lost, and no task holds more than two blocks of a bucket of any size.
    """
    ship(fps.sparkSession)
    if parts is None:
        parts = max(2, min(distance + 1, round(64 / max(12.0, math.log2(max(2, fps.count()))))))
    plan = segments(distance, parts)
    found = written(candidates(fps, plan, distance, small))
    large = found.where("b is null").select("part", "key", "a")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None

        def forests(t: np.ndarray) -> pa.RecordBatch:
            ends = np.flatnonzero((t[1:, :4] != t[:-1, :4]).any(axis=1)) + 1
            a, b = [], []
            for g in np.split(t, ends):
                shift, bits, _ = plan[int(g[0, 0])]
                x, label = g[:, 4], g[:, 5]
                home = (x.view(np.uint64) >> np.uint64(shift) & np.uint64((1 << bits) - 1)).astype(np.int64) == g[0, 1]
                m, own_label = x[home], label[home]
                step = max(1, 2_000_000 // max(1, len(m)))
                for i in range(0, len(x), step):
                    apart = (x[i : i + step, None] ^ m[None, :]).view(np.uint64)  # bitwise_count takes the size of signed numbers
                    u, v = np.nonzero((np.bitwise_count(apart) <= distance) & (label[i : i + step, None] != own_label[None, :]))
                    u, v = forest(x[i : i + step][u], m[v])
                    a.append(u)
                    b.append(v)
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

        for batch in batches:
            t = np.stack([c.to_numpy().astype(np.int64) for c in batch.columns], axis=1)
            t = t if rest is None else np.concatenate([rest, t])
            cut = len(t) - int(np.argmax((t[::-1, :4] != t[-1, :4]).any(axis=1))) if len(t) and (t[:, :4] != t[-1, :4]).any() else 0
            if cut:
                yield forests(t[:cut])
            rest = t[cut:]
        if rest is not None and len(rest):
            yield forests(rest)

    def compared(members: DataFrame) -> DataFrame:
        keys = ["part", "key", "i", "j"]
        return members.select(*keys, "a", "label").repartition(*[F.col(k) for k in keys]).sortWithinPartitions(*keys).mapInArrow(sparing(compare), "a long, b long")

    out = found.where("b is not null").select("a", "b").unionByName(compared(stars(large, ["part", "key"], "a", block).withColumn("label", F.col("a"))))
    if not many(large, ["part", "key"], block):
        return local_forests(out)
    out = written(local_forests(out))
    roots = components(out)
    marked = large.join(roots, large["a"] == roots["node"], "left").select("part", "key", "a", F.coalesce("root", "a").alias("label"))
    return local_forests(out.unionByName(compared(rests(written(marked), ["part", "key"], "a", "label", block))))


def near_duplicates(docs: DataFrame, words: int = 4, distance: int = 4, parts: int | None = None, text: str = "text", doc_id: str = "doc_id", row: str | None = None) -> DataFrame:
    """For every row: doc_id, fp, fingerprint (16 hex digits), component_id (smallest doc_id reachable over links), row, keeper (its row).

    Null texts count as empty; texts without words have the fingerprint zero and are linked like any other. Repeated rows share
    a component. A null doc_id counts as larger than all others; a component of such rows alone has the id null. An empty table
    gives an empty result. Copies are one fingerprint before any comparison, so their number does not matter.
    """
    rows = written(fingerprints(docs, words, text, doc_id, row))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row"))
    nodes = written(rows.groupBy("fp").agg(first.alias("first"), F.count("*").alias("n")))
    found = components(links(nodes.select("fp"), distance, parts))
    joined = nodes.join(found, nodes["fp"] == found["node"], "left").select("fp", "first", "n", F.coalesce("root", "fp").alias("root"))
    named = joined.groupBy("root").agg(F.min("first").alias("best"))
    groups = written(joined.join(named, "root").select("fp", "n", F.col("best.doc_id").alias("component_id"), F.col("best.row").alias("keeper")))
    out = meet(rows, groups, ["fp"], "n", rows.count())
    return out.select("doc_id", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "row", "keeper")


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", **how) -> DataFrame:
    """Of each component (see near_duplicates) the row with the smallest doc_id, all columns."""
    numbered, row = with_row_key(docs, doc_id)
    kept = near_duplicates(numbered, doc_id=doc_id, row=row, **how).where("row = keeper").select(F.col("row").alias(row))
    return numbered.join(kept, row, "left_semi").select(docs.columns)
