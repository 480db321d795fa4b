"""Near copies by the Jaccard similarity of word shingles: SimHash buckets and bands of MinHash name candidates, each is verified."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from laneatlas.session import ship, sparing

from .buckets import many, rests, stars
from .common import with_row_key, written
from .components import components
from .lines import band_keys
from .simhash import SEED, fold, links

#: Minima in a band; number of bands; rounds over [the SimHash group, the bands]: later ones look only at buckets that still hold several components.
ROWS, BANDS = 4, 20
ROUNDS = ((0, 1), (1, 6), (6, 21))
#: Rows of a bucket that meet in one task.
BLOCK = 500


def shingles(text: str | None, words: int = 5) -> np.ndarray:
    """The distinct XXH64 hashes of the word shingles, ascending; words and shingles are those of simhash()."""
    parts = (text or "").encode("utf-8", "replace").lower().split()
    n = len(parts)
    if not n:
        return np.empty(0, np.uint64)
    line = b" ".join(parts)
    if n <= words:
        return np.array([xxhash.xxh64_intdigest(line, SEED)], np.uint64)
    sizes = np.fromiter(map(len, parts), np.int64, n)
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[: n - words + 1].tolist()
    digest = xxhash.xxh64_digest
    h = b"".join([digest(line[a:b], SEED) for a, b in zip(starts, ends[words - 1 :].tolist(), strict=True)])
    return np.unique(np.frombuffer(h, ">u8").astype(np.uint64))


def bands(own: np.ndarray, seed: int = 5, step: int = 4096) -> np.ndarray:
    """The key of each band of minima over the shingles of a text."""
    rng = np.random.default_rng(seed)
    n = BANDS * ROWS
    factor = rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    shift = rng.integers(0, 1 << 63, n, dtype=np.uint64)
    least = np.full(n, ~np.uint64(0))
    for i in range(0, len(own), step):
        least = np.minimum(least, ((own[i : i + step, None] ^ shift) * factor).min(axis=0))
    return band_keys(least[None, :], ROWS)[0]


def alike(sets: list[np.ndarray], group: list[int], least: float) -> list[tuple[int, int]]:
    """Links (i, j) that join the groups of all pairs with a Jaccard similarity of at least `least`; pairs within a group are not compared.

    Each set is compared with the sets of other groups so far, those nearest in size first; no pair that could join two groups is left out.
    """
    order = sorted(range(len(sets)), key=lambda i: len(sets[i]))
    size = np.array([len(sets[i]) for i in order], np.int64)
    ids = np.unique(np.concatenate([sets[i] for i in order]), return_inverse=True)[1]
    ids = np.split(ids, np.cumsum(size)[:-1])
    label = np.unique(np.array([group[i] for i in order], np.int64), return_inverse=True)[1]
    mark = np.zeros(int(max(x.max() for x in ids)) + 1, bool)
    out = []
    for i in range(1, len(order)):
        low = int(np.searchsorted(size, least * size[i] - 1e-6))
        todo = low + np.flatnonzero(label[low:i] != label[i])[::-1]
        mark[ids[i]] = True
        some = 16
        while len(todo):
            now, todo = todo[:some], todo[some:]
            at = np.cumsum(size[now]) - size[now]
            both = np.add.reduceat(mark[np.concatenate([ids[j] for j in now])], at, dtype=np.int64)
            for j in now[both >= least * (size[now] + size[i] - both)].tolist():
                if label[j] != label[i]:
                    out.append((order[j], order[i]))
                    label[label == label[j]] = label[i]
            todo = todo[label[todo] != label[i]]
            some = min(4 * some, 2048)
        mark[ids[i]] = False
    return out


def similar_links(texts: DataFrame, members: DataFrame, words: int, least: float) -> DataFrame:
    """Links (a, b) between similar rows of one (x, y, i, j); texts: row, text; members: x, y, i, j, row, part (the component so far)."""
    held = members.groupBy("row").agg(F.collect_list(F.struct("x", "y", "i", "j", "part")).alias("w"))
    dealt = texts.join(held.hint("shuffle_hash"), "row").select("row", "text", F.explode("w").alias("w")).select("w.*", "row", "text")
    dealt = dealt.repartition(F.col("x"), F.col("y"), F.col("i"), F.col("j")).sortWithinPartitions("x", "y", "i", "j", "row")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows, parts, sets, out = None, [], [], [], []

        def settle() -> None:
            if len(sets) > 1:
                out.extend((rows[i], rows[j]) for i, j in alike(sets, parts, least))

        for batch in batches:
            for x, y, i, j, part, row, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (x, y, i, j) != now:
                    settle()
                    now, rows, parts, sets = (x, y, i, j), [], [], []
                rows.append(row)
                parts.append(part)
                sets.append(shingles(text, words))
            if out:
                yield _links(out)
                out = []
        settle()
        if out:
            yield _links(out)

    return dealt.mapInArrow(sparing(verify), "a long, b long")


def _open(entries: DataFrame) -> DataFrame:
    """(x, y, row, part) of buckets that hold several components; those with the same members have the same name (x, y), once."""
    mixed = F.xxhash64("row"), F.xxhash64(F.lit(7), "row")
    name = F.bit_xor(mixed[0]).alias("x"), F.bit_xor(mixed[1]).alias("y")
    full = entries.groupBy("band").agg(*name, F.min("part").alias("low"), F.max("part").alias("high")).where("low <> high")
    return entries.join(full.select("band", "x", "y"), "band").select("x", "y", "row", "part").distinct()


def _links(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[k] for x in pairs], pa.int64()) for k in (0, 1)], names=["a", "b"])


def drop_similar(docs: DataFrame, words: int = 5, least: float = 0.8, distance: int = 4, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Of each component of rows whose sets of `words`-word shingles have a Jaccard similarity of `least` or more, the row with the smallest
    doc_id (null last), all columns.

    Candidates come from SimHash over the same shingles, by multi-index hashing (`distance` bits of 64): that joins close copies in one round.
    At a similarity of 0.8 two SimHashes differ in some 10 bits, beyond what small Hamming balls reach, so bands of ROWS minima name the others:
    of pairs at 0.8 that is 1 - (1 - 0.8^4)^20 = 99.997 %, at 0.9 all but 1 in 10^9.
    Every candidate is verified on the 64-bit hashes of its shingles. Rows with equal sets (128 bits of hash) are one before any
    comparison. Buckets of any size are compared in blocks of BLOCK rows. Texts with fewer words are one shingle; those without words
    are equal; null counts as empty; further columns stay, whatever their names. An empty table gives an empty result.
    """
    ship(docs.sparkSession)
    numbered, row = with_row_key(docs, doc_id)
    texts = numbered.select(F.col(row).cast("long").alias("row"), F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, fps, keys = [], [], []
            for t in batch.column(2):
                own = shingles(t.as_py(), words)
                names.append(xxhash.xxh3_128_digest(own.tobytes()))
                fps.append(fold(own.astype(">u8").tobytes()))
                keys.append(bands(own).view(np.int64))
            fps = np.frombuffer(b"".join(fps), ">i8").astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.binary()), pa.array(fps), pa.array(keys, pa.list_(pa.int64()))], names=["row", "doc_id", "name", "fp", "bands"])

    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")
    rows = written(texts.mapInArrow(sparing(sketch), "row long, doc_id long, name binary, fp long, bands array<long>"))
    sets = written(rows.groupBy("name").agg(F.min(F.struct(order.alias("at"), "fp", "bands")).alias("first")).select("first.at.*", "first.fp", "first.bands"))
    near = components(links(sets.select("fp").distinct(), distance))
    group = F.xxhash64(F.lit("simhash"), F.coalesce("root", "fp"))
    nodes = written(sets.join(near, sets["fp"] == near["node"], "left").select("no_id", "doc_id", "row", F.array_prepend("bands", group).alias("bands")))
    every = nodes.select("row", F.explode("bands").alias("band"))
    shared = every.groupBy("band").agg(F.count("*").alias("n")).where("n > 1").select("band")
    # only these texts are dealt in the rounds
    held = written(texts.select("row", "text").join(every.join(shared, "band").select("row").distinct().hint("shuffle_hash"), "row").select("row", "text"))
    found, root = None, None

    def parts() -> DataFrame:
        if root is None:
            return nodes.select("row", "bands", F.col("row").alias("part"))
        return nodes.join(root, nodes["row"] == root["node"], "left").select("row", "bands", F.coalesce("root", "row").alias("part"))

    for a, b in ROUNDS:
        entries = written(_open(written(parts().select("row", "part", F.explode(F.slice("bands", a + 1, b - a)).alias("band")))))
        some = written(similar_links(held, stars(entries, ["x", "y"], "row", BLOCK), words, least))
        found = some if found is None else found.unionByName(some)
        root = components(found)
    entries = written(_open(parts().select("row", "part", F.explode("bands").alias("band"))))
    if many(entries, ["x", "y"], BLOCK):
        found = found.unionByName(written(similar_links(held, rests(entries, ["x", "y"], "row", "part", BLOCK), words, least)))
        root = components(found)
    joined = nodes.join(root, nodes["row"] == root["node"], "left")
    kept = joined.groupBy(F.coalesce("root", "row").alias("root")).agg(F.min(order).alias("first")).select(F.col("first.row").alias(row))
    return numbered.join(kept, row, "left_semi").select(docs.columns)
