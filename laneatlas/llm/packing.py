"""Packing of tokenised documents into windows by minimum bin slack over a histogram of piece lengths."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from laneatlas.session import ship, sparing

from .common import partitions, written
from .tokens import slices, tokenizer

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def pieces(docs: DataFrame, capacity: int = 2048, tokenizer_path: str | None = None, end_id: int = 1, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Documents as ids with the end id, cut into whole windows and one rest. Null texts are empty: the end id alone."""

    ship(docs.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer(tokenizer_path, end_id=end_id)
        for batch in batches:
            texts, names = batch.column(1).to_pylist(), batch.column(0)
            for a, b in slices(texts, 2_000_000):
                rows = []
                for k, ids in zip(range(a, b), own.encode(texts[a:b]), strict=True):
                    n = len(ids) // 4
                    rows += [(k, s, min(capacity, n - s), zlib.crc32(memoryview(ids)[4 * s : 4 * (s + capacity)]), n) for s in range(0, n, capacity)]
                m = np.array(rows, np.int64).reshape(-1, 5)
                yield pa.RecordBatch.from_arrays([names.take(pa.array(m[:, 0])), *(pa.array(m[:, j]) for j in range(1, 5))], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(sparing(cut), PIECES)


def fill(counts: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Patterns (times, [(length, copies)]) that use up the histogram, longest first.

    Each window opens with the longest length left; the subset sums of what is left are bits of an integer, grown one
    length at a time (each length as often as it fits and is there) until the window is full to the brim or no
    length is left; the sum closest to capacity is traced back to counts. A pattern repeats while its counts last, so the
    work depends on the number of lengths, not of pieces.
    """
    left = {n: c for n, c in counts.items() if c > 0 and 0 < n <= capacity}
    order = sorted(left, reverse=True)
    plan = []
    while order:
        first = order[0]
        room = capacity - first
        full = 1 << room
        mask = (full << 1) - 1
        reach, layers = 1, []
        for n in order:
            if reach & full:
                break
            if n > room:
                continue
            have = min(left[n] - (n == first), room // n)
            before = reach
            for _ in range(have):
                more = (reach | reach << n) & mask
                if more == reach:
                    break
                reach = more
            layers.append((n, before, have))
        total = reach.bit_length() - 1
        used = {first: 1}
        for n, before, have in reversed(layers):
            k = 0
            while not before >> total & 1:
                total -= n
                k += 1
            if k:
                used[n] = used.get(n, 0) + k
        times = min(left[n] // k for n, k in used.items())
        plan.append((times, sorted(used.items(), reverse=True)))
        for n, k in used.items():
            left[n] -= k * times
        order = [n for n in order if left[n]]
    return plan


def places(plan: list[tuple[int, list[tuple[int, int]]]]) -> np.ndarray:
    """Rows (length, first rank, copies, first sequence, first offset), sorted: where the pieces of a length go by their rank."""
    rank: dict[int, int] = {}
    rows, sequence = [], 0
    for times, used in plan:
        offset = 0
        for n, k in used:
            rows.append((n, rank.get(n, 0), k, sequence, offset))
            rank[n] = rank.get(n, 0) + k * times
            offset += n * k
        sequence += times
    rows.sort()
    return np.array(rows, np.int64).reshape(-1, 5)


def pack(cut: DataFrame, capacity: int = 2048) -> DataFrame:
    """Pieces plus sequence_id and offset, gapless from 0 in each sequence.

    The driver sees one count for each length (capacity at most). Pieces of one length, even if they are most of all
    rows, are ranked in as many groups as there are shuffle partitions. An empty table gives an empty result;
    repeated documents are packed each for itself; a piece that is empty or longer than capacity raises ValueError.
    """
    salt = F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(partitions(cut.sparkSession)))
    cut = written(cut.withColumn("_salt", salt))
    sums = cut.groupBy("length", "_salt").agg(F.count("*").alias("n"))
    odd = sums.where(F.col("length").isNull() | ~F.col("length").between(1, capacity)).first()
    if odd:
        raise ValueError(f"a piece of {odd['length']} ids does not fit into {capacity}")
    counts = {r[0]: r[1] for r in sums.where(F.col("length").between(1, capacity)).groupBy("length").agg(F.sum("n")).collect()}
    table = places(fill(counts, capacity))
    shared = cut.sparkSession.sparkContext.broadcast(table)  # a few rows for each length: bounded by capacity
    upto = F.sum("n").over(Window.partitionBy("length").orderBy("_salt"))
    first = sums.select("length", "_salt", (upto - F.col("n")).alias("_first"))
    number = F.row_number().over(Window.partitionBy("length", "_salt").orderBy("doc_id", "start", "ids_crc32")) - 1
    ranked = cut.withColumn("_rank", number).join(first, ["length", "_salt"]).withColumn("_rank", F.col("_rank") + F.col("_first")).drop("_salt", "_first")
    out = ranked.drop("_rank").schema

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = shared.value
        key = t[:, 0] << 48 | t[:, 1]
        for pdf in batches:
            rank = pdf.pop("_rank").to_numpy()
            at = np.searchsorted(key, pdf["length"].to_numpy() << 48 | rank, side="right") - 1
            q = rank - t[at, 1]
            pdf["sequence_id"] = t[at, 3] + q // t[at, 2]
            pdf["offset"] = t[at, 4] + q % t[at, 2] * t[at, 0]
            yield pdf

    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out) + ", sequence_id long, offset long"
    return ranked.mapInPandas(sparing(place), columns)


def pack_documents(docs: DataFrame, capacity: int = 2048, **how) -> DataFrame:
    """Documents tokenised, cut and packed: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    return pack(pieces(docs, capacity, **how), capacity).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
