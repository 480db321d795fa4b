"""Removal of repeated byte strings by a hash-compared suffix sort.

A string of `length` bytes that starts earlier in the corpus is found in four steps.
1. Each window of `length` bytes names one of its grams of GRAM bytes, the one with the smallest hash (its anchor). Equal windows
   name equal grams at equal places, so windows need only meet where their anchors agree. Neighbouring windows share an
   anchor; such a run of windows is a fragment. Fragments repeated whole within a slice of a task are settled there.
2. Fragments whose anchor occurs once are dropped, whole fragments that repeat are settled (one shuffle of their hashes: 64 bits of a
   polynomial hash of the anchor and 64 of an unrelated hash, xxh3, of the fragment's bytes must agree, besides the anchor's place).
3. Where different fragments share an anchor, their bytes are cut from the texts and sent to the anchor's task.
4. The windows of what is left are suffixes to be sorted, truncated at `length`: prefix polynomial hashes of the fragments and binary
   search give the common extension of two suffixes, hence their order, in a logarithmic number of hash comparisons; a
   mergesort (all groups in step, merging by binary search) puts equal windows side by side; equal neighbours are verified byte by byte.
   All but the earliest of equal windows are repeats.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from laneatlas.session import ship, sparing

from .common import heavy, kept, written
from .tokens import slices

GRAM = 32
_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def _codes() -> np.ndarray:
    """A 64-bit value for each byte, by a counter-based mixer."""
    x = (np.arange(1, 257, dtype=np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(32)


_CODE = _codes()


class _Prefix:
    """Prefix polynomial hashes of a buffer: hash(p, n) of any piece in constant time."""

    def __init__(self, data: np.ndarray) -> None:
        n = len(data)
        self.up = _powers(_BASE, n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_CODE[data] * _powers(_INVERSE, n), dtype=np.uint64, out=self.sums[1:])

    def __call__(self, p, n):
        return (self.sums[p + n] - self.sums[p]) * self.up[p]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ h >> np.uint64(31)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ h >> np.uint64(32)


def fragments(texts: list[bytes], length: int) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor: (text, first window, windows, anchor's offset from it, anchor hash, hash of the fragment)."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.array([len(t) for t in texts], np.int64)
    begin = np.cumsum(sizes) - sizes
    if len(data) < length:
        return tuple(np.zeros(0, np.int64) for _ in range(4)) + (np.zeros(0, np.uint64),) * 2
    prefix = _Prefix(data)
    n = len(data)
    gram = min(GRAM, length)
    p = np.arange(n - gram + 1)
    g = _mixed((prefix.sums[gram:] - prefix.sums[: n - gram + 1]) * prefix.up[: n - gram + 1])
    low = np.uint64((1 << max(1, n.bit_length())) - 1)
    v = g & ~low | p.astype(np.uint64)
    span, have = length - gram + 1, 1
    while have < span:
        step = min(have, span - have)
        v = np.minimum(v[: len(v) - step], v[step:])
        have += step
    at = (v & low).astype(np.int64)  # anchor of the window that starts at each byte
    owner = np.searchsorted(begin, np.arange(len(at)), side="right") - 1
    # the last of texts with one beginning (empty ones) owns it, which is the one that has bytes
    good = np.flatnonzero(np.arange(len(at)) + length <= (begin + sizes)[owner])
    if not len(good):
        return tuple(np.zeros(0, np.int64) for _ in range(4)) + (np.zeros(0, np.uint64),) * 2
    new = np.ones(len(good), bool)
    new[1:] = (at[good[1:]] != at[good[:-1]]) | (owner[good[1:]] != owner[good[:-1]])
    heads = np.flatnonzero(new)
    first = good[heads]
    count = np.diff(np.append(heads, len(good)))
    own = owner[first]
    return own, first - begin[own], count, at[first] - first, g[at[first]], prefix(first, count + length - 1)


def merged_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted (from, to) with overlapping and touching ones joined."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            if b > out[-1][1]:
                out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def suffix_repeats(group: np.ndarray, pieces: np.ndarray, place: np.ndarray, length: int) -> np.ndarray:
    """True for each suffix that has an equal earlier one (first `length` bytes) in its group.

    place: for each suffix its row of `pieces` and where it starts there. group ascends; within a group the order given is "earlier". Mergesort with hash-compared suffixes; equal neighbours are verified on their bytes.
    """
    rows, starts = place[:, 0], place[:, 1]
    wide = pieces.shape[1]
    sums = np.zeros((len(pieces), wide + 1), np.uint64)
    np.cumsum(_CODE[pieces] * _powers(_INVERSE, wide), axis=1, dtype=np.uint64, out=sums[:, 1:])
    sums, up, raw = sums.reshape(-1), _powers(_BASE, wide + 1), pieces.reshape(-1)
    base, byte, factor = rows * (wide + 1) + starts, rows * wide + starts, up[starts]
    zero = sums[base]
    whole = (sums[base + length] - zero) * factor
    n = len(rows)

    def before(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(x < y, x == y) of suffixes, by the length of their common extension."""
        same = whole[x] == whole[y]
        less = np.zeros(len(x), bool)
        k = np.flatnonzero(~same)
        if len(k):
            a, b = x[k], y[k]
            lo, hi = np.zeros(len(k), np.int64), np.full(len(k), length - 1, np.int64)
            for _ in range(length.bit_length()):
                mid = (lo + hi + 1) >> 1
                eq = (sums[base[a] + mid] - zero[a]) * factor[a] == (sums[base[b] + mid] - zero[b]) * factor[b]
                lo, hi = np.where(eq, mid, lo), np.where(eq, hi, mid - 1)
            less[k] = raw[byte[a] + lo] < raw[byte[b] + lo]
        return less, same

    head = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    size = np.diff(np.append(head, n))
    start = np.repeat(head, size)  # of each slot's group
    end = start + np.repeat(size, size)
    order = np.arange(n)
    slot = np.arange(n)
    width = 1
    while width < size.max(initial=0):
        local = slot - start
        left = local // width % 2 == 0
        other = start + (local // width + np.where(left, 1, -1)) * width  # first slot of the run to merge with
        lo = np.minimum(other, end)
        hi = np.minimum(other + width, end)
        first = lo.copy()
        act = np.flatnonzero(lo < hi)
        while len(act):
            mid = (lo[act] + hi[act]) >> 1
            less, same = before(order[mid], order[act])
            go = less | same & ~left[act]  # ties: the left run's suffixes come first
            lo[act[go]] = mid[go] + 1
            hi[act[~go]] = mid[~go]
            act = act[lo[act] < hi[act]]
        to = np.where(left, slot, slot - width) + (lo - first)
        merged = np.empty(n, np.int64)
        merged[to] = order
        order = merged
        width *= 2
    repeat = np.zeros(n, bool)
    x, y = order[:-1], order[1:]
    pair = np.flatnonzero((whole[x] == whole[y]) & (group[x] == group[y]))
    good = np.ones(len(pair), bool)
    for i in range(0, len(pair), 20_000):
        part = pair[i : i + 20_000]
        j = np.arange(length)
        good[i : i + 20_000] = (raw[byte[x[part], None] + j] == raw[byte[y[part], None] + j]).all(axis=1)
    repeat[y[pair[good]]] = True
    if not good.all():  # different bytes under one hash: settle those groups on their bytes
        for g in np.unique(group[y[pair[~good]]]):
            seen: set[bytes] = set()
            for i in np.flatnonzero(group == g):
                b = raw[byte[i] : byte[i] + length].tobytes()
                repeat[i] = b in seen
                seen.add(b)
    return repeat


def _settle(held: list[tuple], length: int) -> list[tuple[int, int, int]]:
    """Spans (key, from, to) of repeats among fragments (group, key, first window, anchor offset, bytes), ordered by group, key, first."""
    count = np.array([len(x[4]) - length + 1 for x in held], np.int64)
    wide = int(count.max()) + length - 1
    pieces = np.frombuffer(b"".join([x[4].ljust(wide, b"\0") for x in held]), np.uint8).reshape(-1, wide)
    row = np.repeat(np.arange(len(held)), count)
    j = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    names = {g: i for i, g in enumerate(dict.fromkeys(x[0] for x in held))}
    group = np.array([names[x[0]] for x in held], np.int64)[row] * 4096 + np.array([x[3] for x in held], np.int64)[row] - j
    by = np.argsort(group, kind="stable")
    own = group[by]
    many = np.zeros(len(own), bool)
    twin = own[1:] == own[:-1]
    many[1:] |= twin
    many[:-1] |= twin
    by = by[many]
    if not len(by):
        return []
    hit = by[suffix_repeats(group[by], pieces, np.stack([row[by], j[by]], axis=1), length)]
    hit.sort()
    out = []
    cut = np.flatnonzero(np.append(len(hit) > 0, (row[hit[1:]] != row[hit[:-1]]) | (j[hit[1:]] != j[hit[:-1]] + 1)))
    for a, b in zip(cut, np.append(cut[1:], len(hit))):  # noqa: B905
        key, first = held[row[hit[a]]][1:3]
        out.append((key, first + int(j[hit[a]]), first + int(j[hit[b - 1]]) + length))
    return out


def _spans_batch(spans: list[tuple[int, int, int]]) -> pa.RecordBatch:
    cols = list(zip(*spans, strict=True)) if spans else ([], [], [])
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["key", "a", "b"])


def repeated_spans(texts: DataFrame, length: int = 100, hot: int = 5000, chunk: int = 20_000, share: float = 0.001, least: int = 1000) -> DataFrame:
    """Spans (key, a, b) of bytes that windows of `length` cover which also start earlier; texts: key (ascending: earlier), text.

    An anchor with more than `hot` fragments sends its windows one by one, dealt by their bytes as well, so that no task gets all
    of them; equal ones are settled as they arrive, and a task holds distinct fragments only. So does an anchor that more than the share `share` of all
    fragments (and more than `least`) have; its fragments are never in one task.
    """
    ship(texts.sparkSession)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            for s, e in slices(texts, 1_500_000):
                plain = [(t or "").encode() for t in texts[s:e]]
                own, first, count, off, g, whole = fragments(plain, length)
                if not len(own):
                    continue
                key = keys[s:e][own]
                mix = whole ^ g * np.uint64(_BASE) ^ (count * 4096 + off).astype(np.uint64) * np.uint64(0x94D049BB133111EB)
                order = np.lexsort((first, key, mix))
                lead = np.append(True, mix[order[1:]] != mix[order[:-1]])
                leader = order[np.maximum.accumulate(np.where(lead, np.arange(len(order)), 0))]
                keep, gone = np.ones(len(own), bool), []
                for i, l in zip(order[~lead].tolist(), leader[~lead].tolist(), strict=True):
                    n = int(count[i]) + length - 1
                    a, b = int(first[i]), int(first[l])
                    if plain[own[i]][a : a + n] == plain[own[l]][b : b + n]:
                        keep[i] = False
                        gone.append((int(key[i]), a, a + n))
                spans = []
                by: dict[int, list] = {}
                for k, a, b in gone:
                    by.setdefault(k, []).append((a, b))
                for k, v in by.items():
                    spans += [(k, x, min(b, x + 0xFFFFFF)) for a, b in merged_spans(v) for x in range(a, b, 0xFFFFFF)]
                m, k = int(keep.sum()), len(spans)
                digest = xxhash.xxh3_64_intdigest  # of the fragment's bytes and its anchor's place: unrelated to the hash of the anchor
                same = np.array([digest(plain[t][a : a + n + length - 1], o) for t, a, n, o in zip(own[keep].tolist(), first[keep].tolist(), count[keep].tolist(), off[keep].tolist(), strict=True)], np.uint64).view(np.int64)
                one = lambda x, y: pa.array(np.concatenate([x, np.array(y, np.int64)]))
                yield pa.RecordBatch.from_arrays(
                    [one(g[keep].view(np.int64), [(x[0] * 0x9E3779B1 + x[1]) & (1 << 63) - 1 for x in spans]),
                     pa.array(np.concatenate([same, np.zeros(k, np.int64)]), mask=np.arange(m + k) >= m),
                     one(key[keep], [x[0] for x in spans]),
                     one(first[keep] << 24 | count[keep] << 12 | off[keep], [x[1] << 24 | x[2] - x[1] for x in spans])],
                    names=["g", "same", "key", "at"],
                )

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for i in range(batch.num_rows):
                key, data = batch.column(0)[i].as_py(), (batch.column(2)[i].as_py() or "").encode()
                f = batch.column(3)[i].values  # of structs
                g, first, n, off, many = (f.field(k).to_pylist() for k in range(5))
                for h, a, c, o, m in zip(g, first, n, off, many, strict=True):
                    if m:
                        for k in range(c):
                            b = data[a + k : a + k + length]
                            rows.append((h, int.from_bytes(hashlib.blake2b(b, digest_size=4).digest(), "little", signed=True), key, a + k, o - k, b))
                    else:
                        rows.append((h, 0, key, a, o, data[a : a + c + length - 1]))
                    if len(rows) >= 20_000:
                        yield _fragment_batch(rows)
                        rows = []
            if rows:
                yield _fragment_batch(rows)

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        seen: dict = {}
        now, spans = None, []
        for batch in batches:
            g, sub, key, first, off, data = (c.to_pylist() for c in batch.columns)
            for row in zip(g, sub, key, first, off, data, strict=True):
                if row[:2] != now:
                    now, seen = row[:2], {}
                    if len(held) >= chunk:
                        spans += _settle(held, length)
                        held = []
                    if len(spans) >= 10_000:
                        yield _spans_batch(spans)
                        spans = []
                same = (row[4], row[5])
                if same in seen:  # an equal fragment came earlier
                    spans.append((row[2], row[3], row[3] + len(row[5])))
                else:
                    seen[same] = True
                    held.append((now, *row[2:]))
        if held:
            spans += _settle(held, length)
        if spans:
            yield _spans_batch(spans)

    made = kept(texts.select("key", "text").mapInArrow(sparing(find), "g long, same long, key long, at long"))
    # the fragments of a frequent anchor are dealt by their hashes too; they count as mixed, which the settling decides
    often = heavy(made, "g", share, least).withColumn("often", F.lit(True))
    raw = made.join(F.broadcast(often), "g", "left").withColumn("deal", F.when(F.col("often"), F.coalesce("same", F.lit(0))).otherwise(0))
    group = Window.partitionBy("g", "deal")
    split = F.col("often").isNotNull()
    found = raw.select(
        "g", "same", "key", "at", F.count("same").over(group).alias("n"), split.alias("often"),
        (split | (F.min("same").over(group) != F.max("same").over(group))).alias("mixed"),
        F.row_number().over(Window.partitionBy("g", "deal", "same").orderBy("key", "at")).alias("nth"),
    )
    found = written(found.where("same is null or n > 1 or often"))
    made.unpersist()
    first, n, off = F.shiftright("at", 24), F.shiftright("at", 12).bitwiseAND(4095).cast("int"), F.col("at").bitwiseAND(4095).cast("int")
    local = found.where("same is null").select("key", first.alias("a"), (first + F.col("at").bitwiseAND(0xFFFFFF)).alias("b"))
    whole = found.where("same is not null and nth > 1").select("key", first.alias("a"), (first + n + length - 1).alias("b"))
    open_ = F.struct("g", first.cast("int").alias("first"), n.alias("n"), off.alias("off"), (F.col("often") | (F.col("n") > hot)).alias("many"))
    wanted = found.where("same is not null and mixed and nth = 1").groupBy("key").agg(F.collect_list(open_).alias("f"))
    # the same exchange of the texts serves remove_repeats() again
    cut = texts.select("key", "doc_id", "text").join(wanted.hint("shuffle_hash"), "key").select("key", "doc_id", "text", "f")
    pieces = cut.mapInArrow(sparing(fetch), "g long, sub int, key long, first int, off short, data binary")
    dealt = pieces.repartition(F.col("g"), F.col("sub")).sortWithinPartitions("g", "sub", "key", "first")
    return dealt.mapInArrow(sparing(settle), "key long, a long, b long").unionByName(local).unionByName(whole)


def _fragment_batch(rows: list[tuple]) -> pa.RecordBatch:
    g, sub, key, first, off, data = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(g, pa.int64()), pa.array(sub, pa.int32()), pa.array(key, pa.int64()), pa.array(first, pa.int32()), pa.array(off, pa.int16()), pa.array(data, pa.binary())], names=["g", "sub", "key", "first", "off", "data"])


def ordered_keys(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """key, doc_id, text: key ascends with doc_id (null last), equal ids in the order of their texts.

    The filter on the key, which is never null, is what an inner join would add; so joins of either kind share one exchange.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    n, ids, distinct = rows.agg(F.count("*"), F.count("doc_id"), F.countDistinct("doc_id")).first()
    if n == ids == distinct:
        return rows.withColumn("key", F.col("doc_id")).where("key is not null")
    return written(rows.orderBy(F.col("doc_id").asc_nulls_last(), "text").withColumn("key", F.monotonically_increasing_id())).where("key is not null")


def remove_repeats(docs: DataFrame, length: int = 100, text: str = "text", doc_id: str = "doc_id", with_text: bool = False) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, spans and the kept bytes.

    Bytes are those of the text in UTF-8 (null: empty). Each byte that a string of `length` bytes covers goes if that string also starts
    earlier (smaller doc_id, or the same row, before); matches never cross rows. All is judged on the input. Rows with
    a null doc_id come last, repeated rows in the order of their texts. An empty table gives an empty result.
    """
    ship(docs.sparkSession)
    texts = ordered_keys(docs, text, doc_id)
    spans = repeated_spans(texts, length).groupBy("key").agg(F.collect_list(F.struct("a", "b")).alias("spans"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for i in range(batch.num_rows):
                data = (batch.column(1)[i].as_py() or "").encode()
                runs = merged_spans([(s["a"], s["b"]) for s in batch.column(2)[i].as_py() or []])
                at, kept = 0, []
                for a, b in runs:
                    kept.append(data[at:a])
                    at = b
                kept = b"".join([*kept, data[at:]])
                row = (batch.column(0)[i].as_py(), len(data), len(data) - len(kept), len(runs), hashlib.sha256(kept).hexdigest())
                out.append(row + (([{"a": a, "b": b} for a, b in runs], kept) if with_text else ()))
            kinds = [pa.int64()] * 4 + [pa.string()] + ([pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())])), pa.binary()] if with_text else [])
            cols = list(zip(*out, strict=True)) if out else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept"][: len(kinds)])

    joined = texts.select("key", "doc_id", "text").join(spans.hint("shuffle_hash"), "key", "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(sparing(finish), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", spans array<struct<a:long,b:long>>, kept binary" * with_text)
