"""Fuzzy line deduplication: MinHash over character shingles, banding, exact Jaccard verification, distributed union-find."""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from laneatlas.session import ship

from . import buckets
from .common import partitions, written
from .components import components, local_forests
from .suffix import ordered_keys
from .tokens import slices

_C = np.uint64(0x9E3779B97F4A7C15)
#: Bits of an outline; buckets of at most SMALL lines are compared together; lines of a bucket that meet in one task.
BITS, SMALL, BLOCK = 1024, 48, 1000


def _shingle_hashes(lines: list[str], shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all shingles, line after line, and how many each line (of at least `shingle` characters) has."""
    size = np.array([len(x) for x in lines], np.int64)
    points = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32)
    h = np.zeros(max(0, len(points) - shingle + 1), np.uint64)
    for k in range(shingle):
        h = h * np.uint64(1000003) + points[k : len(points) - shingle + 1 + k]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    begin = np.cumsum(size) - size
    own = np.ones(len(h) + shingle, bool)
    for k in range(1, shingle):  # shingles that would reach into the next line
        own[begin + size - k] = False
    return h[own[: len(h)]], size - shingle + 1


def signatures(lines: list[str], shingle: int, functions: int, seed: int = 1) -> np.ndarray:
    """MinHash values (lines x functions) of lines of at least `shingle` characters, over their distinct shingles."""
    rng = np.random.default_rng(seed)
    factor = (rng.integers(1, 1 << 31, functions) * 2 + 1).astype(np.uint32)
    shift = rng.integers(0, 1 << 32, functions, dtype=np.uint32)
    h, n = _shingle_hashes(lines, shingle)
    g = (h >> np.uint64(32)).astype(np.uint32)
    first = np.cumsum(n) - n
    out = np.empty((functions, len(lines)), np.uint32)
    for k in range(functions):
        v = g ^ shift[k]
        v *= factor[k]
        out[k] = np.minimum.reduceat(v, first)
    return out.T


def band_keys(sig: np.ndarray, rows: int) -> np.ndarray:
    """A 64-bit key for each band of `rows` values, different for different bands."""
    bands = sig.shape[1] // rows
    part = sig[:, : bands * rows].reshape(len(sig), bands, rows).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * _C, part.shape[:2]).copy()
    for k in range(rows):
        key = (key ^ part[:, :, k]) * _C
        key ^= key >> np.uint64(32)
    return key


def outlines(h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """lines x 16 words: BITS bits in which each shingle of a line sets one."""
    bits = np.zeros((len(n), BITS), bool)
    bits.reshape(-1)[np.repeat(np.arange(len(n)) * BITS, n) + (h >> np.uint64(54)).astype(np.int64)] = True
    return np.packbits(bits, axis=1).view(np.uint64)


def alike(x: str, y: str, a: np.ndarray, b: np.ndarray, shingle: int, least: float) -> bool:
    """Whether two lines' shingle sets (a, b: their hashes, each once) have a Jaccard similarity of at least `least`; where a clash of
    two hashes could decide it, the shingles themselves do."""
    if min(len(a), len(b)) < least * max(len(a), len(b)) - 2:
        return False
    both = np.concatenate([a, b])
    both.sort(kind="stable")  # two ascending runs: a merge
    m = int(np.count_nonzero(both[1:] == both[:-1]))
    over = m - least * (len(both) - m)
    if abs(over) >= 4:
        return over > 0
    s, t = ({x[k : k + shingle] for k in range(len(x) - shingle + 1)} or {x} for x in (x, y))
    m = len(s & t)
    return m >= least * (len(s) + len(t) - m)


def linked(lines: list[str], shingle: int, least: float, bucket: list | None = None, label: list | None = None) -> list[tuple[int, int]]:
    """Links (i, j) that join all pairs of a bucket whose shingle sets have a Jaccard similarity of at least `least`, and no others;
    lines that are joined already, or have one label, are not compared again.

    Sets that differ in d shingles differ in d bits of their outlines at most, and similar ones in few shingles, so most pairs are told apart
    by counting bits; the others are settled on their shingles. bucket: ascending runs of equal names (default: one bucket).
    """
    n = len(lines)
    if n < 2:
        return []
    h, size = _shingle_hashes([x.ljust(shingle, "\0") for x in lines], shingle)
    words, first = outlines(h, size), np.cumsum(size) - size
    sets: dict[int, np.ndarray] = {}

    def own(i: int) -> np.ndarray:
        if i not in sets:
            x = np.sort(h[first[i] : first[i] + size[i]])
            sets[i] = x[np.append(True, x[1:] != x[:-1])]
        return sets[i]

    apart = (1 - least) / (1 + least)
    root: dict = {}

    def find(x):
        while root.get(x, x) != x:
            root[x] = x = root.get(root[x], root[x])
        return x

    name = [(b, k) for b, k in zip(bucket or [0] * n, label or range(n), strict=True)]
    heads = [k for k in range(n) if not k or (bucket and bucket[k] != bucket[k - 1])]
    out = []

    def settle(pairs) -> None:
        for i, j in pairs:
            a, b = find(name[i]), find(name[j])
            if a != b and alike(lines[i], lines[j], own(i), own(j), shingle, least):
                out.append((i, j))
                root[b] = a

    def near(i, j) -> np.ndarray:
        """Which pairs may be similar; sizes count repeated shingles, so the bound is never too low."""
        return np.bitwise_count(words[i] ^ words[j]).sum(axis=1, dtype=np.int64) <= apart * (size[i] + size[j])

    few = []
    for a, b in zip(heads, [*heads[1:], n], strict=True):
        if b - a <= SMALL:
            few.append(_triangle(b - a) + a)
            continue
        for k in range(a + 1, b):
            for at in range(k - 1, a - 1, -256):
                mine = find(name[k])
                part = np.array([x for x in range(at, max(a - 1, at - 256), -1) if find(name[x]) != mine], np.int64)
                if len(part):
                    settle((x, k) for x in part[near(part, k)].tolist())
    if few:
        i, j = np.concatenate(few, axis=1)
        for at in range(0, len(i), 20_000):
            p, q = i[at : at + 20_000], j[at : at + 20_000]
            ok = near(p, q)
            settle(zip(p[ok].tolist(), q[ok].tolist(), strict=True))
    return out


@functools.cache
def _triangle(n: int) -> np.ndarray:
    return np.stack(np.triu_indices(n, 1))


def _hash(line: str, seed: int = 7) -> int:
    return xxhash.xxh64_intdigest(line.encode("utf-8", "surrogatepass"), seed) - (1 << 63)


def _check(line: str) -> int:
    """A second, unrelated hash and the length, for lines whose hashes agree."""
    return (xxhash.xxh3_64_intdigest(line.encode("utf-8", "surrogatepass"), 11) >> 1) ^ len(line)


def _lines(text: str | None) -> list[tuple[int, str]]:
    """(number, line) of the lines that are not blank."""
    return [(i, x) for i, x in enumerate((text or "").split("\n")) if x.strip()]


#: Entries of a slot, of 16 bytes, about; more where lines repeat between slices.
SLOT = 200_000


def _slots(batches: Iterator[pa.RecordBatch]) -> Iterator[bytes]:
    """The entries of one slot after the other; rows come sorted by slot."""
    now, held = None, []
    for batch in batches:
        for slot, entries in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if slot != now and held:
                yield b"".join(held)
                held = []
            now = slot
            held.append(entries)
    if held:
        yield b"".join(held)


def _buckets(e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """(bucket, block, line) of entries (band, h) whose band has several distinct lines."""
    e = e[np.lexsort((e["h"], e["band"]))]
    e = e[np.append(True, e[1:] != e[:-1])]
    at = np.flatnonzero(np.append(True, e["band"][1:] != e["band"][:-1]))
    size = np.diff(np.append(at, len(e)))
    several = np.repeat(size > 1, size)
    e, which = e[several], np.repeat(np.arange(int((size > 1).sum())), size[size > 1])
    if not len(e):
        return None
    mixed = (e["h"].view(np.uint64) ^ e["h"].view(np.uint64) >> np.uint64(31)) * _C
    name = np.add.reduceat(mixed ^ mixed >> np.uint64(29), np.flatnonzero(np.append(True, which[1:] != which[:-1])))
    size = size[size > 1]
    nth = np.arange(len(e)) - np.repeat(np.cumsum(size) - size, size)
    first = np.flatnonzero((nth > 0) & (nth % BLOCK == 0))  # the smallest member stands in each further block too
    lead = first - nth[first]
    h, i = np.append(e["h"], e["h"][lead]), np.append(nth // BLOCK, nth[first] // BLOCK).astype(np.int32)
    return name[np.append(which, which[lead])].view(np.int64), i, h


def line_links(texts: DataFrame, heads: DataFrame, shingle: int, rows: int, bands: int, least: float, seed: int) -> DataFrame:
    """Links (a, b) between hashes of similar lines. texts: key, doc_id, text; heads: h, key, no (where each line is first).

    Band keys are dealt to partitions and, in each, to `slots` that Spark sorts by; a task looks at one slot at a time. There are as many as keep
    SLOT entries in each, whatever a partition holds."""
    parts = partitions(texts.sparkSession)
    slots = max(1, -(-heads.count() * bands // (parts * SLOT)))

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def dealt() -> pa.RecordBatch:
            """Entries (band key, line), packed by the partition and slot they go to."""
            e = np.concatenate(held)
            g = (e["band"] >> np.uint64(20)) % np.uint64(parts * slots)
            order = np.argsort(g, kind="stable")
            e, g = e[order], g[order]
            at = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
            ends = np.append(at[1:], len(g))
            to = g[at].astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array((to % parts).astype(np.int32)), pa.array(to // parts), pa.array([e[a:b].tobytes() for a, b in zip(at, ends, strict=True)], pa.binary())], names=["p", "slot", "entries"])

        for batch in batches:
            column = batch.column(0).to_pylist()
            for s, e in slices(column, 400_000):
                some = [x for x in dict.fromkeys(x for t in column[s:e] for _, x in _lines(t)) if len(x) >= shingle]
                if not some:
                    continue
                keys = band_keys(signatures(some, shingle, rows * bands, seed), rows)
                entry = np.empty(keys.size, [("band", "<u8"), ("h", "<i8")])
                entry["band"] = keys.reshape(-1)
                entry["h"] = np.repeat(np.array([_hash(x) for x in some], np.int64), keys.shape[1])
                held.append(entry)
                size += keys.size
                if size > 3_000_000:
                    yield dealt()
                    held, size = [], 0
        if held:
            yield dealt()

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Distinct lines of each bucket that has several, named by a hash of the bucket's members, in blocks (see buckets.py)."""
        done: list[tuple] = []

        def out() -> pa.RecordBatch:
            bucket, i, h = (np.concatenate(c) for c in zip(*done, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(i), pa.array(h)], names=["bucket", "i", "h"])

        for raw in _slots(batches):
            if (found := _buckets(np.frombuffer(raw, [("band", "<u8"), ("h", "<i8")]))) is not None:
                done.append(found)
            if sum(len(x[2]) for x in done) > 100_000:
                yield out()
                done = []
        if done:
            yield out()

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for i in range(batch.num_rows):
                lines = (batch.column(1)[i].as_py() or "").split("\n")
                for w in batch.column(2)[i].as_py():
                    out.append((w["bucket"], w["i"], w["j"], w["h"], w["label"], lines[w["no"]]))
            if out:
                *keys, x = zip(*out, strict=True)
                kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(keys, kinds, strict=True)), pa.array(x, pa.string())], names=["bucket", "i", "j", "h", "label", "line"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, h, label, held, size = [], [], [], [], 0

        def settle() -> pa.RecordBatch:
            found = linked(held, shingle, least, names, label)
            return pa.RecordBatch.from_arrays([pa.array([h[x[k]] for x in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

        for batch in batches:
            for bucket, i, j, one, mark, line in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                name = (bucket, i, j)
                if (len(held) >= 4096 or size > 1_000_000) and name != names[-1]:
                    yield settle()
                    names, h, label, held, size = [], [], [], [], 0
                names.append(name)
                h.append(one)
                label.append(mark)
                held.append(line)
                size += len(line)
        if held:
            yield settle()

    def compared(members: DataFrame) -> DataFrame:
        """Links among members (bucket, i, j, h, label) of one (bucket, i, j)."""
        wanted = members.join(heads, "h").groupBy("key").agg(F.collect_list(F.struct("bucket", "i", "j", "h", "label", "no")).alias("wanted"))
        cut = texts.select("key", "text").join(wanted.hint("shuffle_hash"), "key").select("key", "text", "wanted")
        dealt = cut.mapInArrow(fetch, "bucket long, i int, j int, h long, label long, line string")
        return dealt.repartition(F.col("bucket"), F.col("i"), F.col("j")).sortWithinPartitions("bucket", "i", "j", "h").mapInArrow(verify, "a long, b long")

    blobs = texts.select("text").mapInArrow(sketch, "p int, slot long, entries binary").repartitionById(parts, F.col("p")).sortWithinPartitions("slot")
    found = written(blobs.select("slot", "entries").mapInArrow(gather, "bucket long, i int, h long").distinct())
    links = compared(found.withColumn("j", F.col("i")).withColumn("label", F.col("h")))
    large = found.where("i > 0").select("bucket").distinct()
    if not large.limit(1).count():
        return links
    links = written(local_forests(links))
    roots = components(links)
    members = found.join(large, "bucket").select("bucket", "h").distinct()
    marked = members.join(roots, members["h"] == roots["node"], "left").select("bucket", "h", F.coalesce("root", "h").alias("label"))
    return links.unionByName(compared(buckets.rests(written(marked), ["bucket"], "h", "label", BLOCK)))


def dedup_lines(docs: DataFrame, shingle: int = 7, rows: int = 4, bands: int = 12, least: float = 0.8, seed: int = 1, text: str = "text", doc_id: str = "doc_id", with_text: bool = False) -> DataFrame:
    """Per row: doc_id, n_lines, n_kept, n_removed, kept_sha256 (of the kept lines, joined by newlines) and, if asked for, the kept text.

    Lines (between newlines, not blank) are alike if equal, or if their sets of `shingle`-character shingles have a Jaccard similarity of
    `least` or more; shorter lines only if equal. Of each component of alike lines over all documents the first stays (smallest
    doc_id, null last, then the first line). Blank lines always stay. Null texts are empty; repeated rows are ordered by text;
    an empty table gives an empty result; further columns are ignored, whatever their names.
    Candidates share a band of `rows` of rows * bands minima: at 0.8 a pair is found with 99.8 % (1 - (1 - 0.8^4)^12), at 0.9 with
    99.999 %, and every candidate pair is verified on its shingles. Equal lines are one line before any comparison, and so are equal buckets;
    lines count as equal if two unrelated 64-bit hashes and their lengths agree. Buckets of any size are compared in blocks of BLOCK lines.
    """
    ship(docs.sparkSession)
    texts = ordered_keys(docs, text, doc_id)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Lines by hash, the first of each slice; repeats within the slice come out as removed."""
        for batch in batches:
            keys, column = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for s, e in slices(column, 2_000_000):
                first: dict[str, tuple[int, int]] = {}
                gone = []
                for k, t in sorted(zip(keys[s:e], column[s:e], strict=True), key=lambda x: x[0]):
                    for i, x in _lines(t):
                        if first.setdefault(x, (k, i)) != (k, i):
                            gone.append((k, i))
                h, checks = [_hash(x) for x in first] + [None] * len(gone), [_check(x) for x in first] + [None] * len(gone)
                at = [*first.values(), *gone]
                yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(checks, pa.int64()), pa.array([a for a, _ in at], pa.int64()), pa.array([b for _, b in at], pa.int32())], names=["h", "check", "key", "no"])

    found = written(texts.select("key", "text").mapInArrow(scan, "h long, check long, key long, no int"))
    lines = found.where("h is not null")
    # of lines with one hash and different checks only those of the smallest check are looked at: the others stay
    heads = written(lines.groupBy("h").agg(F.min(F.struct("check", "key", "no")).alias("at"), F.count("*").alias("n")).select("h", "at.check", "at.key", "at.no", "n"))
    roots = components(line_links(texts, heads.select("h", "key", "no"), shingle, rows, bands, least, seed))
    joined = roots.join(heads, roots["node"] == heads["h"])
    keeper = joined.groupBy("root").agg(F.min(F.struct("key", "no")).alias("keep"))
    fuzzy = joined.select("h", "check", "root").join(keeper, "root").select("h", "check", "keep")
    exact = heads.where("n > 1").join(roots, F.col("h") == F.col("node"), "left_anti").select("h", "check", F.struct("key", "no").alias("keep"))
    gone = lines.join(fuzzy.unionByName(exact), ["h", "check"]).where("key <> keep.key or no <> keep.no").select("key", "no").unionByName(found.where("h is null").select("key", "no"))
    gone = gone.groupBy("key").agg(F.collect_set("no").alias("gone"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                all_ = (batch.column(1)[i].as_py() or "").split("\n")
                drop = set(batch.column(2)[i].as_py() or ())
                kept = "\n".join([x for k, x in enumerate(all_) if k not in drop])
                out.append((batch.column(0)[i].as_py(), len(all_), len(all_) - len(drop), len(drop), hashlib.sha256(kept.encode()).hexdigest(), kept)[: 6 if with_text else 5])
            kinds = [pa.int64()] * 4 + [pa.string()] * (1 + with_text)
            cols = list(zip(*out, strict=True)) if out else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "n_lines", "n_kept", "n_removed", "kept_sha256", "kept"][: len(kinds)])

    all_ = texts.select("key", "doc_id", "text").join(gone.hint("shuffle_hash"), "key", "left").select("doc_id", "text", "gone")
    return all_.mapInArrow(finish, "doc_id long, n_lines long, n_kept long, n_removed long, kept_sha256 string" + ", kept string" * with_text)
