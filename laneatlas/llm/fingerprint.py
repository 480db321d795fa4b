"""Document fingerprints by context-triggered piecewise hashing, compared by edit distance."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from laneatlas.session import ship

from .common import in_order
from .tokens import slices

#: Bytes of context that trigger a boundary.
CONTEXT = 7
#: Most letters of a signature at the block size and at twice that size.
LONG, SHORT = 64, 32
#: Smallest block size; the others are it times a power of two.
LEAST = 3
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"


def rolling(buffer: np.ndarray) -> np.ndarray:
    """A 32-bit hash of the CONTEXT bytes that end at each byte (zeros before the first)."""
    h = buffer.astype(np.uint32)
    out = h.copy()
    m = 1
    for k in range(1, CONTEXT):
        m = m * 0x01000193 & 0xFFFFFFFF
        out[k:] += h[:-k] * np.uint32(m)
    out ^= out >> np.uint32(15)
    out *= np.uint32(0x85EBCA6B)
    out ^= out >> np.uint32(13)
    return out


def signature(data: bytes, ends: np.ndarray, most: int) -> str:
    """A letter for each piece; ends are exclusive piece ends; what lies beyond the last of `most` pieces joins the last."""
    cuts = [0, *ends[: most - 1].tolist()]
    if cuts[-1] != len(data):
        cuts.append(len(data))
    view, crc = memoryview(data), zlib.crc32
    return "".join([LETTERS[crc(view[a:b]) >> 8 & 63] for a, b in zip(cuts, cuts[1:])])  # noqa: RUF007


def fingerprints(texts: list[bytes]) -> list[str]:
    """block size:signature:signature at twice the block size, from all bytes of each text.

    The block size is the smallest for which LONG pieces of the mean length would cover the text, halved while there are fewer
    than LONG / 2 pieces. An empty text has the fingerprint "3::".
    """
    gap = b"\0" * CONTEXT
    whole = np.frombuffer(gap.join(texts) + gap, np.uint8)
    v = rolling(whole)
    v += np.uint32(1)
    third = v // np.uint32(LEAST)
    hit = np.flatnonzero(third * np.uint32(LEAST) == v)
    level = third[hit]
    starts = np.cumsum([0] + [len(t) + CONTEXT for t in texts[:-1]]) if texts else np.zeros(0, int)
    lo = np.searchsorted(hit, starts)
    hi = np.searchsorted(hit, starts + np.array([len(t) for t in texts], int))
    out = []
    for t, s, a, b in zip(texts, starts.tolist(), lo.tolist(), hi.tolist(), strict=True):
        if not t:
            out.append(f"{LEAST}::")
            continue
        k = 0
        while (LEAST << k) * LONG < len(t):
            k += 1
        pos, lev = hit[a:b] - (s - 1), level[a:b]
        at = pos[(lev & np.uint32((1 << k) - 1)) == 0]
        while k and len(at) < LONG // 2 - 1:
            k -= 1
            at = pos[(lev & np.uint32((1 << k) - 1)) == 0]
        twice = pos[(lev & np.uint32((2 << k) - 1)) == 0]
        out.append(f"{LEAST << k}:{signature(t, at, LONG)}:{signature(t, twice, SHORT)}")
    return out


def edit_distances(a: list[str], b: list[str]) -> np.ndarray:
    """Levenshtein distances of pairs of words of at most 64 letters, all pairs at once, a row of the table a bit vector."""
    n = len(a)
    la, lb = np.array([len(x) for x in a], np.int64), np.array([len(x) for x in b], np.int64)
    wide = max(1, int(max(la.max(initial=0), lb.max(initial=0))))
    code = lambda words: np.frombuffer("".join(x.ljust(wide) for x in words).encode("ascii"), np.uint8).reshape(n, wide)
    x, y, rows = code(a), code(b), np.arange(n)
    peq = np.zeros((n, 128), np.uint64)
    for j in range(wide):
        r = rows[j < la]
        peq[r, x[r, j]] |= np.uint64(1 << j)
    one = np.uint64(1)
    high = np.where(la > 0, one << (np.maximum(la, 1) - 1).astype(np.uint64), 0).astype(np.uint64)
    vp, vn, score = np.full(n, 0xFFFFFFFFFFFFFFFF, np.uint64), np.zeros(n, np.uint64), la.copy()
    for j in range(wide):
        on = j < lb
        e = peq[rows, y[:, j]] | vn
        d = (((e & vp) + vp) ^ vp) | e
        hp, hn = vn | ~(vp | d), vp & d
        score += np.where(on, ((hp & high) != 0).astype(np.int64) - ((hn & high) != 0), 0)
        s = hp << one | one
        vp, vn = np.where(on, hn << one | ~(s | d), vp), np.where(on, s & d, vn)
    return np.where(la == 0, lb, score)


def likeness(a: list[str], b: list[str]) -> np.ndarray:
    """0 to 1 for pairs of fingerprints: one less the edit distance over the longer signature, the best of the signatures at equal
    block sizes; 0 where no block size is common. Equal fingerprints: 1."""
    out = np.zeros(len(a))
    pairs: list[tuple[int, str, str]] = []
    for i, (x, y) in enumerate(zip(a, b, strict=True)):
        if x == y:
            out[i] = 1.0
            continue
        (p, p1, p2), (q, q1, q2) = x.split(":"), y.split(":")
        p, q = int(p), int(q)
        if p == q:
            pairs += [(i, p1, q1), (i, p2, q2)]
        elif p == 2 * q:
            pairs.append((i, p1, q2))
        elif q == 2 * p:
            pairs.append((i, p2, q1))
    if pairs:
        at, s, t = zip(*pairs, strict=True)
        d = edit_distances(list(s), list(t))
        longer = np.array([max(len(x), len(y), 1) for x, y in zip(s, t, strict=True)])
        both = np.array([bool(x) and bool(y) for x, y in zip(s, t, strict=True)])
        np.maximum.at(out, np.array(at), np.where(both, 1 - d / longer, 0.0))
    return out


EDITED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprint_edits(docs: DataFrame, part: int = 4, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Per document its fingerprint, that of its edited text, and the likeness to the edited and to the next document.

    The edit replaces the last floor(n/part) code points by as many first ones (or all) of the next document by doc_id (null
    first; after the last comes the first; equal ids by text). Null texts are empty; of two empty fingerprints the likeness is 1.
    An empty table gives an empty result. Rows are dealt into ranges of doc_id, each with the first row of
    the next range, so that neighbours meet in one shuffle of the texts; a task holds one batch of rows.
    """

    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def made(rows: list[tuple]) -> pa.RecordBatch:
            """rows[-1] is only the neighbour of rows[-2]."""
            plain = [t.encode() for _, t in rows]
            edited = []
            for (_, t), (_, u) in zip(rows, rows[1:], strict=False):
                cut = len(t) // part
                edited.append((t[: len(t) - cut] + u[:cut]).encode())
            own, new = fingerprints(plain), fingerprints(edited)
            k = len(edited)
            near = likeness(own[:k] + own[:k], new + own[1:])
            return pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows[:k]], pa.int64()), pa.array([len(r[1]) for r in rows[:k]], pa.int64()), pa.array([hashlib.sha256(e).hexdigest() for e in edited]), pa.array(own[:k]), pa.array(new), pa.array(near[:k]), pa.array(near[k:])],
                names=[c.split()[0] for c in EDITED.split(", ")],
            )

        done = False
        for batch in batches:
            ids, texts, halo = (batch.column(i).to_pylist() for i in range(3))
            for a, b in slices(texts, 1_000_000):
                for i in range(a, b):
                    if not done:
                        held.append((ids[i], texts[i] or ""))
                        done = halo[i]
                if len(held) > 1:
                    yield made(held)
                    held = held[-1:]

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    ordered = in_order(rows, "doc_id", halo=True, tie="text").select("doc_id", "text", "_halo")
    return ordered.mapInArrow(run, EDITED)


def fingerprint(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with a column fingerprint, which takes the place of one of that name; null texts count as empty."""

    ship(docs.sparkSession)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for t in batches:
            yield pd.Series(fingerprints([(x or "").encode() for x in t]))

    return docs.withColumn("fingerprint", F.pandas_udf(run, "string")(F.col(text)))
