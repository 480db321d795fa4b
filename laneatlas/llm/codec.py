"""Token ids as binary files: an adaptive context-mixing range coder over independently reset, checksummed blocks.

A frame holds whole documents. Layout, little-endian:
  b"LAT3", u32 ids a block, u32 documents, u64 ids, u32 blocks, u32 bytes of the prior, u32 crc32 of the three tables below;
  documents: i64 doc_id, u32 ids each (null ids: the smallest i64);
  blocks: u32 ids, u32 bytes, u32 crc32 of the coded bytes, u32 crc32 of the ids as u32 each;
  prior (deflated): what every block starts from, see Prior;
  the blocks' coded bytes.
A block is coded from the prior alone, so any block can be read by itself. The blocks of a frame advance in step, one a lane of
NumPy arrays; that is a matter of speed and leaves no trace in the bytes.

For each id, order 2 (hash of the last two ids) and order 1 (of the last) each predict an id with a confidence. The two
are mixed in the logistic domain, with weights that adapt in each block, into the probability that the higher order's id comes; a
range coder codes that; on a miss the other order's id is tried; else order 0 codes the id. Its ids lie on a line, those of blocks of like content
(a language, say) side by side, cut into 16 x 16 stretches; the stretch's two digits have adaptive tables, the first in the context of the
last id's first digit; within a stretch the frequencies of the frame decide. Ids too rare for the prior are escaped and coded in full.
"""

from __future__ import annotations

import math
import struct
import zlib

import numpy as np

MAGIC = b"LAT3"
HEAD = struct.Struct("<4sIIQIII")
BLOCK = 4096
#: Lanes at most that advance together; bounds the memory of the models (some 100 MB).
LANES = 2048
NO_ID = -(1 << 63)

_H1, _H2 = 1 << 10, 1 << 11
_RATE = 5
_ESCAPE_BITS = 16
_MIX = np.array([[i if i <= s else (1 << 15) - 16 + i for i in range(16)] for s in range(16)], np.int16)
_GRID = (np.arange(4096) + 0.5) / 4096
#: 256 ln(p/(1-p)), whole numbers so that every machine has the same table, and its inverse in 65536ths.
_STRETCH = np.round(256 * np.log(_GRID / (1 - _GRID))).astype(np.float32)
_SQUASH = np.clip(np.round(65536 / (1 + np.exp(-(np.arange(4096) - 2048) / 256.0))), 48, 65536 - 48).astype(np.int32)
_U = np.uint64
_WIDE = _U(1 << 32)
_ONES = _U(0x0101010101010101)


class _Coder:
    """Carry-less range coder: 64-bit low, 16-bit words, ranges of at least 2**32 before each step, a lane a block."""

    def __init__(self, lanes: int, capacity: int = 0, words: np.ndarray | None = None, starts: np.ndarray | None = None) -> None:
        self.low, self.rng = np.zeros(lanes, np.uint64), np.full(lanes, (1 << 64) - 1, np.uint64)
        self.reading = words is not None
        if self.reading:
            self.words, self.at, self.code = words, starts.copy(), np.zeros(lanes, np.uint64)
            for _ in range(4):
                self.code = self.code << _U(16) | self.words.take(self.at)
                self.at += 1
        else:
            self.out, self.at = np.zeros((lanes, capacity), np.uint16), np.zeros(lanes, np.int64)

    def reserve(self, words: int) -> None:
        """Room for so many more words in each lane."""
        if not self.reading and (need := int(self.at.max(initial=0)) + words) > self.out.shape[1]:
            self.out = np.pad(self.out, ((0, 0), (0, max(need, self.out.shape[1] * 5 // 4) - self.out.shape[1])))

    def widen(self, low: np.ndarray, rng: np.ndarray, lanes: np.ndarray | None = None) -> None:
        """Give out (or take in) words until each range is wide; low and rng change in place, lanes are theirs (None: the first)."""
        t = low + rng
        t ^= low
        t >>= _U(48)
        at = np.flatnonzero((t == 0) | (rng < _WIDE))
        while len(at):
            a, r = low.take(at), rng.take(at)
            cut = (a ^ (a + r)) >> _U(48) != 0
            if cut.any():
                np.copyto(r, (_U(0) - a) & (_WIDE - _U(1)), where=cut)
            lane = at if lanes is None else lanes.take(at)
            pos = self.at.take(lane)
            if self.reading:
                self.code[lane] = self.code.take(lane) << _U(16) | self.words.take(pos)
            else:
                self.out[lane, pos] = a >> _U(48)
            self.at[lane] = pos + 1
            a <<= _U(16)
            r <<= _U(16)
            low[at], rng[at] = a, r
            at = at[((a ^ (a + r)) >> _U(48) == 0) | (r < _WIDE)]

    def finish(self) -> None:
        lanes = np.arange(len(self.low))
        self.reserve(4)
        for k in (48, 32, 16, 0):
            self.out[lanes, self.at] = (self.low >> _U(k) & _U(0xFFFF)).astype(np.uint16)
            self.at += 1


def _count(rows: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The digit whose interval holds v, in each row."""
    held = (rows <= v.astype(np.int16)[:, None]).view(np.uint64)
    return ((held[:, 0] + held[:, 1]) * _ONES >> _U(56)).astype(np.int64) - 1


#: 16 times 2 to the power of a quarter of 0, 1, 2 ..., rounded down, by whole-number roots: a frame's tables are the same on every machine.
_MASS = np.array([math.isqrt(math.isqrt(1 << (min(q, 128) + 16))) for q in range(256)], np.int64)


def _cumulated(mass: np.ndarray) -> np.ndarray:
    """Rows of 16 whole masses as cumulative int16 of 2**15, each digit with 16 at least."""
    total = mass.sum(axis=-1, keepdims=True)
    left = (1 << 15) - 256
    whole = 16 + np.where(total > 0, mass * left // np.maximum(total, 1), left // 16)
    ends = np.cumsum(whole, axis=-1)
    return np.concatenate([np.zeros_like(ends[..., :1]), ends[..., :-1]], axis=-1).astype(np.int16)


def _summed(at: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sums of whole numbers at 256 places."""
    out = np.zeros(256, np.int64)
    np.add.at(out, at, values)
    return out


class Prior:
    """The ids a frame's blocks start from: code k has id ids[k]; code len(ids) is the escape.

    In the file: u32 clusters; u32 ids of each; the ids, rising in each cluster, as u32 differences; a byte each, 4 log2 of how often; last
    16 x 16 bytes, the same of how often first digits follow each other.
    """

    def __init__(self, clusters: list[np.ndarray], often: list[np.ndarray], follow: np.ndarray) -> None:
        self.clusters, self.often, self.follow = clusters, often, follow
        parts = [np.lexsort((c, -o)) for c, o in zip(clusters, often, strict=True)]
        self.ids = np.concatenate([c[p] for c, p in zip(clusters, parts, strict=True)] + [np.zeros(0, np.int64)]).astype(np.int64)
        q = np.concatenate([o[p] for o, p in zip(often, parts, strict=True)] + [np.full(1, 8)])
        mass = _MASS[q.astype(np.int64)]  # the escape is one more symbol, seen some times
        before = np.cumsum(mass) - mass
        self.sub = np.minimum(255, before * 256 // mass.sum())  # stretch of each code
        self.first = self.sub >> 4
        by = _summed(self.sub, mass)
        self.second = _cumulated(by.reshape(16, 16))
        self.start = _cumulated(_MASS[follow.astype(np.int64)] - 16 + by.reshape(16, 16).sum(axis=1) // 50)
        f = np.maximum(1, mass * 40_000 // by[self.sub])
        head = np.flatnonzero(np.append(True, self.sub[1:] != self.sub[:-1]))
        upto = np.cumsum(f) - f
        self.low = upto - np.repeat(upto[head], np.diff(np.append(head, len(f))))
        self.freq, self.total = f, _summed(self.sub, f)
        self.find = self.sub << 24 | self.low
        self.order = np.argsort(self.ids, kind="stable")

    def codes(self, ids: np.ndarray) -> np.ndarray:
        if not len(self.ids):
            return np.zeros(len(ids), np.int32)
        if self.ids.max() < 1 << 22 > ids.max(initial=0):
            table = np.full(1 << 22, len(self.ids), np.int32)
            table[self.ids] = np.arange(len(self.ids))
            return table.take(ids)
        at = np.minimum(np.searchsorted(self.ids, ids, sorter=self.order), len(self.ids) - 1)
        code = self.order[at]
        return np.where(self.ids[code] == ids, code, len(self.ids)).astype(np.int32)

    def dump(self) -> bytes:
        head = struct.pack(f"<{1 + len(self.clusters)}I", len(self.clusters), *map(len, self.clusters))
        gaps = [np.diff(c, prepend=0).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes() for c in self.clusters]
        return zlib.compress(head + b"".join(gaps) + b"".join(o.astype(np.uint8).tobytes() for o in self.often) + self.follow.astype(np.uint8).tobytes(), 9)

    @classmethod
    def load(cls, data: bytes) -> Prior:
        raw = zlib.decompress(data)
        n = struct.unpack_from("<I", raw)[0]
        sizes = struct.unpack_from(f"<{n}I", raw, 4)
        at, clusters, often = 4 + 4 * n, [], []
        for k in sizes:
            gaps = np.ascontiguousarray(np.frombuffer(raw, np.uint8, 4 * k, at).reshape(4, k).T).view("<u4").reshape(-1)
            clusters.append(np.cumsum(gaps.astype(np.int64)))
            at += 4 * k
        for k in sizes:
            often.append(np.frombuffer(raw, np.uint8, k, at).astype(np.int64))
            at += k
        return cls(clusters, often, np.frombuffer(raw, np.uint8, 256, at).reshape(16, 16).astype(np.int64))

    @classmethod
    def of(cls, ids: np.ndarray, block: int, clusters: int = 8, least: int = 4, seen: int = 512, wide: int = 2048) -> Prior:
        """From a frame's ids: those that come `least` times or more, grouped by the blocks they are frequent in (`seen` blocks,
        evenly spaced, and the `wide` most frequent ids decide the groups; that moves sizes only, not results)."""
        names, count = np.unique(ids, return_counts=True)
        keep = count >= least
        names, count = names[keep].astype(np.int64), count[keep]
        n = -(-len(ids) // block)
        group = np.zeros(len(names), np.int64)
        if n > 1 and len(names) > clusters:
            some = np.unique(np.linspace(0, n - 1, min(n, seen)).astype(np.int64))
            rows = np.zeros((len(some), len(names)), np.float32)
            for r, k in enumerate(some):
                own = ids[k * block : (k + 1) * block]
                at = np.minimum(np.searchsorted(names, own), len(names) - 1)
                rows[r] = np.bincount(at[names[at] == own], minlength=len(names))
            top = np.argsort(-count, kind="stable")[:wide]
            x = np.sqrt(rows[:, top] / np.maximum(rows.sum(axis=1, keepdims=True), 1))
            centre = x[:1]
            while len(centre) < min(clusters, len(some)):  # the block farthest from all centres so far
                away = ((x[:, None, :] - centre[None]) ** 2).sum(axis=2).min(axis=1)
                centre = np.concatenate([centre, x[[int(away.argmax())]]])
            for _ in range(5):
                own = np.argmax(x @ centre.T - 0.5 * (centre**2).sum(axis=1), axis=1)
                centre = np.stack([x[own == k].mean(axis=0) if (own == k).any() else centre[k] for k in range(len(centre))])
            share = np.stack([rows[own == k].sum(axis=0) / max(1.0, float(rows[own == k].sum())) for k in range(len(centre))])
            group = share.argmax(axis=0)
        often = np.minimum(255, np.round(4 * np.log2(np.maximum(count, 1)))).astype(np.int64)
        parts = [group == k for k in range(int(group.max(initial=0)) + 1)]
        made = cls([names[p] for p in parts], [often[p] for p in parts], np.zeros((16, 16), np.int64))
        pairs = np.zeros(256, np.int64)
        for k in range(0, len(ids), 1 << 20):
            digit = made.first[made.codes(ids[k : k + (1 << 20) + 1])]
            pairs += np.bincount(digit[:-1] * 16 + digit[1:], minlength=256)
        pairs = pairs.reshape(16, 16)
        return cls(made.clusters, made.often, np.minimum(255, np.round(4 * np.log2(pairs + 1))).astype(np.int64))


def _run(coder: _Coder, lengths: np.ndarray, prior: Prior, codes: np.ndarray | None, raw: np.ndarray) -> np.ndarray:
    """Code (codes given, one row a step) or decode lanes of falling lengths; raw: the ids behind escapes, taken or filled in."""
    lanes, steps = len(lengths), int(lengths[0]) if len(lengths) else 0
    out = np.zeros((steps, lanes), np.int32) if codes is None else codes
    escape = len(prior.ids)
    t1, t2 = np.zeros(lanes * _H1, np.int32), np.zeros(lanes * _H2, np.int32)  # (code + 1) << 4 | confidence
    start = np.linspace(1000, 60000, 16).astype(np.int32)
    s1, s2, s3 = np.tile(start, lanes), np.tile(start, lanes), np.tile(start, lanes)
    w = np.tile(np.array([-0.2, 0.3], np.float32), lanes)
    u = np.full(lanes, 0.7, np.float32)
    tables = [np.tile(prior.start, (lanes, 1)), np.tile(prior.second, (lanes, 1))]
    whole = [x.view("V32").reshape(-1) for x in tables]
    p1, p2 = np.zeros(lanes, np.int32), np.zeros(lanes, np.int32)
    active = np.searchsorted(-lengths, -np.arange(steps), side="left")  # lanes longer than t
    last = -1
    for t in range(steps):
        if t % 64 == 0:
            coder.reserve(64 * 8)
        k = int(active[t])
        if k != last:
            last = k
            lane = np.arange(k)
            b1, b2, b16, bw = lane * _H1, lane * _H2, lane * 16, lane * 2
            p1, p2, u = p1[:k], p2[:k], u[:k]
            low, rng = coder.low[:k], coder.rng[:k]
        q1 = p1 * np.int32(-1640531535)
        q2 = p2 * np.int32(-2048144777)
        q2 ^= q1
        i1 = (q1 >> 15 & (_H1 - 1)) + b1
        i2 = (q2 >> 13 & (_H2 - 1)) + b2
        e1, e2 = t1.take(i1), t2.take(i2)
        fresh = e2 == 0
        np.copyto(e2, e1 & -16, where=fresh)  # an unseen order-2 context takes the order-1 code, without confidence
        c1, c2 = (e1 >> 4) - 1, (e2 >> 4) - 1  # -1: nothing yet
        j1, j2 = (e1 & 15) + b16, (e2 & 15) + b16
        a1, a2 = s1.take(j1), s2.take(j2)
        jw = (c1 == c2) + bw
        x1, x2, v1 = _STRETCH.take(a1 >> 4, mode="clip"), _STRETCH.take(a2 >> 4, mode="clip"), w.take(jw)
        m = v1 * x1
        m += u * x2
        p = _SQUASH.take(m.astype(np.int32) + 2048, mode="clip")
        coder.widen(low, rng)
        bound = rng >> _U(16)
        bound *= p.astype(np.uint64)
        hit = (coder.code[:k] - low < bound) if codes is None else out[t, :k] == c2
        no = (~hit).astype(np.uint64)
        low += bound * no
        rng -= bound  # what is left after the hit's part
        np.copyto(rng, bound, where=hit)
        err = hit - p * np.float32(1 / 65536)
        err *= np.float32(0.0001)
        v1 += err * x1
        w[jw] = v1
        u += err * x2
        true = np.where(hit, c2, 0) if codes is None else out[t, :k]
        miss = np.flatnonzero(no)
        if len(miss):
            ml, mr = low.take(miss), rng.take(miss)
            mt = None if codes is None else true.take(miss)
            second = np.flatnonzero(((c1 != c2) & (c1 >= 0)).take(miss))
            if len(second):
                at = miss.take(second)
                j3, k1 = j1.take(at), c1.take(at)
                a3 = s3.take(j3)
                sl, sr = ml.take(second), mr.take(second)
                bound = (sr >> _U(16)) * np.clip(a3, 64, 65472).astype(np.uint64)
                got = (coder.code.take(at) - sl < bound) if codes is None else mt.take(second) == k1
                s3[j3] = a3 + (got * 65535 - a3 >> 5)
                ml[second] = np.where(got, sl, sl + bound)
                mr[second] = np.where(got, bound, sr - bound)
                found = second[got]
                if len(found):
                    low[miss[found]], rng[miss[found]] = ml[found], mr[found]
                    if codes is None:
                        true[at[got]] = k1[got]
                    rest = np.ones(len(miss), bool)
                    rest[found] = False
                    miss, ml, mr = miss[rest], ml[rest], mr[rest]
                    mt = None if codes is None else mt[rest]
            if len(miss):
                coder.widen(ml, mr, miss)
                step = mr >> _U(30)
                v = np.minimum((coder.code.take(miss) - ml) // step, _U((1 << 30) - 1)).astype(np.int64) if codes is None else None
                sub = None if codes is None else prior.sub.take(mt)
                row = miss * 16 + prior.first.take(p1.take(miss))
                first = share = 0
                for i in (0, 1):
                    rows = tables[i].take(row, axis=0)
                    if codes is not None:
                        d = sub >> 4 if i == 0 else sub & 15
                    elif i == 0:
                        d = _count(rows, v >> 15)
                    else:
                        d = _count(rows, np.minimum((v - (first << 15)) // share, (1 << 15) - 1))
                    flat = rows.reshape(-1)
                    at = np.arange(0, 16 * len(miss), 16) + d
                    a = flat.take(at).astype(np.int64)
                    f = flat.take(at + 1, mode="wrap") - a & 32767
                    more = _MIX.take(d, axis=0)
                    more -= rows
                    more >>= _RATE
                    more += rows
                    whole[i][row] = more.view("V32").reshape(-1)
                    if i == 0:
                        first, share, one = a, f, d
                        row = miss * 16 + d
                ml += step * ((first << 15) + a * share).astype(np.uint64)
                mr = step * (share * f).astype(np.uint64)
                coder.widen(ml, mr, miss)
                if codes is None:
                    sub = one << 4 | d
                    total = np.maximum(prior.total.take(sub), 1)
                    step = mr // total.astype(np.uint64)
                    v = np.minimum(((coder.code.take(miss) - ml) // step).astype(np.int64), total - 1)
                    mt = (np.searchsorted(prior.find, sub << 24 | v, side="right") - 1).astype(np.int32)
                    true[miss] = mt
                else:
                    step = mr // prior.total.take(sub).astype(np.uint64)
                ml += step * prior.low.take(mt).astype(np.uint64)
                mr = step * prior.freq.take(mt).astype(np.uint64)
                out_of = np.flatnonzero(mt == escape)
                if len(out_of):
                    at, el, er = miss.take(out_of), ml.take(out_of), mr.take(out_of)
                    for shift in (_ESCAPE_BITS, 0):
                        coder.widen(el, er, at)
                        step = er >> _U(_ESCAPE_BITS)
                        if codes is None:
                            digit = np.minimum((coder.code.take(at) - el) // step, _U(0xFFFF))
                            raw[t, at] |= (digit << _U(shift)).astype(np.uint32)
                        else:
                            digit = raw[t, at].astype(np.uint64) >> _U(shift) & _U(0xFFFF)
                        el += step * digit
                        er = step
                    ml[out_of], mr[out_of] = el, er
                low[miss], rng[miss] = ml, mr
        if codes is None:
            out[t, :k] = true
        keep = true != escape  # an escape is no prediction
        seen = (true + 1) << 4 | 1
        for table, i, e, c, s, j, a in ((t1, i1, e1, c1, s1, j1, a1), (t2, i2, e2, c2, s2, j2, a2)):
            ok = c == true
            s[j] = a + (ok * np.int32(65535) - a >> 5)
            e += (e & 15 != 15) & ok
            new = np.where(ok, e, seen)
            table[i] = np.where(keep, new, e)
        p2, p1 = p1, true
    return out


def encode_frame(documents: list[tuple[int | None, bytes]], block: int = BLOCK) -> bytes:
    """Documents (doc_id, ids as little-endian u32, any of them) as one frame."""
    data = b"".join(b for _, b in documents)
    ids = np.frombuffer(data, "<u4")
    prior = Prior.of(ids, block)
    dumped = prior.dump()
    codes = prior.codes(ids)
    sizes = np.array([min(block, len(ids) - s) for s in range(0, len(ids), block)], np.int64)
    coded: list[bytes] = []
    for a in range(0, len(sizes), LANES):
        own = sizes[a : a + LANES]

        def dealt(x: np.ndarray) -> np.ndarray:
            part = np.zeros((len(own), int(own[0])), x.dtype)
            flat = x[a * block : a * block + int(own.sum())]
            part.reshape(-1)[: len(flat)] = flat
            return np.ascontiguousarray(part.T)

        coder = _Coder(len(own), capacity=int(own[0]))
        _run(coder, own, prior, dealt(codes), dealt(ids.astype(np.uint32)))
        coder.finish()
        coded += [coder.out[i, : coder.at[i]].tobytes() for i in range(len(own))]
    table = b"".join(struct.pack("<qI", NO_ID if d is None else d, len(b) // 4) for d, b in documents)
    view = memoryview(data)
    table += b"".join(struct.pack("<IIII", n, len(c), zlib.crc32(c), zlib.crc32(view[4 * block * i : 4 * (block * i + n)])) for i, (n, c) in enumerate(zip(sizes.tolist(), coded, strict=True)))
    table += dumped
    return HEAD.pack(MAGIC, block, len(documents), len(ids), len(sizes), len(dumped), zlib.crc32(table)) + table + b"".join(coded)


class CorruptFrame(ValueError):
    pass


def decode_frame(frame: bytes) -> list[tuple[int | None, bytes]]:
    """The documents of a frame; every checksum is verified (CorruptFrame otherwise)."""
    if len(frame) < HEAD.size:
        raise CorruptFrame("short frame")
    magic, _, n_docs, n_ids, n_blocks, n_prior, crc = HEAD.unpack_from(frame)
    begin = HEAD.size + 12 * n_docs + 16 * n_blocks
    at = begin + n_prior
    if magic != MAGIC or len(frame) < at or zlib.crc32(frame[HEAD.size : at]) != crc:
        raise CorruptFrame("damaged header")
    docs = np.frombuffer(frame, np.dtype([("id", "<i8"), ("n", "<u4")]), n_docs, HEAD.size)
    blocks = np.frombuffer(frame, np.dtype([("n", "<u4"), ("bytes", "<u4"), ("crc", "<u4"), ("ids", "<u4")]), n_blocks, HEAD.size + 12 * n_docs)
    prior = Prior.load(frame[begin:at])
    escape = len(prior.ids)
    names = np.append(prior.ids, 0).astype(np.uint32)
    ends = at + np.cumsum(blocks["bytes"].astype(np.int64))
    if len(frame) != (int(ends[-1]) if n_blocks else at):
        raise CorruptFrame("wrong length")
    for i in range(n_blocks):
        if zlib.crc32(frame[int(ends[i]) - int(blocks["bytes"][i]) : int(ends[i])]) != blocks["crc"][i]:
            raise CorruptFrame(f"damaged block {i}")
    out = []
    for a in range(0, n_blocks, LANES):
        own = blocks[a : a + LANES]
        lo, hi = int(ends[a]) - int(own["bytes"][0]), int(ends[a + len(own) - 1])
        words = np.concatenate([np.frombuffer(frame, "<u2", (hi - lo) // 2, lo), np.zeros(8, "<u2")])
        starts = (ends[a : a + len(own)] - own["bytes"] - lo) // 2
        lengths = own["n"].astype(np.int64)
        raw = np.zeros((int(lengths[0]), len(own)), np.uint32)
        codes = _run(_Coder(len(own), words=words.astype(np.uint64), starts=starts.astype(np.int64)), lengths, prior, None, raw)
        ids = np.where(codes == escape, raw, names.take(codes))
        for i in range(len(own)):
            b = ids[: own["n"][i], i].astype("<u4").tobytes()
            if zlib.crc32(b) != own["ids"][i]:
                raise CorruptFrame(f"block {a + i} decodes to other ids")
            out.append(b)
    data, result, at = b"".join(out), [], 0
    if len(data) != 4 * n_ids:
        raise CorruptFrame("ids are missing")
    for d, n in zip(docs["id"].tolist(), docs["n"].tolist(), strict=True):
        result.append((None if d == NO_ID else d, data[at : at + 4 * n]))
        at += 4 * n
    return result
