import hashlib
import random

import pytest

from laneatlas.llm.fingerprint import edit_distances, fingerprint, fingerprint_edits, fingerprints, likeness


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_edit_distances():
    r = random.Random(1)
    word = lambda: "".join(r.choice("abc") for _ in range(r.choice((0, 1, 5, 63, 64))))
    a, b = [word() for _ in range(80)], [word() for _ in range(80)]
    assert edit_distances(a, b).tolist() == [_distance(x, y) for x, y in zip(a, b)]


def test_boundaries_come_from_the_context():
    r = random.Random(2)
    text = bytes(r.randrange(97, 123) for _ in range(8000))
    whole, moved, other = fingerprints([text, b"new start" + text, bytes(r.randrange(97, 123) for _ in range(8000))])
    assert fingerprints([text, b"", text]) == [whole, "3::", whole]
    near, far = likeness([whole, whole], [moved, other])
    assert near > 0.9 and far < 0.3
    assert likeness(["3::", "3::", "3:a:a"], ["3::", "3:a:a", "48:a:a"]).tolist() == [1.0, 0.0, 0.0]
    assert max(len(p) for f in (whole, moved) for p in f.split(":")[1:2]) <= 64


def _plain(data):
    """The fingerprint of a text by loops over its bytes."""
    import zlib

    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    if not data:
        return "3::"
    trigger = []
    for i in range(len(data)):
        h = 0
        for k in range(7):
            h += (data[i - k] if i >= k else 0) * pow(0x01000193, k, 1 << 32)
        h &= 0xFFFFFFFF
        h ^= h >> 15
        h = h * 0x85EBCA6B & 0xFFFFFFFF
        h ^= h >> 13
        trigger.append((h + 1) & 0xFFFFFFFF)

    def ends(size):
        return [i + 1 for i, v in enumerate(trigger) if v and v % size == 0 or v == 0]

    def letters_of(at, most):
        cuts = [0, *at[: most - 1]]
        cuts += [] if cuts[-1] == len(data) else [len(data)]
        return "".join(letters[zlib.crc32(data[a:b]) >> 8 & 63] for a, b in zip(cuts, cuts[1:]))

    size = 3
    while size * 64 < len(data):
        size *= 2
    while size > 3 and len(ends(size)) < 31:
        size //= 2
    return f"{size}:{letters_of(ends(size), 64)}:{letters_of(ends(2 * size), 32)}"


def _like(x, y):
    if x == y:
        return 1.0
    (p, *s), (q, *t) = x.split(":"), y.split(":")
    sizes = {int(p): s[0], 2 * int(p): s[1]}, {int(q): t[0], 2 * int(q): t[1]}
    both = [(sizes[0][k], sizes[1][k]) for k in sizes[0] if k in sizes[1]]
    return max([1 - _distance(a, b) / max(len(a), len(b)) for a, b in both if a and b] or [0.0])


def test_fingerprints_against_loops(corpus):
    texts = [t.encode()[:6000] for t in list(corpus.values())[:40]] + [b"", b"a", b"ab" * 50, bytes(range(256)) * 3]
    assert fingerprints(texts) == [_plain(t) for t in texts]
    own = fingerprints(texts)
    pairs = [(a, b) for a in own for b in own[::5]]
    assert likeness([a for a, _ in pairs], [b for _, b in pairs]).tolist() == pytest.approx([_like(a, b) for a, b in pairs])


def _check(spark, rows, parts):
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, _part int").repartition(parts)
    rows = [(i, t or "") for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0], r[1] or ""))]
    got = {}
    for r in fingerprint_edits(df).collect():
        got.setdefault(r.doc_id, []).append(r)
    for k, (i, t) in enumerate(rows):
        u = rows[(k + 1) % len(rows)][1]
        cut = len(t) // 4
        e = t[: len(t) - cut] + u[:cut]
        own, new, nxt = fingerprints([x.encode() for x in (t, e, u)])
        r = next(r for r in got[i] if r.edited_sha256 == hashlib.sha256(e.encode()).hexdigest() and r.fingerprint == own)
        assert (r.n_chars, r.edited_fingerprint) == (len(t), new)
        assert r.near_edited == pytest.approx(likeness([own], [new])[0]) and r.near_next == pytest.approx(likeness([own], [nxt])[0])
    assert sum(map(len, got.values())) == len(rows)


def test_corpus(spark, corpus):
    _check(spark, list(corpus.items()), 5)


def test_edges(spark, edges):
    _check(spark, edges, 3)
    _check(spark, [(5, "alone here")], 1)
    assert fingerprint_edits(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert fingerprint(spark.createDataFrame(edges, "doc_id long, text string")).where("fingerprint = '3::'").count() == 2
