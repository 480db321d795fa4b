"""Line dedup against all pairs of lines."""

import numpy as np
import pyarrow as pa

import hashlib

from laneatlas.llm.lines import dedup_lines, linked, signatures

Q, LEAST = 7, 0.8


def _shingles(x):
    return {x[i : i + Q] for i in range(len(x) - Q + 1)} or {x}


def _brute(docs):
    """{doc_id: kept text} for {doc_id: text}."""
    at = {}
    for k in sorted(docs):
        for i, x in enumerate((docs[k] or "").split("\n")):
            if x.strip():
                at.setdefault(x, (k, i))
    lines = list(at)
    sets, root = [_shingles(x) for x in lines], list(range(len(lines)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(lines)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if min(len(a), len(b)) >= LEAST * max(len(a), len(b)) and len(a & b) >= LEAST * len(a | b):
                root[find(i)] = find(j)
    first = {}
    for i, x in enumerate(lines):
        first[find(i)] = min(first.get(find(i), at[x]), at[x])
    keep = {x: first[find(i)] for i, x in enumerate(lines)}
    return {k: "\n".join(x for i, x in enumerate((t or "").split("\n")) if not x.strip() or keep[x] == (k, i)) for k, t in docs.items()}


def _same(spark, docs):
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    want = _brute(docs)
    for r in dedup_lines(df, with_text=True).collect():
        assert r["kept"] == want[r["doc_id"]], r["doc_id"]
        assert r["kept_sha256"] == hashlib.sha256(r["kept"].encode()).hexdigest()
        assert r["n_lines"] == len((docs[r["doc_id"]] or "").split("\n")) == r["n_kept"] + r["n_removed"]


def test_fixture(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    _same(spark, {r[0]: r[1] for r in rows})


def test_edges(spark):
    base = "the quick brown fox jumps over the lazy dog near the river bank at noon today"
    docs = {1: None, 2: "", 3: "\n\n", 4: base, 5: base.replace("noon", "moon"), 6: base + "\nab\nab", 7: "ab\n \n\tx", 8: base[::-1], 9: "é" * 40 + "\n" + "é" * 39}
    _same(spark, docs)
    assert dedup_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_repeated_rows_and_extra_columns(spark):
    df = spark.createDataFrame([(1, "same line here", 5), (1, "same line here", 6), (None, "same line here", 7)], "doc_id long, text string, key int")
    got = sorted((r["doc_id"] or 99, r["n_kept"]) for r in dedup_lines(df).collect())
    assert got == [(1, 0), (1, 1), (99, 0)]


def test_links_cover_all_similar_pairs():
    lines = ["abcdefghijklmnop" + "qrstuv" * k for k in range(1, 8)] + ["zzzzzzzzzz"]
    found = {tuple(sorted(x)) for x in linked(lines, Q, LEAST)}
    root = list(range(len(lines)))
    for a, b in found:
        root = [root[a] if r == root[b] else r for r in root]
    for i in range(len(lines)):
        for j in range(i):
            a, b = _shingles(lines[i]), _shingles(lines[j])
            if len(a & b) >= LEAST * len(a | b):
                assert root[i] == root[j]


def test_signatures_are_minima_of_the_line_alone():
    one = signatures(["the first line here"], Q, 8)
    both = signatures(["some other line", "the first line here", "a third one, longer"], Q, 8)
    assert (both[1] == one[0]).all()


def test_blocks_of_large_buckets_lose_no_pair(spark, monkeypatch):
    import random

    from laneatlas.llm import lines

    monkeypatch.setattr(lines, "BLOCK", 3)
    r = random.Random(4)
    stem = "".join(r.choice("abcdefgh ") for _ in range(90))
    docs = {k: stem[: 80 + k % 9] + "".join(r.choice("xyz") for _ in range(k % 14)) + "\n" + "".join(r.choice("abc ") for _ in range(30)) for k in range(60)}
    _same(spark, docs)


def test_one_hash_for_different_lines(spark, monkeypatch):
    """Lines under one hash are equal only if their checks agree."""
    from laneatlas.llm import lines

    monkeypatch.setattr(lines, "_hash", lambda x, seed=7: 5)
    texts = ["first line of all", "second line of all, longer", "first line of all"]
    first = {}
    for k, t in enumerate(texts):
        first.setdefault((lines._hash(t), lines._check(t)), k)
    assert sorted(first.values()) == [0, 1]


def test_very_long_lines(spark):
    x = "lorem ipsum dolor sit amet " * 4000
    _same(spark, {1: x, 2: x + "!", 3: x[: len(x) // 3] + "\n" + "q" * 50_000})


def test_a_slot_at_a_time_in_one_partition(spark, monkeypatch):
    """However much one partition holds, a task looks at entries of one slot: more data, more slots of the same size."""
    from laneatlas.llm import lines

    held = []
    monkeypatch.setattr(lines, "SLOT", 40)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "1")
        docs = {k: "\n".join(f"line {j} of document {k // 2} and more text" for j in range(5)) for k in range(40)}
        _same(spark, docs)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    rng = np.random.default_rng(1)
    for n in (4_000, 16_000):
        e = np.empty(n, [("band", "<u8"), ("h", "<i8")])
        e["band"], e["h"] = rng.integers(0, 1 << 63, n), rng.integers(-(1 << 62), 1 << 62, n)
        slots = -(-n // lines.SLOT)
        g = (e["band"] >> np.uint64(20)) % np.uint64(slots)
        batch = pa.RecordBatch.from_arrays([pa.array(np.sort(g).astype(np.int64)), pa.array([x.tobytes() for x in e[np.argsort(g, kind="stable")]], pa.binary())], names=["slot", "entries"])
        sizes = [len(raw) // 16 for raw in lines._slots(iter([batch.slice(0, n // 3), batch.slice(n // 3)]))]
        assert sum(sizes) == n
        held.append(max(sizes))
    assert held[1] < 2 * held[0]
