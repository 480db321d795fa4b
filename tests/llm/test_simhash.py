import random
import re

import pytest
import xxhash

from laneatlas.llm.components import components, forest
from laneatlas.llm.simhash import candidates, drop_near_duplicates, links, near_duplicates, segments, simhash

import numpy as np


def _brute(text, n=4):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + n]).encode(), 42) for i in range(max(1, len(w) - n + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def _components(fps, distance=4):
    """{name: smallest name reachable} of {name: fingerprint}."""
    names, root = sorted(fps), {}
    for a in names:
        root[a] = a
    find = lambda a: a if root[a] == a else find(root[a])
    for i, a in enumerate(names):
        for b in names[:i]:
            if (fps[a] ^ fps[b]).bit_count() <= distance:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {a: find(a) for a in names}


def test_corpus(spark, corpus):
    df = spark.createDataFrame([(k, t, 1) for k, t in corpus.items()], "doc_id long, text string, fp int")
    fps = {k: _brute(t) for k, t in corpus.items()}
    want = _components(fps)
    rows = near_duplicates(df).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in rows} == {k: (f"{fps[k]:016x}", want[k]) for k in fps} and len(rows) == len(fps)
    kept = drop_near_duplicates(df, words=5)
    assert kept.columns == df.columns
    five = _components({k: _brute(t, 5) for k, t in corpus.items()})
    assert {r.doc_id for r in kept.collect()} == set(five.values())


def test_edges(spark, edges):
    rows = near_duplicates(spark.createDataFrame(edges, "doc_id long, text string")).collect()
    by = {}
    for r in rows:
        by.setdefault(r.component_id, []).append(r.doc_id)
    assert sorted(by[1]) == [1, 2, 3] and len(rows) == len(edges)
    assert sorted(by[4], key=str) == [4, 4, None]
    assert simhash(None) == simhash(" \t") == b"\0" * 8
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert drop_near_duplicates(spark.createDataFrame(edges, "doc_id long, text string")).count() == len(by)


@pytest.mark.parametrize("parts, small, block", [(3, 8, 2000), (None, 1, 2000), (2, 2, 7), (4, 1, 3), (3, 10_000, 2000)])
def test_every_block_finds_all_links(spark, parts, small, block):
    r = random.Random(3)
    fps = set()
    for c in [r.getrandbits(64) for _ in range(12)]:
        for _ in range(50):
            x = c
            for _ in range(r.randint(0, 5)):
                x ^= 1 << r.randrange(64)
            fps.add(x)
    sign = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(sign(x),) for x in fps], "fp long")
    want = _components({sign(x): x for x in fps})
    got = {x.node: x.root for x in components(links(df, parts=parts, small=small, block=block)).collect()}
    assert {k: got.get(k, k) for k in want} == want


def test_segments_cover_the_distance():
    for distance in (2, 4, 6):
        for parts in (2, 3, 4, 5):
            plan = segments(distance, parts)
            assert sum(r + 1 for *_, r in plan) > distance or len(plan) == parts
            assert distance < sum(r + 1 for *_, r in plan)


def test_components(spark):
    r = random.Random(1)
    chain = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)]
    pairs = [p if r.random() < 0.5 else p[::-1] for p in chain] + [(5, 5), (None, 3)]
    r.shuffle(pairs)
    got = {x.node: x.root for x in components(spark.createDataFrame(pairs, "a long, b long").repartition(7)).collect()}
    assert got == {**{i: 0 for i in range(201)}, **{1000 + i: 1000 for i in range(300)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_forest():
    a, b = forest(np.array([5, 3, 9, 9]), np.array([3, 1, 8, 8]))
    assert dict(zip(a.tolist(), b.tolist())) == {3: 1, 5: 1, 9: 8}


def test_exploded_rows_are_never_broadcast(spark, tmp_path):
    """Spark's estimate of exploded rows is that of their input: at its default limit it sent the probes of 0.6 GB of texts through the driver."""
    path = str(tmp_path / "fps")
    spark.range(2000).selectExpr("xxhash64(id) as fp").write.parquet(path)
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") == "10485760b"
    joined = candidates(spark.read.parquet(path), segments(4, 4), 4, 8)
    joins = re.findall(r"(\w+Join)\b", joined._jdf.queryExecution().sparkPlan().toString())
    assert joins and joins[0] == "SortMergeJoin"
