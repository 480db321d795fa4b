import hashlib
import random

import numpy as np
import pytest

from laneatlas.llm import suffix as S


def _brute(docs, length):
    """[(n_bytes, n_removed, n_spans, sha256)] for texts in order."""
    seen, out = set(), []
    for t in docs:
        d = (t or "").encode()
        cut = np.zeros(len(d) + 1, int)
        for p in range(len(d) - length + 1):
            w = d[p : p + length]
            if w in seen:
                cut[p] += 1
                cut[p + length] -= 1
            seen.add(w)
        gone = np.cumsum(cut)[: len(d)] > 0
        kept = bytes(np.frombuffer(d, np.uint8)[~gone])
        out.append((len(d), int(gone.sum()), int((np.diff(np.append(False, gone).astype(int)) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def test_corpus(spark, corpus):
    df = spark.createDataFrame([(k, t, 1) for k, t in corpus.items()], "doc_id long, text string, key int").repartition(5)
    want = dict(zip(sorted(corpus), _brute([corpus[k] for k in sorted(corpus)], 100)))
    assert {r[0]: tuple(r)[1:] for r in S.remove_repeats(df).collect()} == want


def test_edges(spark, edges):
    rows = sorted(edges, key=lambda r: (r[0] is None, r[0], r[1] or ""))
    want = sorted(zip([i for i, _ in rows], _brute([t for _, t in rows], 20)), key=str)
    got = S.remove_repeats(spark.createDataFrame(edges, "doc_id long, text string"), length=20, with_text=True).collect()
    assert sorted(((r[0], tuple(r)[1:5]) for r in got), key=str) == want
    assert all(len(r.kept) == r.n_bytes - r.n_removed and len(r.spans) == r.n_spans for r in got)
    assert S.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("length, hot, chunk, least", [(100, 5000, 20_000, 1000), (40, 3, 50, 1000), (35, 5000, 10, 1000), (40, 5000, 50, 1), (100, 5000, 20_000, 2)])
def test_shared_passages(spark, length, hot, chunk, least):
    r = random.Random(1)
    base = ["".join(r.choice("ab") for _ in range(60)) for _ in range(6)]
    docs = ["".join(r.choice(base) if r.random() < 0.6 else "".join(r.choice("ab é") for _ in range(r.randint(0, 30))) for _ in range(r.randint(0, 12))) for _ in range(200)]
    texts = S.ordered_keys(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").repartition(6), "text", "doc_id")
    spans = {}
    for x in S.repeated_spans(texts, length, hot=hot, chunk=chunk, least=least).collect():
        spans.setdefault(x.key, []).append((x.a, x.b))
    for i, (_, removed, runs, _) in enumerate(_brute(docs, length)):
        own = S.merged_spans(spans.get(i, []))
        assert (sum(b - a for a, b in own), len(own)) == (removed, runs)


def test_sort_and_collisions(monkeypatch):
    r = random.Random(2)
    pieces = np.array([[r.choice((97, 98)) for _ in range(12)] for _ in range(40)], np.uint8)
    place = np.array([(i, j) for i in range(40) for j in range(5)])
    group = np.sort(np.array([r.randrange(4) for _ in range(200)]))

    def check():
        got, seen = S.suffix_repeats(group, pieces, place, 8), set()
        for k, (i, j) in enumerate(place):
            w = (group[k], pieces[i, j : j + 8].tobytes())
            assert got[k] == (w in seen)
            seen.add(w)

    check()
    monkeypatch.setattr(S, "_CODE", np.zeros(256, np.uint64))  # every hash collides
    check()


def test_heavy_anchors(spark):
    from pyspark.sql import functions as F

    from laneatlas.llm.common import heavy

    rows = spark.range(0, 90_000, 1, 7).select(F.when(F.col("id") % 3 == 0, -5).when(F.col("id") % 100 == 1, 7).otherwise(F.col("id")).alias("g"))
    assert {r[0] for r in heavy(rows, "g").collect()} == {-5} | ({7} if rows.where("g = 7").count() > 1000 else set())
    assert {r[0] for r in heavy(rows, "g", least=100).collect()} == {-5, 7}
    assert heavy(rows.where("g is null"), "g").count() == 0


def test_one_work_table(spark, monkeypatch):
    """Each file of a work table starts two processes; the fragments are blocks of Spark instead, gone when the result is there."""
    made, kept, write = [], spark.sparkContext._jsc.getPersistentRDDs().size(), S.written
    monkeypatch.setattr(S, "written", lambda *a: made.append(write(*a)) or made[-1])
    docs = spark.createDataFrame([(i, "a passage that comes again " * 6 + str(i)) for i in range(50)], "doc_id long, text string").repartition(9)
    assert S.remove_repeats(docs, 40).where("n_removed > 0").count() == 50
    assert len(made) == 1
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == kept
