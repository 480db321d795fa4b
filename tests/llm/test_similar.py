import random
import re

import numpy as np

import corpus_pipeline as P
from laneatlas.llm.similar import alike, bands, drop_similar, shingles


def _shingles(text, n=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def _jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def _components(sets, least=0.8):
    """{name: smallest name reachable} of {name: set}."""
    names = sorted(sets)
    root = {a: a for a in names}
    find = lambda a: a if root[a] == a else find(root[a])
    for i, a in enumerate(names):
        for b in names[:i]:
            if _jaccard(sets[a], sets[b]) >= least:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {a: find(a) for a in names}


def _planted():
    """Texts with copies in which one, two or three words are changed: similarities around 0.8."""
    r = random.Random(5)
    out = []
    for _ in range(60):
        w = [f"w{r.randrange(5000)}" for _ in range(r.randint(40, 120))]
        out.append(w)
        for changes in (1, 2, 3):
            c = list(w)
            for at in r.sample(range(len(c)), changes):
                c[at] = f"x{r.randrange(5000)}"
            out.append(c)
    return dict(enumerate(" ".join(w) for w in out))


def test_stage_links_all_pairs_from_0_8(spark):
    texts = _planted()
    sets = {k: _shingles(t) for k, t in texts.items()}
    near = sum(0.8 <= _jaccard(sets[a], sets[b]) < 0.9 for a in sets for b in sets if a < b)
    assert near > 30
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars int")
    want = set(_components(sets).values())
    assert {r.doc_id for r in P.drop_near_copies(spark, docs, "").collect()} == want


def test_corpus(spark, corpus):
    df = spark.createDataFrame([(k, t, 1) for k, t in corpus.items()], "doc_id long, text string, x int")
    kept = drop_similar(df)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == set(_components({k: _shingles(t) for k, t in corpus.items()}).values())


def test_edges(spark, edges):
    rows = drop_similar(spark.createDataFrame(edges, "doc_id long, text string")).collect()
    assert sorted(r.doc_id for r in rows) == [1, 4, 5, 6, 7]
    assert drop_similar(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_recall_of_the_bands():
    r = np.random.default_rng(2)
    met = 0
    for _ in range(2000):
        x = r.integers(0, 1 << 63, 110, dtype=np.uint64)
        a, b = x[:99], np.concatenate([x[:88], x[99:]])  # 88 of 110: similarity 0.8
        met += bool((bands(np.sort(a)) == bands(np.sort(b))).any())
    assert met >= 1997


def test_alike_joins_what_brute_force_joins():
    texts = _planted()
    sets = {k: _shingles(t) for k, t in texts.items()}
    links = alike([shingles(texts[k]) for k in sorted(texts)], list(range(len(texts))), 0.8)
    root = {k: k for k in texts}
    find = lambda a: a if root[a] == a else find(root[a])
    for i, j in links:
        x, y = sorted((find(i), find(j)))
        root[y] = x
    assert {k: find(k) for k in texts} == _components(sets)


def test_blocks_of_large_buckets_lose_no_pair(spark, monkeypatch):
    from laneatlas.llm import similar

    monkeypatch.setattr(similar, "BLOCK", 3)
    texts = _planted()
    base = " ".join(f"h{i}" for i in range(60))
    texts |= {1000 + k: base + f" own{k}" for k in range(40)}  # one group of near copies
    sets = {k: _shingles(t) for k, t in texts.items()}
    df = spark.createDataFrame([(k, t) for k, t in texts.items()], "doc_id long, text string")
    assert {r.doc_id for r in drop_similar(df).collect()} == set(_components(sets).values())
