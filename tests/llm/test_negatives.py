import numpy as np
import pytest

from laneatlas.llm.negatives import Block, Cells, augmented, hard_negatives


def brute(rows, anchors, positives=5, k=3, least=50, most=95, factor=256):
    """rows: (id, label, components); those that take part only."""
    rows = sorted(rows)
    wide = max((len(r[2]) for r in rows), default=0)
    ids, labels = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    x = np.array([[int(np.floor(factor * float(v))) for v in r[2]] + [0] * (wide - len(r[2])) for r in rows], dtype=np.int64).reshape(len(rows), wide)
    out = []
    for i in np.flatnonzero([anchors(a) for a in ids]):
        s = x @ x[i]
        order = np.lexsort((ids, -s))
        for p in [j for j in order if labels[j] == labels[i] and j != i][:positives]:
            fit = [j for j in order if labels[j] != labels[i] and least * s[p] <= 100 * s[j] <= most * s[p]][:k]
            out += [(int(ids[i]), int(ids[p]), r + 1, int(ids[j]), int(s[p]), int(s[j])) for r, j in enumerate(fit)]
    return sorted(out)


def _vectors(n, dims, seed, clusters=6, noise=0.4):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(clusters, dims))
    x = (centre[rng.integers(0, clusters, n)] + noise * rng.normal(size=(n, dims))).astype(np.float32)
    return x, rng.integers(0, 4, n)


SCHEMA = "vec_id long, embedding array<float>, label int, v string, cell int"


@pytest.mark.parametrize("block, sample, queries", [(16384, 4096, 8192), (37, 320, 4), (1000, 32, 10)])
def test_equal_to_brute_force(spark, block, sample, queries):
    x, labels = _vectors(400, 12, 4)
    x[100:180] = x[100]  # a fifth of the rows is one vector: ties, and a hot cell
    rows = [(i, x[i].tolist(), int(labels[i]), "x", 1) for i in range(400)]
    got = hard_negatives(spark.createDataFrame(rows, SCHEMA), anchor="id % 10 = 0", block=block, sample=sample, queries=queries)
    assert sorted(map(tuple, got.collect())) == brute([(r[0], r[2], r[1]) for r in rows], lambda a: a % 10 == 0)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    x, labels = _vectors(60, 4, 9)
    good = [(i, x[i].tolist(), int(labels[i]), None, None) for i in range(60)]
    odd = [(70, None, 1, None, None), (71, [1.0, None, 2.0, 0.0], 1, None, None), (72, [nan, 0.0, 0.0, 0.0], 1, None, None), (73, [inf, 0.0, 0.0, 0.0], 1, None, None), (74, [1.0, 1.0, 1.0, 1.0], None, None, None), (None, [1.0, 1.0, 1.0, 1.0], 1, None, None)]
    short = [(80, [2.0], 2, None, None), (90, [], 3, None, None), (100, [0.0] * 4, 1, None, None)]
    got = hard_negatives(spark.createDataFrame([*good, *odd, *short, *good[:20]], SCHEMA), anchor="id % 5 = 0", least=20, block=16)
    assert sorted(map(tuple, got.collect())) == brute([(r[0], r[2], r[1]) for r in [*good, *short]], lambda a: a % 5 == 0, least=20)


def test_large_components_stay_exact(spark):
    x, labels = _vectors(80, 6, 2)
    rows = [(i, (x[i] * 60_000).tolist(), int(labels[i]), None, None) for i in range(80)]
    got = hard_negatives(spark.createDataFrame(rows, SCHEMA), anchor="id % 4 = 0")
    assert sorted(map(tuple, got.collect())) == brute([(r[0], r[2], np.float32(r[1])) for r in rows], lambda a: a % 4 == 0)


def test_empty_and_one_label(spark):
    assert hard_negatives(spark.createDataFrame([], SCHEMA)).count() == 0
    assert hard_negatives(spark.createDataFrame([(1, [1.0], 1, None, None), (2, [1.0], 1, None, None)], SCHEMA)).count() == 0
    assert hard_negatives(spark.createDataFrame([(1, [1.0], 1, None, None)], SCHEMA), anchor="id = 5").count() == 0


def test_bounds_hold_and_leave_leaves_out():
    x, labels = _vectors(3000, 8, 1, clusters=20, noise=0.1)
    x = np.floor(256 * x / np.linalg.norm(x, axis=1)[:, None]).astype(float)
    top = float((x * x).sum(1).max())
    cells = Cells(x[:500], top, 16)
    at, (lo, hi) = cells.route(x), cells.bounds(x[:50])
    a, q = augmented(x, top), np.hstack([x[:50], np.zeros((50, 1))])
    d = np.sqrt(((q[:, None] - a[None]) ** 2).sum(2))
    for c in range(cells.n):
        assert (d[:, at == c] >= lo[:, c, None]).all() and (d[:, at == c] <= hi[:, c, None]).all()
    block = Block(np.arange(3000), labels, x, top)
    lo, hi = block.bounds(x[:50], (x[:50] ** 2).sum(1))
    for c, (s, e) in enumerate(zip(block.starts[:-1], block.starts[1:], strict=True)):
        rows = block.ids[s:e]
        assert (d[:, rows] >= lo[:, c, None]).all() and (d[:, rows] <= hi[:, c, None]).all()
    assert (lo > np.sort(d, 1)[:, 5, None]).mean() > 0.5  # leaves that a search for five neighbours never reads
