import pytest
from hypothesis import given
from hypothesis import strategies as st

from laneatlas.llm.mixing import mix, repeat_to_mix, water_fill


@given(st.lists(st.tuples(st.integers(0, 50), st.integers(1, 5)), min_size=1, max_size=8), st.floats(0.1, 3))
def test_water_fill(rows, share):
    sizes, weights = [s for s, _ in rows], [w for _, w in rows]
    budget = share * sum(sizes)
    t = water_fill(sizes, weights, budget, 2)
    assert all(x <= 2 * s + 1e-9 for x, s in zip(t, sizes))
    assert sum(t) == pytest.approx(min(budget, 2 * sum(sizes)))
    level = [x / w for x, s, w in zip(t, sizes, weights) if 0 < x < 2 * s - 1e-9]
    assert not level or max(level) == pytest.approx(min(level))  # those below their caps share by weight
    full = [x / w for x, s, w in zip(t, sizes, weights) if s and x >= 2 * s - 1e-9]
    assert not level or all(f <= level[0] + 1e-6 for f in full)


def _rows():
    out = [(i, "w " * (1 + i % 7), f"s{i % 3}") for i in range(900)]
    return [*out, (900, None, None), (901, "a b", None), (901, "a b", None), (None, "c", "s0")]


def test_mix_meets_its_targets(spark):
    df = spark.createDataFrame(_rows(), "doc_id long, text string, source string")
    rows = mix(df).collect()
    assert len(rows) == len(_rows()) and all(r.taken <= 2 * r.size for r in rows)
    total = {}
    for r in rows:
        a = total.setdefault(r.source, [0, 0, r.target, r.source_size])
        a[0] += r.taken
        a[1] += r.size
    for taken, size, target, source_size in total.values():
        assert size == source_size and abs(taken - target) <= 7
    want = water_fill([total[s][1] for s in ("s0", "s1", "s2", None)], [3, 1, 2, 3], 1.5 * sum(a[1] for a in total.values()), 2)
    assert [total[s][2] for s in ("s0", "s1", "s2", None)] == pytest.approx(want)
    assert sorted(map(tuple, mix(df).drop("row").collect()), key=str) == sorted((tuple(r)[:-1] for r in rows), key=str)
    again = repeat_to_mix(df)
    assert again.columns == df.columns and again.count() == sum(r.whole + r.extra for r in rows)


def test_weights_by_name_empty_and_bound(spark):
    df = spark.createDataFrame(_rows(), "doc_id long, text string, source string")
    assert {r.source for r in mix(df, share=0.2, weights={"s1": 1.0}).where("taken > 0").collect()} == {"s1"}
    assert mix(df.limit(0)).count() == 0


@pytest.mark.parametrize("share, cycle", [(1.5, (3, 1, 2)), (0.3, (5, 1)), (5.0, (1,))])
def test_many_sources_are_weighed_as_water_fills(spark, share, cycle):
    own = {f"s{i:03d}": [("w " * (1 + (i * j) % 9)).strip() for j in range(1 + i % 5)] for i in range(120)}
    own["empty"] = [None, "", "  "]
    df = spark.createDataFrame([(n, t, s) for n, (s, t) in enumerate((s, t) for s, v in own.items() for t in v)], "doc_id long, text string, source string")
    size = {s: sum(len((t or "").split()) for t in v) for s, v in own.items()}
    names = sorted(size)
    want = water_fill([size[n] for n in names], [cycle[i % len(cycle)] for i in range(len(names))], share * sum(size.values()), 2)
    got = {r.source: r.target for r in mix(df, share=share, cycle=cycle).collect()}
    assert [got[n] for n in names] == pytest.approx(want)


def test_clashing_columns_and_long_texts(spark):
    rows = [(1, "w " * 60_000, "a", 7, 8, 9, 10, 11), (2, "x y", "b", 7, 8, 9, 10, 11), (3, "z", "b", 7, 8, 9, 10, 11)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, _times int, _copy int, size int, name int, _row int")
    out = repeat_to_mix(df)
    assert out.columns == df.columns and {(r._times, r._copy, r.size, r.name, r._row) for r in out.collect()} == {(7, 8, 9, 10, 11)}
    assert {r.doc_id: r.size for r in mix(df).collect()} == {1: 60_000, 2: 2, 3: 1}
