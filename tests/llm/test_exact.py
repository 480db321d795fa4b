import hashlib
import re

from laneatlas.llm.exact import drop_exact_duplicates, exact_duplicates


def _plain(t):
    return re.sub(r"[\x20\x09-\x0D]", "", t or "")


def test_edges_and_clashing_columns(spark, edges):
    df = spark.createDataFrame([(i, t, 1, "x", 2) for i, t in edges], "doc_id long, text string, run int, sha string, row int")
    rows = exact_duplicates(df).collect()
    assert len(rows) == len(edges)
    groups = {}
    for i, t in edges:
        groups.setdefault(_plain(t), []).append((i, t))
    for r in rows:
        own = next(g for k, g in groups.items() if hashlib.sha256(k.encode()).hexdigest() == r.text_sha256)
        best = min(own, key=lambda x: (-len(x[1] or ""), x[0] is None, x[0]))
        assert (r.keep_id, r.group_size) == (best[0], len(own))
    assert sum(r.kept for r in rows) == len(groups)
    kept = drop_exact_duplicates(df)
    assert kept.columns == df.columns and kept.count() == len(groups)


def test_hot_group(spark):
    df = spark.range(6000).selectExpr("id as doc_id", "if(id % 3 = 0, 'the same', concat('own ', id)) as text")
    rows = exact_duplicates(df)
    assert rows.count() == 6000 and rows.where("kept").count() == 4001
    assert rows.where("group_size = 2000 and keep_id = 0").count() == 2000


def test_merge_is_the_same_for_any_tree(spark, corpus):
    df = spark.createDataFrame(list(corpus.items()), "doc_id long, text string")
    want = None
    for leaves, fan_in in ((1, 2), (16, 4), (7, 2)):
        got = sorted(tuple(r)[:5] for r in exact_duplicates(df.repartition(leaves), fan_in=fan_in).collect())
        want = want or got
        assert got == want


def test_empty(spark):
    assert exact_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_no_python_in_the_plan(spark, corpus):
    df = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    plan = exact_duplicates(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
