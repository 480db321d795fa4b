import hashlib
import zlib
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from laneatlas.llm.common import work_tables
from laneatlas.llm.merkle import field, manifest

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def _hash(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _leaf(row):
    return _hash(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def _tree(hashes):
    out = [hashes]
    while len(out[-1]) > 1:
        out.append([_hash(*out[-1][i : i + 16]) for i in range(0, len(out[-1]), 16)])
    return out


def _walk(tree, at, new):
    """All siblings, and the top when the node at `at` becomes `new`."""
    beside = ""
    for level in tree[:-1]:
        first = at // 16 * 16
        run = level[first : first + 16]
        beside += "".join(run[: at - first] + run[at - first + 1 :])
        run[at - first] = new
        new, at = _hash(*run), at // 16
    return beside, new


def brute(rows, change):
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append((r[0], _leaf(r), _leaf(change(r))))
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for k in names:
        by[k].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    trees = [_tree([x[1] for x in by[k]]) for k in names]
    top = _tree([t[-1][0] for t in trees])
    out = []
    for q, k in enumerate(names):
        for p, (d, leaf, new) in enumerate(by[k]):
            low, got = _walk(trees[q], p, new)
            high, got = _walk(top, q, got)
            out.append((d, leaf, trees[q][-1][0], top[-1][0], _hash(low + high), got, got == top[-1][0]))
    return sorted(out, key=str)


def _tampered(r):
    hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
    return (*r[:4], "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r[4])) if hit and r[4] else r


def _made(spark, rows):
    df = spark.createDataFrame([(*r, 7, "x", 0) for r in rows], "doc_id long, source string, lang string, n_chars long, text string, _key int, _path string, _at int")
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    change = F.when(hit, F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise(F.col("text"))
    return sorted(map(tuple, manifest(df, FIELDS, changed={"text": change}).collect()), key=str)


def test_nulls_repeats_clashes_and_long_texts(spark):
    rows = [(i, "a" if i % 3 else "B", "en", i, f"Text {i}") for i in range(60)]
    rows += [(1, None, None, None, None), (2, "", None, 5, ""), (None, "a", "é", 1, "Ünique Ä"), (5, "a", "en", 5, "Text 5"), (5, "a", "en", 5, "Text 5"), (9, "é", "de", 3, "Long " * 50_000)]
    assert _made(spark, rows) == brute(rows, _tampered)


@pytest.mark.parametrize("n", [1, 2, 16, 17, 257, 300])
def test_sizes_around_powers_of_the_fan(spark, n):
    rows = [(i * 7, "one", "en", 1, f"Row {i}") for i in range(n)]
    assert _made(spark, rows) == brute(rows, _tampered)


def test_many_sources(spark):
    rows = [(i, f"s{i % 40:03d}", "en", 1, f"Row {i}") for i in range(90)]
    assert _made(spark, rows) == brute(rows, _tampered)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, source string, lang string, n_chars long, text string")
    assert manifest(df, FIELDS).count() == 0


def test_an_untouched_row_is_verified_and_a_changed_one_is_not(spark):
    df = spark.createDataFrame([(i, "s", f"t{i}") for i in range(20)], "doc_id long, source string, text string")
    got = manifest(df, ["doc_id", "text"], changed={"text": F.when(F.col("doc_id") == 3, F.lit("other")).otherwise(F.col("text"))}).collect()
    assert [r.doc_id for r in got if not r.verified] == [3] and len({r.root for r in got}) == 1


def test_field(spark):
    row = spark.createDataFrame([(None, "", "é", -12)], "a string, b string, c string, d long").select(*[field(F.col(c)) for c in "abcd"]).first()
    assert tuple(row) == ("-", "0:", "2:é", "3:-12")


def test_few_files_between(spark):
    """Each file of a work table starts two processes; of three tables as wide as the input only one is written, and levels get narrower."""
    before, parts = set(work_tables()), 24
    plain = {"spark.sql.shuffle.partitions": str(parts), "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    usual = {k: spark.conf.get(k) for k in plain}
    try:
        for k, v in plain.items():
            spark.conf.set(k, v)
        rows = [(i, f"s{i % 3}", "en", 4, f"text {i}") for i in range(4000)]
        out = manifest(spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars int, text string").repartition(parts + 3), FIELDS)
        assert out.count() == 4000
    finally:
        for k, v in usual.items():
            spark.conf.set(k, v)
    files = [len(list(Path(t.removeprefix("file://")).glob("part-*"))) for t in work_tables() if t not in before]
    assert sum(n > parts // 2 for n in files) <= 1, files
