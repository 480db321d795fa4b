"""Each stage on its own input, against brute force."""

import re

import pytest

import corpus_pipeline as P
from laneatlas.llm.quality import fit_quality
from laneatlas.llm.mixing import water_fill

from test_similar import _components, _shingles

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_stages_and_columns(spark, docs):
    assert [n for n, _ in P.STAGES] == ["quality_classifier", "exact_dedup", "simhash_near_dedup", "source_mixing", "packing"]
    for _, stage in P.STAGES[:-1]:
        assert stage(spark, docs, SF).dtypes == docs.dtypes


def test_quality_keeps_what_the_model_accepts(spark, docs):
    model = fit_quality(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    rows = docs.collect()
    want = sorted(r.doc_id for r, s in zip(rows, model.score([r.text for r in rows])) if s >= 0.3)
    assert sorted(r.doc_id for r in P.keep_quality(spark, docs, SF).collect()) == want and 0 < len(want) < len(rows)


def test_copies(spark, docs):
    best = {}
    for r in docs.collect():
        k = re.sub(r"[\x20\x09-\x0D]", "", r.text)
        best[k] = min(best.get(k, (1, 0)), (-len(r.text), r.doc_id))
    assert sorted(r.doc_id for r in P.drop_copies(spark, docs, SF).collect()) == sorted(i for _, i in best.values())


def test_near_copies(spark, docs):
    want = set(_components({r.doc_id: _shingles(r.text) for r in docs.collect()}).values())
    assert {r.doc_id for r in P.drop_near_copies(spark, docs, SF).collect()} == want


def test_mixing(spark, docs):
    size = {}
    own = {}
    for r in docs.collect():
        own[r.doc_id] = len(re.findall(r"[^\x20\x09-\x0D]+", r.text))
        size[r.source] = size.get(r.source, 0) + own[r.doc_id]
    names = sorted(size)
    want = dict(zip(names, water_fill([size[n] for n in names], [(3, 1, 2)[i % 3] for i in range(len(names))], 1.5 * sum(size.values()), 2)))
    got, times = dict.fromkeys(names, 0), {}
    for r in P.mix_sources(spark, docs, SF).collect():
        got[r.source] += own[r.doc_id]
        times[r.doc_id] = times.get(r.doc_id, 0) + 1
    assert max(times.values()) <= 2
    largest = max(own.values())
    assert all(abs(got[n] - want[n]) <= largest for n in names)


def test_run(spark):
    rows = P.run(spark, SF).collect()
    assert rows and len({(r.sequence_id, r.offset) for r in rows}) == len(rows)
    fill = {}
    for r in rows:
        fill[r.sequence_id] = fill.get(r.sequence_id, 0) + r.length
    assert max(fill.values()) <= 2048 and P.ORACLE_SQL is None


def test_stages_on_odd_rows(spark, edges):
    """Nulls, empty and long texts, repeats, ties; then no rows at all: each stage ends, with the columns of documents."""
    rows = [(i, t, "en", None if k % 2 else "s", None if t is None else len(t), k) for k, (i, t) in enumerate(edges)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _times int")
    for name, stage in P.STAGES[:-1]:
        for docs in (df, df.limit(0)):
            got = stage(spark, docs, SF)
            assert got.columns == P.COLUMNS
            n = got.count()
            assert n == 0 if docs is not df else n <= 2 * len(rows)
    packed = P.pack_windows(spark, df, SF)
    assert {r.doc_id for r in packed.collect()} == {i for i, *_ in rows} and P.pack_windows(spark, df.limit(0), SF).count() == 0
