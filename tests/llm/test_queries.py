"""Each registered query once, over its whole table."""

import pytest

from laneatlas.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_token_files": {"doc_id", "start", "n_tokens", "ids_crc32"},
    "op2_line_dedup": {"doc_id", "n_lines", "n_kept", "n_removed", "kept_sha256"},
    "op3_document_fingerprints": {"doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"},
    "op4_exact_dedup": {"doc_id", "keep_id", "group_size", "kept", "text_sha256"},
    "op5_simhash_near_dedup": {"doc_id", "fingerprint", "component_id"},
    "op6_source_mixing": {"doc_id", "size", "source_size", "target", "taken"},
    "op7_suffix_dedup": {"doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"},
    "op10_quality_classifier": {"doc_id", "held_out", "score", "predicted"},
    "op12_secret_scan": {"doc_id", "n_assign", "n_access", "n_hex", "n_random", "base_sha256", "spans"},
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_a_row_for_each_document(spark, corpus, name):
    rows = QUERIES[name](spark, SF)
    assert set(rows.columns) == COLUMNS[name]
    assert sorted(r.doc_id for r in rows.select("doc_id").collect()) == sorted(corpus)


def test_packing_query(spark, corpus):
    rows = QUERIES["op9_packing"](spark, SF).collect()
    assert {r.doc_id for r in rows} == set(corpus) and all(0 < r.length <= 2048 for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracles(spark, name):
    import duckdb

    c = duckdb.connect()
    for t in ("documents", "conversations", "embeddings"):
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = c.sql(ORACLES[name])
    got = QUERIES[name](spark, SF)
    at = [want.columns.index(x) for x in got.columns]
    assert sorted(map(tuple, got.collect()), key=str) == sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=str)
