"""The queries' columns and types as contracted, and the four that DuckDB can state against it."""

import duckdb
import pytest

from shelfwise.llm import queries

TYPES = {
    "op1_secret_scans": {"doc_id": "bigint", "n_assign": "bigint", "n_access": "bigint", "n_hex": "bigint", "base_sha256": "string", "spans": "string"},
    "op2_media_columns": {"doc_id": "bigint", "n_bytes": "bigint", "payload_bytes": "bigint", "payload_sha256": "string", "tail_crc32": "bigint", "media_bytes": "bigint", "media_sha256": "string", "feature": "string"},
    "op3_embedding_dedup": {"vec_id": "bigint", "n_links": "bigint", "component_id": "bigint", "kept": "boolean"},
    "op4_toxicity": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op5_sentencepiece": {"doc_id": "bigint", "n_ids": "bigint", "ids_crc32": "bigint", "exact": "boolean"},
    "op6_packing": {"doc_id": "bigint", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "doc_tokens": "bigint", "sequence_id": "bigint", "offset": "bigint"},
    "op7_minhash_dedup": {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint", "kept": "boolean"},
    "op8_quality": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op9_license_scans": {"doc_id": "bigint", "n_matches": "bigint", "best_dice": "double", "licenses": "string"},
    "op10_token_counts": {"doc_id": "bigint", "n_bytes": "bigint", "n_tokens": "bigint", "over_limit": "boolean"},
}


@pytest.mark.parametrize("name", sorted(TYPES))
def test_columns(spark, sf_dir, name):
    df = queries.queries()[name](spark, sf_dir)
    types = dict(df.dtypes)
    assert {k: types[k] for k in TYPES[name]} == TYPES[name]


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_duckdb(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    want = con.sql(queries.oracle_sql()[name])
    cols = sorted(want.columns)
    df = queries.queries()[name](spark, sf_dir)
    assert sorted(df.columns) == cols
    got = sorted(tuple(r[c] for c in cols) for r in df.collect())
    at = [want.columns.index(c) for c in cols]
    assert got == sorted(tuple(r[i] for i in at) for r in want.fetchall())
