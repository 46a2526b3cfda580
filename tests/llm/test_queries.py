"""Every registered query over the smallest tables: the contract's columns, types and rows, and SQL where there is some."""

import os
import zlib

import duckdb
import pytest

from braidwork.llm import queries as llm

DATA = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_language_id": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op2_embedding_near_dedup": {"vec_id": "bigint", "n_links": "bigint", "component_id": "bigint", "kept": "boolean"},
    "op3_lm_score": {"doc_id": "bigint", "n_tokens": "bigint", "score": "double"},
    "op4_suffix_dedup": {"doc_id": "bigint", "n_bytes": "bigint", "n_removed": "bigint", "n_spans": "bigint", "kept_sha256": "string"},
    "op5_minhash_near_dedup": {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint", "kept": "boolean"},
    "op8_line_dedup": {"doc_id": "bigint", "n_lines": "bigint", "n_removed": "bigint", "kept_sha256": "string"},
    "op9_mixing": {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"},
    "op10_quality": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
}
FOLDS = {"op1_language_id": (5, 0), "op10_quality": (4, 2)}

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{DATA}/{f}'")
    return con


@pytest.mark.parametrize("name", list(llm.queries()))
def test_query(spark, duck, name):
    df = llm.queries()[name](spark, DATA)
    types, rows = dict(df.dtypes), df.collect()
    for column, kind in COLUMNS.get(name, {}).items():
        assert types[column] == kind
    if name in COLUMNS:
        key = "vec_id" if "vec_id" in types else "doc_id"
        table = "embeddings" if key == "vec_id" else "documents"
        assert sorted(r[key] for r in rows) == sorted(x for (x,) in duck.execute(f"SELECT {key} FROM {table}").fetchall())
    if name in FOLDS:
        folds, fold = FOLDS[name]
        assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % folds == fold) and 0 <= r["score"] <= 1 for r in rows)
    if name in llm.oracle_sql():
        names = sorted(df.columns)
        cursor = duck.execute(llm.oracle_sql()[name])
        columns = [d[0] for d in cursor.description]
        assert sorted(columns) == names
        assert sorted(([r[c] for c in names] for r in rows), key=repr) == sorted(([r[columns.index(c)] for c in names] for r in cursor.fetchall()), key=repr)
