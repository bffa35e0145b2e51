"""The queries of this subpackage on the smallest tables: columns, uniqueness, and SQL where there is some."""

import os

import duckdb
import pytest

from newsgrain.llm.queries import ORACLE, QUERIES

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the test tables are not here")
COLUMNS = {
    "p1_found": ["topic_group", "idx_a", "idx_b"], "p2_found": ["row_idx", "line_no"], "p3_found": ["row_a", "row_b"], "p4_found": ["field_name", "row_a", "row_b"], "p5_found": ["cluster"],
    "p6_found": ["row_a", "row_b"], "p7_ids": ["doc_id", "ids"], "p8_found": ["doc_id", "item_id"], "p9_found": ["doc_id", "pii_kind", "pii_text"],
}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_runs_and_is_unique(spark, name):
    df = QUERIES[name](spark, FOLDER)
    rows = [repr(r) for r in df.collect()]
    assert df.columns == COLUMNS.get(name, df.columns)
    assert len(rows) == len(set(rows))
    for a, b in (("idx_a", "idx_b"), ("row_a", "row_b")):
        if a in df.columns:
            assert df.where(f"{a} >= {b}").count() == 0


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("article_vectors", "cluster_temporal_stats", "clustered_data", "documents", "eval_items"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    df = QUERIES[name](spark, FOLDER)
    rel = con.sql(ORACLE[name])
    at = [rel.columns.index(c) for c in df.columns]
    want = {tuple(r[i] for i in at) for r in rel.fetchall()}
    got = {tuple(r) for r in df.collect()}
    if name == "p1_found":  # an approximate index
        assert len(got & want) >= 0.99 * len(want) and len(got - want) <= 0.01 * len(want) + 1
    else:
        assert got == want
